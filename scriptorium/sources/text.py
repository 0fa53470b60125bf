"""Paragraphs of documents, from tables and from Word files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

SAMPLE = "sample_id string, title string, subtitle string, source string, max_chars int"


def paragraph_array(text: Column) -> Column:
    """Lines of a text, without white space around them, those left empty dropped."""
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: F.length(p) > 0)


def dealt(docs: DataFrame, tasks_per_core: int = 4, *keys: str) -> DataFrame:
    """docs over all cores, where the scan has few partitions: cleaning takes far longer than moving texts. With keys, always,
    by these: what is grouped by them afterwards then stays where it is, and texts move before they become much more."""
    if docs.isStreaming:
        return docs
    cores, parts = docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    if keys:
        return docs.repartition(max(cores, parts), *keys)
    return docs.repartition(cores) if parts < tasks_per_core * cores else docs


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, para_no (from 1, after dropping blank lines), raw."""
    return dealt(docs).select("doc_id", F.posexplode(paragraph_array(F.col(text))).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).alias("para_no"), "raw")


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Samples and their parameters: sample_id, title, subtitle, source, max_chars."""
    return spark.createDataFrame(rows, SAMPLE)


_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _body(data: bytes) -> list[str]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return ["".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()) for p in body.findall(f"{_W}p")]


#: Word files that a task makes or reads at a time, however many rows Spark hands it in a batch.
FILES = 128


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, FILES) for i in range(0, batch.num_rows, FILES))


def docx_texts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and text (body paragraphs as lines) of Word files that are in a binary column; a file is read in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            texts = ["\n".join(" ".join(p.split("\n")) for p in _body(data.as_py())) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return files.select(key, content).mapInArrow(work, f"`{key}` {files.schema[key].dataType.simpleString()}, text string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and text of Word files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return docx_texts(files.withColumnRenamed("path", "doc_id"), "doc_id")


def docx_content(text: str | None) -> bytes:
    """A Word file with a paragraph for each line of a text. Characters that XML doesn't allow become blanks."""
    lines = _NOT_XML.sub(" ", text or "").split("\n")
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def to_docx(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and content: each document as a Word file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([docx_content(t) for t in batch.column(1).to_pylist()], pa.binary())], [key, "content"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, content binary")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, non-ASCII characters kept; readable again with spark.read.json."""
    df.write.mode("overwrite").json(path)


def to_json(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: each row as one object, columns without a value too, non-ASCII characters kept."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of results that to_json() made."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Results that write_json() made, with their nested columns."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)
