"""Word files as a data source: tasks by the files' sizes, paragraphs as XML is read, defective files as rows that say so."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.sources.document_file import opened
from scriptorium.sources.text import _W, docx_content

SCHEMA = "path string, line_no long, text string, error string"
#: Bytes of files that a task reads (a larger file is one by itself); paragraphs that leave it together.
TASK, TOGETHER = 64 << 20, 4096
_MARKS = {f"{_W}tab": "\t", f"{_W}br": " ", f"{_W}cr": " "}


@dataclass
class Files(InputPartition):
    """Paths of the files of a task."""

    paths: tuple[str, ...]


def paragraphs_of(file) -> Iterator[str]:
    """The texts of a Word file's body paragraphs. Elements are forgotten as soon as they end, so memory holds one paragraph."""
    with zipfile.ZipFile(file) as z, z.open("word/document.xml") as xml:
        depth, body = 0, None
        for event, element in ElementTree.iterparse(xml, events=("start", "end")):
            if event == "start":
                depth += 1
                if depth == 2 and element.tag == f"{_W}body":
                    body = element
                continue
            depth -= 1
            if depth == 2 and body is not None:
                if element.tag == f"{_W}p":
                    yield "".join((x.text or "").replace("\n", " ") if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in element.iter())
                body.clear()
        if body is None:
            raise ValueError("no body")


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.task = options["path"], int(options.get("taskBytes", TASK))

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        files = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.extension == "docx"]
        out, size = [[]], 0
        for i in sorted(files, key=lambda i: i.path):
            if out[-1] and size + i.size > self.task:
                out.append([])
                size = 0
            out[-1].append(i.path)
            size += i.size
        return [Files(tuple(paths)) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "line_no", "text", "error"])

        for path in partition.paths:
            try:
                with store.open_input_file(path) as file:
                    for n, text in enumerate(paragraphs_of(file), 1):
                        rows.append((path, n, text, None))
                        if len(rows) == TOGETHER:
                            yield batch()
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, EOFError, NotImplementedError, zipfile.zlib.error) as e:
                rows.append((path, None, None, f"{type(e).__name__}: {e}"))
        yield batch()


class WordFiles(DataSource):
    """Format `word_files`: all .docx files below a path; option taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "word_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_word_files(spark: SparkSession, path: str, task_bytes: int = TASK) -> DataFrame:
    """path, line_no (from 1), text: a row for each body paragraph; a file that can't be read (on) has a row with its error after
    what could be read of it, and doesn't stop the job. Files of about task_bytes together are a task's work."""
    spark.dataSource.register(WordFiles)
    return spark.read.format("word_files").option("taskBytes", task_bytes).load(path)


def write_word_files(lines: DataFrame, path: str, file: str, *order: str) -> DataFrame:
    """Writes a Word file for each value of the column `file`, with the rows of `text` in that order as its paragraphs; gives back
    file and paragraphs, and writes as this is read. A file is one task's work."""
    kind = lines.schema[file].dataType.simpleString()

    def work(key, group):
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        texts = group.sort_by([(c, "ascending") for c in order]).column("text").to_pylist()
        content = docx_content("\n".join((t or "").replace("\n", " ") for t in texts))
        with store.open_output_stream(f"{root}/{key[0].as_py()}.docx") as out:
            out.write(content)
        return pa.table({file: group.column(file)[:1], "paragraphs": pa.array([len(texts)], pa.int64())})

    return lines.select(file, "text", *order).groupBy(file).applyInArrow(work, f"`{file}` {kind}, paragraphs long")
