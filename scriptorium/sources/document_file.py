"""One nested JSON document of many results, written by many tasks: `<prefix>{"key": {...}, ...}<suffix>`.

The document is a folder of files that make it up in the order of their names, as a single one would be too large for any task
or the driver. Each file but the first and the last has whole lines, one for each result.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEAD, TAIL, STAGED = "00000000-head.json", "99999999-tail.json", "_staged"
#: Bytes that are copied at a time.
BLOCK = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    if "://" in path or path.startswith("file:"):
        parts = urlparse(path)
        if parts.scheme == "file":
            return fs.LocalFileSystem(), parts.path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Part(WriterCommitMessage):
    """A file of a task: its name, and how many results it has."""

    name: str
    partition: int
    results: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.prefix, self.suffix, self.overwrite = options["path"], options.get("prefix", ""), options.get("suffix", ""), overwrite
        self.job = uuid.uuid4().hex

    def staged(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.path)
        return store, root, f"{root}/{STAGED}-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Part:
        """Rows of (key, json) as lines, each after a comma, in a file of this attempt; nothing of it shows before the commit."""
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _, staged = self.staged()
        name, results = f"{task.partitionId():08}-{task.taskAttemptId()}.json", 0
        store.create_dir(staged, recursive=True)
        with store.open_output_stream(f"{staged}/{name}") as out:
            for key, value in iterator:
                out.write(f",{json.dumps(str(key), ensure_ascii=False)}: {value}\n".encode())
                results += 1
        return Part(name, task.partitionId(), results)

    def commit(self, messages: list[Part | None]) -> None:
        """Names the files in the tasks' order, without the comma before the first result; the head comes last of all, as a sign
        that the document is whole."""
        store, root, staged = self.staged()
        parts = sorted((m for m in messages if m and m.results), key=lambda m: m.partition)
        old = [i for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name.endswith(".json")]
        if old and not self.overwrite:
            raise ValueError(f"there is a document in {self.path}; a document can only be overwritten")
        for i in sorted(old, key=lambda i: i.base_name != HEAD):
            store.delete_file(i.path)
        store.create_dir(root, recursive=True)
        for n, part in enumerate(parts):
            to = f"{root}/{n + 1:08}-results.json"
            if n == 0:
                with store.open_input_stream(f"{staged}/{part.name}") as source, store.open_output_stream(to) as out:
                    source.read(1)
                    while block := source.read(BLOCK):
                        out.write(block)
            else:
                store.move(f"{staged}/{part.name}", to)
        for name, text in ((TAIL, "}" + self.suffix + "\n"), (HEAD, self.prefix + "{\n")):
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(text.encode())
        self.clear(store, staged)

    def abort(self, messages: list[Part | None]) -> None:
        store, root, staged = self.staged()
        self.clear(store, staged)
        if not store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            self.clear(store, root)

    @staticmethod
    def clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class DocumentFile(DataSource):
    """Format `document_file`: rows of (key, json) to one document; options path, prefix and suffix."""

    @classmethod
    def name(cls) -> str:
        return "document_file"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if len(schema) != 2:
            raise ValueError("rows of (key, json) are expected")
        return Writer(dict(self.options), overwrite)


def write_document(results: DataFrame, path: str, key: str = "doc_id", prefix: str = "", suffix: str = "") -> None:
    """Every row as a member of one JSON object, by its key: the key's text -> all columns, nested ones too, nulls kept.

    prefix and suffix surround the document (a script may assign it to a name). Results are put into JSON in the JVM; a task
    writes lines as they come. A task that fails and is tried again leaves nothing of its first attempt; a job that fails
    leaves the folder as it was. Keys aren't made distinct; a null key is "None". An empty table gives an empty object.
    """
    results.sparkSession.dataSource.register(DocumentFile)
    rows = results.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))
    rows.write.format("document_file").options(prefix=prefix, suffix=suffix).mode("overwrite").save(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of a document, one a row: its lines are read and parsed in the JVM, over as many tasks as files have blocks."""
    lines = spark.read.text(path, pathGlobFilter="*-results.json")
    return lines.select(F.from_json(F.regexp_extract("value", r'(?s)^,?"(?:[^"\\]|\\.)*": (.*)$', 1), schema).alias("r")).select("r.*")
