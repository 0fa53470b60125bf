"""Sections of documents whose paragraphs keep arriving: each document has state, and a section leaves once its end is known."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scriptorium.functions import text as T
from scriptorium.plans.rules import RulePack

#: Paragraphs that are taken in at a time.
AT_ONCE = 4096
#: Groups of documents whose state is read and stored together: a call of the state store takes longer than a document's work.
GROUPS = 2048
#: A document whose number of paragraphs isn't known yet.
UNKNOWN = -(1 << 63)
#: Where state of several kinds for a key can be kept, and how many rows Python gets at a time.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(AT_ONCE),
}
_COLUMNS = {"doc": "string", "chunk_no": "int", "start_para": "long", "end_para": "long", "n_paras": "long", "raw_chars": "long", "body": "string", "last": "boolean"}


class _Document:
    """What is known of a document while its paragraphs are taken in: its numbers, and its open section."""

    def __init__(self, next=1, no=0, start=1, used=0, count=0, total=None, early=0, body=""):
        self.next, self.no, self.start, self.used, self.count, self.total, self.early = next, no, start, used, count, total, early
        self.lines: list[str] = [body] if count else []

    def state(self) -> tuple:
        return self.next, self.no, self.start, self.used, self.count, self.total, self.early, "\n".join(self.lines)

    @property
    def ended(self) -> bool:
        return self.total is not None and self.next > self.total

    def take(self, text: str, most: int) -> tuple | None:
        """The document's next paragraph; gives the section before it, if it begins another one."""
        section = None
        if text:
            full = self.used + len(text) > most
            if self.no and full:
                section = self.section(self.next - 1, False)
            if not self.no or full:
                self.no, self.start, self.used, self.count = self.no + 1, self.next if self.no else 1, 0, 0
                self.lines = []
            self.lines.append(text)
            self.used += len(text)
            self.count += 1
        self.next += 1
        return section

    def section(self, end: int, last: bool) -> tuple:
        return self.no, self.start, end, self.count, self.used, "\n".join(self.lines), last


class Fold(StatefulProcessor):
    """Sections of a group's documents, from rows (doc, para_no, text, paras); see sections()."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "doc string, next long, no long, start long, used long, count long, total long, early long, body string")
        self.ended = handle.getListState("ended", "doc string")
        self.early = handle.getMapState("early", "doc string, para_no long", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        docs = {name: _Document(*known) for name, *known in self.open.get()}
        ended, over, left = {r[0] for r in self.ended.get()}, [], set()
        for frame in rows:
            arrived = defaultdict(list)
            for name, *row in zip(frame["doc"].tolist(), frame["para_no"].tolist(), frame["text"].tolist(), frame["paras"].tolist()):
                if name not in ended:  # else delivered again
                    arrived[name].append(row)
            found = []
            for name, own in arrived.items():
                doc = docs.setdefault(name, _Document())
                found += [(name, *s) for s in self._arrive(name, doc, own)]
                if doc.ended:
                    ended.add(name)
                    over.append((name,))
                    if docs.pop(name).early:
                        left.add(name)
            if found:
                yield pd.DataFrame(found, columns=list(_COLUMNS))
        if docs:
            self.open.put([(name, *doc.state()) for name, doc in docs.items()])
        else:
            self.open.clear()
        if over:
            self.ended.appendList(over)
        if left:  # paragraphs beyond the end that came before it was known
            for place in [k for k in self.early.keys() if k[0] in left]:
                self.early.removeKey(place)

    def _arrive(self, name: str, doc: _Document, rows: list) -> Iterator[tuple]:
        if doc.total is None:
            doc.total = next((paras for _, _, paras in rows if paras != UNKNOWN), None)
        for para_no, text, _ in sorted(rows, key=lambda r: r[0]):
            if doc.ended:
                break
            if para_no == doc.next:
                if section := doc.take(text, self.most):
                    yield section
            elif para_no > doc.next and not (doc.early and self.early.containsKey((name, para_no))):
                self.early.updateValue((name, para_no), (text,))
                doc.early += 1
        while doc.early and not doc.ended and (waiting := self.early.getValue((name, doc.next))):
            self.early.removeKey((name, doc.next))
            doc.early -= 1
            if section := doc.take(waiting[0], self.most):
                yield section
        if doc.ended:
            if doc.no:
                yield doc.section(doc.total, True)

    def close(self) -> None:
        pass


def sections(paragraphs: DataFrame, pack: RulePack, most: int | None = None) -> DataFrame:
    """doc_id, chunk_no, chunk_id, title, start_para, end_para, n_paras, raw_chars, body, last of a streaming DataFrame of paragraphs.

    Its rows are (doc_id, para_no, raw, paras): numbers from 1 without gaps, in any order and over any number of batches;
    paras is how many the document has, on any of its rows, null as long as this isn't known (of several numbers, one holds).
    The sections are those of operators.sections.sections over whole documents, whatever the batches: each is given once
    (append), when the paragraph that doesn't fit in it has come with all before it, and the last one when all have.

    State of a document: some numbers, its open section (at most `most` characters, or one long paragraph), and
    paragraphs that wait for those before them. Documents are in GROUPS groups by a hash; a batch reads and stores the open
    sections of all documents in the groups that it has paragraphs of, and no other sections. Of a finished document, the id
    stays, so that a paragraph delivered again changes nothing; of a number that comes twice, one row holds. Rows of a null doc_id are one document; rows without para_no, or with one below 1, are left out, and so
    are paragraphs beyond `paras`. A null raw counts as empty, as a paragraph does of which cleaning leaves nothing: it has
    a number, but no place in a body. Other columns are not read. doc_id: a type that a cast to string and back keeps.
    """
    kind = paragraphs.schema["doc_id"].dataType.simpleString()
    stays = (F.col("para_no") > 1) & ~T.is_timestamp(F.col("raw"), pack)
    text = F.when(stays, T.cleaned(F.col("raw"), pack))
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))  # null is a document, too
    rows = paragraphs.where("para_no >= 1").select(
        F.pmod(F.xxhash64(doc), F.lit(GROUPS)).alias("part"),
        doc.alias("doc"),
        F.col("para_no").cast("long").alias("para_no"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col("paras").cast("long"), F.lit(UNKNOWN)).alias("paras"),
    )
    out = rows.groupBy("part").transformWithStateInPandas(
        Fold(pack.max_chars if most is None else most),
        ", ".join(f"{name} {type_}" for name, type_ in _COLUMNS.items()),
        "append",
        "none",
    )
    doc_id = F.when(F.col("doc") != "", F.substring("doc", 2, (1 << 31) - 1)).cast(kind)
    names = {"doc_id": doc_id, "chunk_id": F.format_string("c%02d", "chunk_no"), "title": T.title(F.col("body"), F.col("chunk_no"), pack)}
    return out.withColumns(names).select("doc_id", "chunk_no", "chunk_id", "title", "start_para", "end_para", "n_paras", "raw_chars", "body", "last")


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state where sections() needs it; the session's own settings return afterwards."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def ingest(paragraphs: DataFrame, pack: RulePack, path: str, checkpoint: str, most: int | None = None) -> StreamingQuery:
    """Writes the sections that all paragraphs available complete to Parquet, exactly once; a later run goes on with the state."""
    with state_store(paragraphs.sparkSession):
        out = sections(paragraphs, pack, most).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
