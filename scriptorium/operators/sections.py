"""From documents to titled sections. One row a document all the way: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans.rules import RulePack
from scriptorium.sources.text import dealt, paragraph_array


def cleaned_array(raw: Column, pack: RulePack) -> Column:
    """Kept paragraphs as struct(para_no, text): the first one (a heading) and bare time stamps go, texts are cleaned and
    noise is marked, what is empty then goes; numbers stay those of the raw paragraphs."""
    numbered = F.transform(raw, lambda p, i: F.struct((i + 1).alias("para_no"), p.alias("text")))
    kept = F.filter(numbered, lambda p: (p["para_no"] > 1) & ~T.is_timestamp(p["text"], pack))
    cleaned = F.transform(kept, lambda p: F.struct(p["para_no"].alias("para_no"), T.clean(p["text"], pack).alias("text")))
    full = F.filter(cleaned, lambda p: F.length(p["text"]) > 0)
    return F.transform(full, lambda p: F.struct(p["para_no"].alias("para_no"), T.mark_noise(p["text"], pack).alias("text")))


def section_begins(paras: Column, max_chars: Column | int) -> Column:
    """Places (from 1) of the first paragraph of each section: a fold that begins a new section where the next paragraph would not fit.

    A paragraph longer than max_chars is a section by itself; exactly max_chars fits.
    """
    most = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("begins"))

    def step(state: Column, p: Column) -> Column:
        size, at = F.length(p["text"]), state["at"] + 1
        full = (state["at"] == 0) | (state["used"] + size > most)
        return F.struct(at.alias("at"), F.when(full, size).otherwise(state["used"] + size).alias("used"), F.when(full, F.array_append(state["begins"], at)).otherwise(state["begins"]).alias("begins"))

    return F.aggregate(paras, empty, step)["begins"]


def documents(docs: DataFrame, pack: RulePack, max_chars: Column | int | None = None, *keys: str) -> DataFrame:
    """doc_id, raw (paragraphs), paras (kept ones), begins (places of the sections' first paragraphs among these). keys: see dealt()."""
    out = dealt(docs, 4, *keys).select("doc_id", F.coalesce(paragraph_array(F.col("text")), F.array().cast("array<string>")).alias("raw"))
    out = out.withColumn("paras", cleaned_array(F.col("raw"), pack))
    return out.withColumn("begins", section_begins(F.col("paras"), pack.max_chars if max_chars is None else max_chars))


def sections(docs: DataFrame, pack: RulePack, max_chars: Column | int | None = None) -> DataFrame:
    """doc_id, chunk_no, chunk_id, title, start_para, end_para, raw_chars, paras, body, chunks (in the document).

    Ranges of raw paragraphs are contiguous from 1 to the last: what was dropped belongs to the section before. raw_chars
    counts cleaned text without separators. A document without kept paragraphs has no section. Each section's row carries
    its own slice of the paragraphs.
    """
    return of_documents(documents(docs, pack, max_chars), pack)


def of_documents(d: DataFrame, pack: RulePack, *keep: str) -> DataFrame:
    """The sections of rows of documents(), each with the columns `keep` of its document."""
    last = lambda i: F.coalesce(F.try_element_at("begins", i + 2) - 1, F.size("paras"))
    after = lambda i: F.try_element_at("paras", F.try_element_at("begins", i + 2))["para_no"] - 1
    pieces = F.transform("begins", lambda b, i: F.struct(F.slice("paras", b, last(i) - b + 1).alias("own"), F.coalesce(after(i), F.size("raw")).alias("to")))
    d = d.select("doc_id", *keep, F.size("begins").alias("chunks"), F.posexplode(pieces).alias("at", "piece")).select("doc_id", *keep, "chunks", (F.col("at") + 1).alias("chunk_no"), "piece.own", "piece.to")
    d = d.withColumn("body", F.array_join(F.transform("own", lambda p: p["text"]), "\n"))
    return d.select(
        "doc_id",
        "chunk_no",
        F.format_string("c%02d", "chunk_no").alias("chunk_id"),
        T.title(F.col("body"), F.col("chunk_no"), pack).alias("title"),
        F.when(F.col("chunk_no") == 1, 1).otherwise(F.element_at("own", 1)["para_no"]).alias("start_para"),
        F.col("to").alias("end_para"),
        F.aggregate("own", F.lit(0), lambda s, p: s + F.length(p["text"])).alias("raw_chars"),
        F.col("own").alias("paras"),
        "body",
        "chunks",
        *keep,
    )


def kept_paragraphs(documents_: DataFrame) -> DataFrame:
    """doc_id, para_no, text: a row for each kept paragraph of rows of documents(). It isn't the column itself that is exploded:
    Spark would drop empty arrays by a filter before texts are dealt out, and clean every text twice."""
    rows = F.transform("paras", lambda p: F.struct(p["para_no"].cast("long").alias("para_no"), p["text"].alias("text")))
    return documents_.select("doc_id", F.inline(rows))


def section_paragraphs(sections_: DataFrame) -> DataFrame:
    """A row for each paragraph of a section, with its place in the section (pos, from 1)."""
    return sections_.select("doc_id", "chunk_no", "raw_chars", F.posexplode("paras").alias("at", "p")).select("doc_id", "chunk_no", "raw_chars", (F.col("at") + 1).alias("pos"), F.col("p.para_no").alias("para_no"), F.col("p.text").alias("text"))


def neighbour(step: int) -> Column:
    """The id of the section before (-1) or after (1), empty at the ends; ids are numbers in order, so no window is needed."""
    inside = F.col("chunk_no") > 1 if step < 0 else F.col("chunk_no") < F.col("chunks")
    return F.when(inside, F.format_string("c%02d", F.col("chunk_no") + step)).otherwise("")


def neighbours(sections_: DataFrame) -> DataFrame:
    """The ids of the sections before and after each one."""
    return sections_.select("doc_id", "chunk_id", neighbour(-1).alias("prev_chunk"), neighbour(1).alias("next_chunk"))
