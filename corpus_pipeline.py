"""From raw documents to packed training sequences: five stages over the table `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import minhash, mixing, packing, quality, substrings
from scriptorium.llm.common import WORDS, cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Null texts are judged as empty.

    Rows without doc_id are judged, too; repeated rows are judged alike; an empty table gives no rows; other columns go.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, COLUMNS).where("kept").select(*COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates.

    Rows without doc_id or without words stay, as do all rows of a doc_id that stays; an empty table gives no rows.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller doc_id has; texts that lose nothing stay as they are, those that lose all go.

    Null texts and rows without doc_id stay as they are; repeated rows lose the same; an empty table gives no rows.
    """
    out = substrings.remove_repeats(docs, COLUMNS).where("n_removed = 0 or n_removed < n_words")
    cut_text = F.col("n_removed") > 0
    return out.withColumn("n_chars", F.when(cut_text, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.when(cut_text, F.col("kept_text")).otherwise(F.col("text"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (a row each time); the one at a source's border up to its last word taken.

    Rows without doc_id, and rows of one doc_id, are taken each for itself: what is taken comes back by a number of the row.
    """
    docs = cut(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    taken = mixing.mix_sources(docs, table(spark, sf_dir, "labels"), keep=("row",)).where("taken > 0").select("row", "size", "taken")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))
    rows = docs.join(taken, "row").withColumn("time", times)
    left = F.least("size", F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), left), " ")
    short = left < F.col("size")
    return rows.withColumn("head", F.when(short, head)).select("doc_id", F.when(short, F.col("head")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(short, F.length("head").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; null and empty texts are one piece with the final id."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_class),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: Classifier, near-duplicates and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
