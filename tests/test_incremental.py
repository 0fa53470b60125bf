"""Sections of documents whose paragraphs arrive in batches, against those of whole documents."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from scriptorium.operators import sections as S
from scriptorium.plans.rules import LATIN
from scriptorium.sources.text import paragraphs
from scriptorium.streaming import incremental

PACK = replace(LATIN, max_chars=40)
SCHEMA = "doc_id long, para_no int, raw string, paras int, text string"
COLUMNS = ("doc_id", "chunk_no", "chunk_id", "title", "start_para", "end_para", "n_paras", "raw_chars", "body")


def texts(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", "um", "anna 00:01:02", "x" * 39, "y" * 40, "z" * 95, "so, we begin the next part", "a b", "é" * rng.randrange(1, 30)])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 60)))) for i in range(12)]
    return [*rows, (None, "head\nfirst line\nsecond line"), (90, None), (91, ""), (92, "head only"), (93, "head\n" + "word " * 20000 + "\ntail")]


def deliver(spark, tmp_path, deliveries):
    """The sections after the deliveries, each one a run of its own on the state of those before."""
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        incremental.ingest(stream, PACK, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        if i == 0:
            first = spark.read.parquet(str(tmp_path / "out")).count()
    return spark.read.parquet(str(tmp_path / "out")), first


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


def whole(spark, documents):
    d = S.sections(spark.createDataFrame(documents, "doc_id long, text string"), PACK)
    return d.withColumn("n_paras", F.size("paras").cast("long")).withColumns({c: F.col(c).cast("long") for c in ("start_para", "end_para", "raw_chars")})


def numbered(spark, documents):
    found = paragraphs(spark.createDataFrame(documents, "doc_id long, text string")).collect()
    many = {}
    for r in found:
        many[r.doc_id] = max(many.get(r.doc_id, 0), r.para_no)
    return [(r.doc_id, r.para_no, r.raw, many[r.doc_id], "clashing name") for r in found]


def test_any_order_and_any_split_gives_the_sections_of_whole_documents(spark, tmp_path):
    documents = texts(1)
    arriving = numbered(spark, documents)
    rng = random.Random(2)
    rng.shuffle(arriving)
    arriving += rng.sample(arriving, 40)  # delivered twice
    told = set()
    for i in reversed(range(len(arriving))):  # how many there are is known only with what comes last
        doc, *rest = arriving[i]
        arriving[i] = (doc, *rest[:2], rest[2] if doc not in told else None, rest[3])
        told.add(doc)
    third = len(arriving) // 3
    got, _ = deliver(spark, tmp_path, [arriving[:third], arriving[third : 2 * third], arriving[2 * third :], arriving[:50]])
    assert rows(got) == rows(whole(spark, documents))
    assert got.where("last").count() == got.select("doc_id").distinct().count()


def test_appended_paragraphs_close_sections_at_once(spark, tmp_path):
    documents = [(1, "head\n" + "\n".join(f"line {i} of the document" for i in range(50)))]
    arriving = numbered(spark, documents)
    got, first = deliver(spark, tmp_path, [arriving[:20], arriving[20:]])
    assert rows(got) == rows(whole(spark, documents)) and first > 10


def test_odd_rows(spark, tmp_path):
    odd = [(1, 1, "head", None, None), (1, 3, None, None, None), (1, 2, "text of it", 3, None), (1, 4, "beyond the end", None, None), (1, None, "no place", None, None), (1, 0, "before all", 9, None), (2, 2, "its head never comes", 2, None)]
    got, _ = deliver(spark, tmp_path, [odd, []])
    assert [tuple(r) for r in got.select("doc_id", "chunk_no", "start_para", "end_para", "body", "last").collect()] == [(1, 1, 1, 3, "text of it", True)]


def test_no_paragraphs(spark, tmp_path):
    got, _ = deliver(spark, tmp_path, [[]])
    assert got.count() == 0
