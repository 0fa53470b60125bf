"""Searches by postings against looking at every row."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import catalog, search


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(6)
    words = ["Reading", "classics", "醉叟传", "Essay", "étude", "a", "lexicon", "IMPROVING", "style"]
    data = [(i, " ".join(draw.choices(words, k=draw.randint(0, 4))) if i % 17 else None, draw.choice(["Mr Zhang", "陈老师", None, "O'Neill %_"]), "kind") for i in range(600)]
    return spark.createDataFrame(data, "id long, title string, teacher string, type string").repartition(4)


ASKED = ["read", "READING", "叟传", "醉叟传", "老师", "a", "", "o'n", "%_", "ing es", "nothing like it", "é", "Étu", "ss", "kind", "mr zhang"]


def test_a_search_finds_what_a_scan_finds(spark, rows):
    index = search.build(rows, "id", ("title", "teacher"))
    for text in ASKED:
        got = sorted(map(tuple, search.search(spark, index, text).select(*rows.columns).collect()), key=str)
        want = sorted(map(tuple, catalog.search(rows, text=text, columns=("title", "teacher")).collect()), key=str)
        assert got == want, text


def test_many_searches(spark, rows):
    index = search.build(rows, "id", ("title", "teacher"))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*ASKED, "read", None])], "no int, asked string")
    got = sorted(map(tuple, search.search_many(spark, index, asked, "asked").collect()))
    want = []
    for no, text in enumerate([*ASKED, "read", None]):
        if text:
            want += [(no, text, r.id) for r in catalog.search(rows, text=text, columns=("title", "teacher")).select("id").collect()]
    assert got == sorted(want)


def test_only_folders_with_candidates_are_read(spark, rows):
    index = search.build(rows.withColumn("title", F.when(F.col("id") == 77, "unheard of").otherwise(F.col("title"))), "id", ("title",))
    found = search.search(spark, index, "unheard")
    assert [r.id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "PartitionFilters" in plan and "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def test_a_table_read_in_one_partition_is_indexed_by_many_tasks(spark, rows, monkeypatch):
    whole = rows.coalesce(1).where("id % 17 > 0")
    letters = whole.agg(F.sum(F.length("title") + F.length(F.coalesce("teacher", F.lit(""))))).first()[0]
    monkeypatch.setattr(search, "MOST", letters // 20)
    index = search.build(whole, "id", ("title", "teacher"))
    for table in ("postings", "rows"):
        files = spark.read.parquet(f"{index.path}/{table}").select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
        assert files.distinct().count() > 15
    got = {r.id for r in search.search(spark, index, "essay").collect()}
    assert got == {r.id for r in catalog.search(whole, text="essay", columns=("title", "teacher")).collect()}


def test_empty_tables(spark, rows):
    index = search.build(rows.where("false"), "id", ("title",))
    assert search.search(spark, index, "read").collect() == []
    assert search.search_many(spark, index, spark.createDataFrame([("read",)], "t string"), "t").collect() == []
