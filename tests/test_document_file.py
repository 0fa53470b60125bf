"""One document written by many tasks and read again; failed tasks leave nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import report
from scriptorium.plans.rules import LATIN
from scriptorium.sources.document_file import read_document, write_document


def whole(path):
    return "".join(open(os.path.join(path, n), encoding="utf-8").read() for n in sorted(os.listdir(path)) if n.endswith(".json"))


def test_nested_results_make_one_document(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(7)
    results = report.samples(docs, LATIN)
    path = f"{tmp_path}/out"
    write_document(results, path, prefix="window.samples = ", suffix=";")
    text = whole(path)
    assert text.startswith("window.samples = {") and text.endswith("};\n") and not [n for n in os.listdir(path) if n.startswith("_")]
    found, want = json.loads(text[len("window.samples = ") : -2]), {r.doc_id: r for r in results.collect()}
    assert {int(k) for k in found} == set(want)
    for k, v in found.items():
        r = want[int(k)]
        assert v["stats"]["chunks"] == len(v["chunks"]) == r.stats.chunks and v["versions"] == r.versions and v["review_items"] == list(r.review_items)
    back = read_document(spark, path, results.schema.simpleString())
    assert {r.doc_id: r for r in back.collect()} == want


def test_odd_keys_empty_parts_and_tables(spark, tmp_path):
    rows = [("a\"b\\: {", "x\ny   漢"), ("a\"b\\: {", None), (None, "z")]
    df = spark.createDataFrame(rows, "k string, v string").repartition(8)
    path = f"file://{tmp_path}/odd"
    write_document(df, path, key="k")
    assert sorted(map(tuple, read_document(spark, path, "k string, v string").collect()), key=str) == sorted(rows, key=str)
    assert len(json.loads(whole(f"{tmp_path}/odd"), object_pairs_hook=list)) == 3
    write_document(df.where("false"), path, key="k")  # an older document goes
    assert json.loads(whole(f"{tmp_path}/odd")) == {} and read_document(spark, path, "k string, v string").count() == 0


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    bad = spark.range(0, 1000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise("v").alias("v"))
    with pytest.raises(Exception, match="broken"):
        write_document(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    write_document(spark.range(5).withColumnRenamed("id", "doc_id"), path)
    before = whole(path)
    with pytest.raises(Exception, match="broken"):
        write_document(bad, path)
    assert whole(path) == before and not [n for n in os.listdir(path) if n.startswith("_")]
