"""Positions, circular neighbours, running sums and sections of long documents over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import long_documents, positions
from scriptorium.operators import sections as S
from scriptorium.plans.rules import LATIN
from scriptorium.sources.text import paragraphs


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_positions(spark, many_parts):
    rows = [(x * 7919 % 10007, x % 3) for x in range(5000)]
    found = {r.a: r.ord for r in positions.positions(spark.createDataFrame(rows, "a long, b long"), "a").collect()}
    assert found == {a: i for i, a in enumerate(sorted(a for a, _ in rows))}
    assert positions.positions(spark.createDataFrame([], "a long"), "a").collect() == []
    assert sorted(r.ord for r in positions.positions(spark.createDataFrame([(1,)] * 50 + [(None,)], "a long"), "a").collect()) == list(range(51))


def test_circular_siblings(spark, many_parts):
    ids = [f"k{x * 7919 % 10007:05}" for x in range(3000)]
    found = {r.id: (r.prev_id, r.next_id) for r in positions.circular_siblings(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "id").collect()}
    order = sorted(ids)
    assert found == {k: (order[i - 1], order[(i + 1) % len(order)]) for i, k in enumerate(order)}
    one = positions.circular_siblings(spark.range(1), "id", "id").first()
    assert tuple(one) == (0, 0, 0)
    assert positions.circular_siblings(spark.range(0), "id", "id").collect() == []
    plan = positions.circular_siblings(spark.range(100), "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_running_sums(spark, many_parts):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), i, draw.randint(1, 9)) for i in range(4000)]
    found = {r.i: (r._no, r._before) for r in positions.running(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], ["i"], "n").collect()}
    seen: dict = {}
    for k, i, n in rows:
        no, before = seen.get(k, (0, 0))
        assert found[i] == (no + 1, before)
        seen[k] = (no + 1, before + n)


def folded(sizes, most):
    out, used, no = [], 0, 0
    for n in sizes:
        if no == 0 or used + n > most:
            no, used = no + 1, n
        else:
            used += n
        out.append(no)
    return out


@pytest.mark.parametrize("block", [100, 137, 400, 1 << 20])
def test_fold_in_blocks(spark, many_parts, block):
    draw = random.Random(block)
    docs = {None: 3, 1: 1, 2: 700, 3: 40, 4: 12, 5: 300}
    sizes = {k: [draw.choice([1, 2, 5, 30, 60, 99, 100, 101, 150, 1000]) if k != 3 else 1 for _ in range(n)] for k, n in docs.items()}
    sizes[4] = [5000] * 12
    sizes[5] = [draw.randint(90, 110) for _ in range(300)]
    rows = [(k, 3 * i + 1, n) for k, s in sizes.items() for i, n in enumerate(s)]
    draw.shuffle(rows)
    found = {(r.doc_id, r.para_no): r.chunk_no for r in long_documents.fold(spark.createDataFrame(rows, "doc_id int, para_no int, n int"), 100, block).collect()}
    want = {(k, 3 * i + 1): no for k, s in sizes.items() for i, no in enumerate(folded(s, 100))}
    assert found == want
    assert long_documents.fold(spark.createDataFrame([], "doc_id int, para_no int, n int"), 100, block).collect() == []


def test_sections_equal_those_made_in_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = long_documents.sections(paragraphs(docs), LATIN, most=700, block=1500)
    want = S.sections(docs, LATIN, max_chars=700).select("doc_id", "chunk_no", "start_para", "end_para", F.size("paras").alias("n"), "raw_chars")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_document_of_a_million_paragraphs(spark):
    n = 1_000_000
    rows = spark.range(1, n + 1).select(F.lit(1).alias("doc_id"), F.col("id").alias("para_no"), (F.pmod(F.xxhash64("id"), F.lit(400)) + 1).alias("n"))
    out = long_documents.fold(rows, 3600)
    sizes = [r.n for r in rows.orderBy("para_no").collect()]
    want = folded(sizes, 3600)
    counts = [0] * (want[-1] + 1)
    for c in want:
        counts[c] += 1
    found = {r.chunk_no: (r["count"], r.first) for r in out.groupBy("chunk_no").agg(F.count("*").alias("count"), F.min("para_no").alias("first")).collect()}
    begins = {c: i + 1 for i, c in reversed(list(enumerate(want)))}
    assert found == {c: (counts[c], begins[c]) for c in range(1, want[-1] + 1)}
