"""Stages of the pipeline on small tables."""

import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture
def labels(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_mixing_of_rows_without_doc_id_and_of_one_doc_id(spark, labels):
    text = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(i, text(f"d{i}_", 20 + i), "abc"[i % 3]) for i in range(12)]
    rows += [(None, text(f"n{i}_", 30 + i), "abc"[i % 3]) for i in range(6)] + [(7, text("long", 90), "b"), (7, text("short", 10), "b"), (None, None, "b")]
    docs = frame(spark, rows)
    out = corpus_pipeline.mixed(spark, docs, labels).collect()
    target = {r.source: r.target for r in mixing.mix_sources(docs, spark.read.parquet(f"{labels}/labels.parquet"), keep=("source",)).collect()}
    words, times, short = Counter(), Counter(), Counter()
    for r in out:
        words[r.source] += len(r.text.split())
        (whole,) = [t for i, t, s in rows if t and i == r.doc_id and s == r.source and (t + " ").startswith(r.text + " ")]
        assert r.n_chars == len(r.text)
        times[whole] += 1
        short[r.source] += r.text != whole
    assert all(abs(words[s] - target[s]) <= 1 for s in target)
    assert max(times.values()) <= mixing.REPEATS and max(short.values()) <= 1
    assert {r.source for r in out if r.doc_id is None} == set("abc")
    assert corpus_pipeline.mixed(spark, docs.where("doc_id < 0"), labels).count() == 0


EXTRA = SCHEMA + ", h long, key string, rep long, size long, n long, keep string"


def odd_documents(spark):
    """Near copies, repeats, rows without id or text, a repeated row, and columns whose names the stages use themselves."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(base)), (4, " ".join(word() for _ in range(80))), (5, " ".join([word() for _ in range(90)] + passage)), (6, " ".join(passage + [word() for _ in range(90)]))]
    rows += [(7, None), (8, ""), (None, "a text without id"), (None, None), (9, "twice the same row"), (9, "twice the same row"), (10, " ".join(passage))]
    rows += [(20 + i, " ".join(word() for _ in range(30 + i))) for i in range(30)]
    return rows, spark.createDataFrame([(i, t, "en" if i else None, None if i and i % 5 == 0 else "abc"[(i or 0) % 3], len(t or ""), 1, "k", 2, 3, 4, "x") for i, t in rows], EXTRA)


def test_stages_on_odd_documents(spark, labels):
    rows, docs = odd_documents(spark)
    count = lambda found: Counter((r.doc_id, r.text) for r in found)
    judged = corpus_pipeline.good_quality(spark, docs, labels).collect()
    assert count(judged) == Counter(rows)  # two labels teach nothing, so nothing is rejected
    unique = corpus_pipeline.one_of_each_class(spark, docs, labels)
    left = [(i, t) for i, t in rows if i not in (2, 3)]
    assert count(unique.collect()) == Counter(left) and tuple(unique.columns) == corpus_pipeline.COLUMNS
    cut = corpus_pipeline.without_repeats(spark, unique.withColumn("places", F.lit(1)), labels).collect()
    want = dict(left) | {6: " ".join(dict(left)[6].split()[60:])}
    assert count(cut) == Counter((i, want[i] if i else t) for i, t in left if i != 10)
    assert all(r.n_chars == len(r.text or "") for r in cut)
    pieces = corpus_pipeline.packed(spark, docs, labels).collect()
    sizes = Counter()
    for r in pieces:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024 and sum(r.doc_id is None for r in pieces) == 2
    assert sum(sizes.values()) == sum(len(library(t)) + 1 for _, t in rows)


def library(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, labels, name, stage):
    docs = odd_documents(spark)[1].where("doc_id < 0")
    out = stage(spark, docs, labels)
    assert out.count() == 0
    assert name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS


def test_the_whole_run_is_its_stages(spark, labels):
    _, docs = odd_documents(spark)
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{labels}/documents.parquet")
    pieces = corpus_pipeline.run(spark, labels).collect()
    kept = {r.doc_id for r in corpus_pipeline.without_repeats(spark, corpus_pipeline.one_of_each_class(spark, docs, labels), labels).collect()}
    found = {r.doc_id for r in pieces}
    assert found <= kept and {1, None} <= found and not {2, 3, 10} & found
