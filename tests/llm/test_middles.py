"""Operator 13 against a plain version."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium import llm
from scriptorium.llm import middles


def plain(doc_id, text, unit="line", percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), out[0], len(p), len(m), out[1]


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "no end\nof line", "é\n漢字\n😀\r\nx", "<P>\n", "x<S>y", "<\nP>\n<S", "> <P\n>", "\x00\n\x00", "a b\nc", "ਊஊ\nĊ", "line\n" * 3000, "w" * 3_000_000 + "\n" + "漢" * 500_000]


@pytest.mark.parametrize(("unit", "percent", "spm"), [("line", 100, 50), ("char", 60, 20)])
def test_outputs_and_what_is_restored(spark, unit, percent, spm):
    rows = [(i if i % 7 else None, t, i, "z", "q") for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, form string, output string").repartition(3)
    out = middles.fill_in_middle(docs, unit=unit, percent=percent, spm_percent=spm, keep=("doc_id", "row"))
    found = {r.row: r for r in out.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()}
    assert len(found) == len(rows)
    for doc_id, text, row, _, _ in rows:
        r = found[row]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(doc_id, text, unit, percent, spm)
        assert r.back == (text or "")
    assert {"psm", "spm", "plain"} <= {r.form for r in found.values()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="\n\u000b\u008aĊaé漢😀", max_size=40), max_size=5))
def test_marks(texts):
    data = "".join(texts).encode()
    words = middles.words_of(data)
    for marks, want in ((middles.unit_ends(words, "line"), [i for i, b in enumerate(data) if b == 10]), (middles.Marks(middles.begins_character(words)), [i for i, b in enumerate(data) if b & 0xC0 != 0x80])):
        at = np.arange(len(data) + 1)
        assert marks.rank(at).tolist() == [sum(w < i for w in want) for i in at]
        if want:
            assert marks.select(np.arange(len(want))).tolist() == want


def test_sentinels_must_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            middles.fill_in_middle(docs, sentinels=bad)
    assert middles.fill_in_middle(docs.where("false")).collect() == []


def test_query_equals_plain_version(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r.doc_id, *(x := plain(r.doc_id, r.text))[:4], sha(x[4]), sha(r.text or "")) for r in rows)
    got = llm.QUERIES["op13_fill_in_middle"](spark, small).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, got)) == want
