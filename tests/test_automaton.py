"""Words found by the automaton against searching for each."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.functions import automaton as A
from scriptorium.plans.rules import LECTURE_CLASSICAL, LECTURE_ESSAY


def times(text, word):
    return sum(text.startswith(word, i) for i in range(len(text))) if word else 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé漢", max_size=5), max_size=8), st.lists(st.text(alphabet="abcé漢\x00", max_size=60), max_size=6))
def test_every_occurrence(words, texts):
    look = A.Automaton(words)
    who, which = look.find([t.encode() for t in texts])
    found: dict = {}
    for t, w in zip(who.tolist(), which.tolist()):
        found[t, w] = found.get((t, w), 0) + 1
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    want = {(i, k): n for i, t in enumerate(texts) for w, k in first.items() if (n := times(t, w))}
    assert found == want


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_words_across_lanes_and_long_texts(spark, monkeypatch, lane):
    monkeypatch.setattr(A, "LANE", lane)
    draw = random.Random(lane)
    words = ["".join(draw.choices("ab", k=draw.randint(1, 9))) for _ in range(60)] + ["", "ab", "ab"]
    texts = ["".join(draw.choices("abc", k=draw.randint(0, 300))) for _ in range(200)]
    look = A.Automaton(words)
    found: dict = {}
    for t, w in zip(*(x.tolist() for x in look.find([t.encode() for t in texts]))):
        found[t, w] = found.get((t, w), 0) + 1
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    assert found == {(i, k): n for i, t in enumerate(texts) for w, k in first.items() if (n := times(t, w))}


def test_with_words(spark):
    words = list(LECTURE_CLASSICAL.study_words + LECTURE_ESSAY.digest_words) + ["一重", "重点所", "点"]
    texts = [None, "", "第一重点所以说明意味着", "x" * 3_000_000 + "重点", "母亲父亲\n祖母" * 3]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, text string, found string, word int").repartition(3)
    got = {r.id: {x.word: x.times for x in r.found} for r in A.with_words(rows, "text", words).collect()}
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    assert got == {i: {k: n for w, k in first.items() if (n := (t or "").count(w))} for i, t in enumerate(texts)}
    assert A.with_words(rows.where("false"), "text", words).collect() == []
    assert all(r.found == [] for r in A.with_words(rows, "text", []).collect())


def test_ten_thousand_words_take_little_more_than_thirty():
    draw = random.Random(2)
    letters = "etaoinshrdlu"
    words = list({"".join(draw.choices(letters, k=draw.randint(5, 10))) for _ in range(10_000)})
    texts = ["".join(draw.choices(letters + " ", k=2000)).encode() for _ in range(500)]
    spent = []
    for many in (30, len(words)):
        look = A.Automaton(words[:many])
        began = time.process_time()
        for _ in range(3):
            look.find(texts)
        spent.append(time.process_time() - began)
    assert spent[1] < 4 * spent[0]
