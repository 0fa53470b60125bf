"""What Python workers take for texts: few of them at a time, however many a batch has."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import common, minhash, packing, pretoken, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MB = 1 << 20


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def worker(spark, operator):
    """The function that `operator` gives to mapInArrow."""
    found = []

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def __getattr__(self, name):
            return lambda *x, **y: self

        def mapInArrow(self, work, schema):
            found.append(work)
            return self

    operator(Rows())
    return found[0]


def batch(texts):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "pick": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


OPERATORS = {
    "packing": lambda docs: packing.cut_documents(docs, PATH),
    "counts": lambda docs: token_counts.count_tokens(docs, path=PATH),
    "lists": minhash.element_lists,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_batch_is_taken_in_slices(spark, name):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(5000)]  # 24 MB
    rows = batch(texts)
    work = worker(spark, OPERATORS[name])
    common.powers(1 << 17)
    next(iter(work(iter([batch(texts[:1])]))))  # what is made once
    count, most = peak(lambda: sum(out.num_rows for out in work(iter([rows]))))
    assert count >= len(texts) and most < 60 * MB


def test_slices_have_all_rows():
    texts = ["a" * 10, None, "", "ä" * 40, "b" * 200, "c", None]
    whole = batch(texts)
    parts = list(common.slices([whole.slice(0, 0), whole, whole.slice(2, 3)], 64))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts + texts[2:5]
    assert [p.num_rows for p in parts] == [3, 1, 1, 2, 1, 1, 1]
    assert list(common.slices([])) == []


def test_character_classes_are_no_objects():
    found, most = peak(pretoken.classes.__wrapped__)
    assert (found == pretoken.classes()).all() and most < 40 * MB


def test_remembered_pretokens(monkeypatch):
    """Known, new, forgotten and colliding pre-tokens, in several runs."""
    monkeypatch.setattr(token_counts, "REMEMBERED", 300)
    spans = common.byte_spans
    monkeypatch.setattr(common, "byte_spans", lambda *x: spans(*x) % np.uint64(900))
    rng = random.Random(5)
    library, encoder = Tokenizer.from_file(PATH), token_counts.Encoder(PATH)
    sizes = []
    for _ in range(40):
        texts = ["".join(rng.choice("abcde  ") for _ in range(rng.randrange(120))) for _ in range(rng.randrange(6))]
        assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert (np.diff(encoder.known.astype(object)) > 0).all()
        sizes.append(len(encoder.known))
    assert min(np.diff(sizes)) < 0
