"""Operators 3 to 6 against the library, brute force and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import common, packing, substrings, suffixes, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, first=0):
    """Texts with the columns of documents, and columns whose names the operators use themselves."""
    rows = [(first + i, t, None, None, None, 7, "k", 1) if not isinstance(t, tuple) else (*t, None, None, None, 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    passage = " ".join(words[:60])
    return [
        None, "", " ", "a", "\n\n", passage, passage, f"before {passage} after", f"{passage} {passage}", " ".join(words), "  ".join(words[100:900]),
        "x " * 300, "x " * 120, "ab" * 400, "ab" * 150, "é" * 200, "naïve 日本語 текст 🙂 " * 30, "I'm you'll we've it's 'tis  don't\r\n\tend <|endoftext|> x<|endoftext|>",
        "1234567 3.14 ½ ²  　  x", "\x1c\x1d a\x1e b \x85 c", " ".join(words[40:95]), "\n".join(words[::7]),
    ]


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark, small):
    docs = frame(spark, odd_texts()).unionByName(spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], map(len, library([r.text for r in rows]))))
    got = token_counts.count_tokens(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len((r.text or "").encode()) for r in rows}


def test_token_counts_of_any_characters(spark):
    rng = random.Random(3)
    pool = [0x20, 0x27, 0x0A, 0x3000, 0x2028, 0x41, 0x73, 0x74, 0x31, 0x660, 0x2E, 0x1F600, 0x300, 0x4E00, 0xAD]
    texts = ["".join(chr(rng.choice(pool) if rng.random() < 0.7 else rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x370, 0xD7FF), rng.randrange(0xE000, 0x30000)])) for _ in range(rng.randrange(60))) for _ in range(1500)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in library(texts)]


def thue_morse(size, one, other):
    return "".join(other if bin(i).count("1") % 2 else one for i in range(size))


def regular_texts():
    """Strings for which polynomials modulo 2**64 are alike, as words and as letters."""
    texts = []
    for size in (512, 1024, 2048, 4096):
        for a, b in ("ae", "aq"):
            texts += [thue_morse(size, a, b), thue_morse(size, b, a), " ".join(thue_morse(size, a, b)), " ".join(thue_morse(size, b, a))]
    return texts


@pytest.mark.parametrize("buckets", [None, 50])
def test_pretokens_with_one_hash(spark, monkeypatch, buckets):
    texts = regular_texts() + odd_texts() * 2
    if buckets:
        spans = common.byte_spans
        monkeypatch.setattr(common, "byte_spans", lambda *x: spans(*x) % np.uint64(buckets))
    encoder = token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for part in (texts[:20], texts[20:]):
        part = [t or "" for t in part]
        assert [x.tolist() for x in encoder.ids(part)] == library(part)
        assert encoder.count(part).tolist() == [len(x) for x in library(part)]


def brute_words(rows, size=50):
    first = {}
    for i, t in rows:
        w = tuple(SPLIT.findall(t or ""))
        for k in range(len(w) - size + 1):
            key = w[k : k + size]
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        w = tuple(SPLIT.findall(t or ""))
        gone = set()
        for k in range(len(w) - size + 1):
            if first[w[k : k + size]] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("split", [substrings.SPLIT, 1])
def test_repeated_passages(spark, split):
    rng = random.Random(8)
    texts = [t for t in odd_texts()] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)]
    shared = [" ".join(f"p{k}_{j}" for j in range(rng.randrange(45, 75))) for k in range(5)]
    for _ in range(60):
        texts.append(" ".join([*(f"u{rng.random()}" for _ in range(rng.randrange(30))), rng.choice(shared), *(f"u{rng.random()}" for _ in range(rng.randrange(30)))]))
    docs = frame(spark, texts)
    out = substrings.remove_repeats(docs, split=split).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("k")).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_words(list(enumerate(texts)))
    assert len(out) == len(texts)


def test_nothing_is_found_without_the_index(spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(70))
    docs = frame(spark, [passage + " end", "start " + passage, passage + " " + passage + " x"])
    assert [r.n_removed for r in substrings.remove_repeats(docs).orderBy("doc_id").collect()] == [0, 70, 140]
    index = substrings.index
    monkeypatch.setattr(substrings, "index", lambda found: index(found.where("not block")))
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0, 0]


def test_a_passage_many_times_in_one_text(spark):
    """A document gives each of its passages once, wherever it stands."""
    line = " ".join(f"w{i}" for i in range(55))
    docs = frame(spark, [line + " a", " ".join([line] * 400), " ".join([line, "x"] * 30)])
    words = substrings.windows(docs.select("doc_id", "text").join(substrings.probes(docs).groupBy("doc_id").agg(F.collect_list("h").alias("found"), F.collect_list(F.lit(-2).cast("long")).alias("often")), "doc_id"))
    assert words.groupBy("w", "doc_id").count().where("count > 1").count() == 0
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert out == {i: v[:2] for i, v in brute_words(rows).items()}


def test_repeated_passages_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r[0]: (r[1], r[2], r[3]) for r in substrings.op4_substring_dedup(spark, small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()])


def brute_bytes(rows, size=100):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in sorted(texts):
        for k in range(len(t) - size + 1):
            first.setdefault(t[k : k + size], (i, k))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if first[t[k : k + size]] < (i, k):
                gone[k : k + size] = b"\x01" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group, split", [(suffixes.GROUP, suffixes.SPLIT), (5, 3)])
def test_repeated_bytes(spark, group, split):
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(90, 160))) for _ in range(6)]
    texts = odd_texts() + ["".join([*(rng.choice("xyz ") for _ in range(rng.randrange(80))), rng.choice(shared), *(rng.choice("xyz ") for _ in range(rng.randrange(80))), rng.choice(shared)]) for _ in range(80)]
    docs = frame(spark, texts)
    out = suffixes.remove_repeats(docs, group=group, split=split).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("k")).collect()
    got, want = {r[0]: tuple(r[1:]) for r in out}, brute_bytes(list(enumerate(texts)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len(out) == len(texts)


def common_phrase(rng, size, n):
    """Texts with one phrase and other text around it; some of them are copied with all or a part of what is around."""
    phrase = "".join(rng.choice("abcdefghij") for _ in range(size))
    around = lambda: "".join(rng.choice("klmnopqrs ") for _ in range(rng.randrange(70, 120)))
    texts = [around() + phrase + around() for _ in range(n)]
    return texts + [t[60:-20] for t in texts[:9]] + texts[20:24] + [around() + phrase + t.split(phrase)[1] for t in texts[30:36]]


@pytest.mark.parametrize("size", [40, 99])
def test_a_common_phrase_with_other_text_around_it(spark, monkeypatch, size):
    texts = common_phrase(random.Random(size), size, 300)
    judge = suffixes.judge

    def watched(key, group):
        assert group.num_rows < 150
        return judge(key, group)

    monkeypatch.setattr(suffixes, "judge", watched)
    docs = frame(spark, texts)
    out = suffixes.remove_repeats(docs, group=20, split=40).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("k")).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_bytes(list(enumerate(texts)))


def test_repeated_bytes_of_a_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("k")).collect()}
    assert got == brute_bytes(rows)


def check_packing(rows, pieces, length=1024):
    ids = dict(zip([i for i, _ in rows], ([*x, 0] for x in library([t for _, t in rows]))))
    own, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        held[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in part)) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
    assert set(own) == set(ids)
    for i, found in own.items():
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    for found in held.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(held), sum(map(len, ids.values()))


def test_packing_round_trip(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    sequences, tokens = check_packing(rows, packing.op6_pack(spark, small).collect())
    assert sequences * 1024 <= 1.05 * tokens + 4096


def test_packing_of_odd_texts(spark):
    texts = odd_texts() * 3 + ["same words here"] * 500
    rows = list(enumerate(texts))
    sequences, tokens = check_packing(rows, packing.pack(frame(spark, texts)).collect())
    assert sequences * 1024 <= 1.1 * tokens + 4096


def test_repeated_rows_and_missing_ids(spark):
    passage = " ".join(f"word{i}" for i in range(70))
    rows = [(1, passage), (1, passage), (None, passage), (2, passage), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 70)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(docs).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(passage))]
    several = docs.unionByName(spark.createDataFrame([(2, "short"), (2, passage[:-100] + " and more")], docs.schema))
    for f in (substrings.remove_repeats, suffixes.remove_repeats):
        assert f(several).count() == 7
    assert token_counts.count_tokens(docs).count() == 5
    assert packing.pack(docs).count() == 5


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")]).where("doc_id < 0")
    for f in (token_counts.count_tokens, substrings.remove_repeats, suffixes.remove_repeats, packing.pack):
        assert f(docs).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"{rng.randrange(10**6)}" for _ in range(300_000))
    docs = frame(spark, [long, long[1_000_000:1_000_600], "head " + long])
    assert [r.n_tokens for r in token_counts.count_tokens(docs).orderBy("doc_id").collect()] == [len(x) for x in library([long, long[1_000_000:1_000_600], "head " + long])]
    out = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect()}
    assert out[0][1] == 0 and out[1] == (600, 600) and out[2][1] == len(long)
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert words[0][1] == 0 and words[2] == (300_001, 300_000)
