"""Operator 12: secrets in texts; strings of which a token covers few characters are random."""

from __future__ import annotations

import base64
import re
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Kinds of spans, in their order.
KINDS = ("assign", "access", "hex", "random")
#: A random string has so many characters, fewer than RATIO for a token, so many in parts that mix letters with digits, and so
#: many different ones.
SHORTEST, RATIO, MIXED, DIFFERENT = 20, 2.0, 16, 8
#: Tokens are counted by pieces of so many characters.
PIECE = 1024

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Digests in hexadecimal digits, by their lengths (32 to 128), or in base64 after their algorithm; UUIDs.
_DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}|sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+=*|md5-[A-Za-z0-9+/]+=*)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_PART, _LETTER, _DIGIT = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def patterns(text: str) -> list[tuple[int, int, int]]:
    """Spans (begin, kind, end) that patterns of fixed shape find."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def identifies(s: str) -> bool:
    """A digest, a UUID, filling, or a name: words and numbers joined, without enough of what mixes letters and digits."""
    if _DIGEST.match(s) or len(set(s)) < DIFFERENT:
        return True
    rest = _UUID.sub("", s)
    return sum(len(p) for p in _PART.findall(rest) if len(p) > 5 and _LETTER.search(p) and _DIGIT.search(p)) < MIXED


def per_token(s: str, path: str) -> float:
    """Characters for a token."""
    encode = encoding(path).encode_ordinary
    return len(s) / sum(len(encode(s[a : a + PIECE])) for a in range(0, len(s), PIECE))


def random_strings(text: str, taken: list[tuple[int, int, int]], path: str, ratio: float = RATIO) -> list[tuple[int, int, int, float]]:
    """Spans of random strings that meet none of those taken, with their characters for a token."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s, begin, end = m[0], m.start(), m.end()
        if not identifies(s) and all(b >= end or e <= begin for b, _, e in taken) and (value := per_token(s, path)) < ratio:
            out.append((begin, 3, end, value))
    return out


def find_secrets(docs: DataFrame, text: str = "text", path: str | None = None, ratio: float = RATIO, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and spans: array of (kind, begin, end, chars_per_token), in code points, by begin and kind.

    assign, access and hex are what patterns of fixed shape find, leftmost and without overlaps within each kind. random:
    runs of letters, digits and +/_=- of SHORTEST characters or more, of which a token of the vocabulary covers fewer than
    `ratio` characters, but for digests, UUIDs and names (see identifies); those that meet a span of another kind are left out.

    A narrow map of whole texts, no shuffle; only candidates are encoded, in pieces of PIECE characters, so that very long
    runs take linear time. Null and empty texts have no spans. Repeated rows give a row each, an empty table none. Columns
    other than `text` and `keep` aren't read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    span = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("chars_per_token", pa.float64())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", spans array<struct<kind:string,begin:long,end:long,chars_per_token:double>>"

    def work(batches):
        for batch in batches:
            out = []
            for t in batch.column("_text").to_pylist():
                base = patterns(t) if t else []
                more = random_strings(t, base, path, ratio) if t else []
                out.append([{"kind": KINDS[k], "begin": b, "end": e, "chars_per_token": v[0] if v else None} for b, k, e, *v in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.list_(span))], [*keep, "spans"])

    return rows.mapInArrow(work, schema)


def written(spans: Column) -> Column:
    """kind:begin:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["begin"] - state["at"], F.lit(0)).cast("int"))
        tag = F.when(s["begin"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["done"], gap, tag).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda x: F.concat(x["done"], F.substr(text, (x["at"] + 1).cast("int"))))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = written(F.filter("spans", lambda s: s["kind"] != "random"))
    return out.select("doc_id", *map(many, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
