"""Operator 13: fill-in-the-middle texts; units are found in the bytes of UTF-8, eight at a time in a 64-bit word."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table

SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")
LOW, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
ONE, BYTE = np.uint64(1), np.uint64(8)


def words_of(data: bytes) -> np.ndarray:
    """Bytes as little-endian words, with zeros up to one word more than they fill."""
    return np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")


def equal_to(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of each byte that has this value; no carry leaves a byte."""
    other = words ^ np.uint64(byte * 0x0101010101010101)
    return ~(((other & LOW) + LOW) | other) & HIGH


def begins_character(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that isn't 10xxxxxx."""
    return (~words | (words << ONE)) & HIGH


class Marks:
    """Marked bytes: high bits in words, and how many there are before each word."""

    def __init__(self, mask: np.ndarray):
        self.mask = mask
        self.upto = np.cumsum(np.bitwise_count(mask), dtype=np.int64)
        self.before = np.concatenate(([0], self.upto[:-1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each of these places."""
        below = (ONE << (BYTE * (at & 7).astype(np.uint64))) - ONE
        return self.before[at >> 3] + np.bitwise_count(self.mask[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte (from 0): a search for its word, then lower marks of this are cleared."""
        word = np.searchsorted(self.upto, k, "right")
        mask, more = self.mask[word].copy(), k - self.before[word]
        for _ in range(7):
            mask = np.where(more > 0, mask & (mask - ONE), mask)
            more = more - 1
        return (word << 3) + (np.bitwise_count((mask & (~mask + ONE)) - ONE) >> 3)


def unit_ends(words: np.ndarray, unit: str) -> Marks:
    """Marks of the bytes that end a unit; a text's last unit may lack one."""
    if unit == "line":
        return Marks(equal_to(words, 0x0A))
    begins = begins_character(words)
    return Marks((begins >> BYTE) | (np.append(begins[1:], np.uint64(0)) << np.uint64(56)))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: Sequence[str] = SENTINELS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n (units of the text), form, prefix_chars, middle_chars (code points, null if plain) and output.

    A text is cut at two places between units, both drawn evenly by the hash of seed and key: psm gives prefix, suffix,
    middle, each after its sentinel; spm suffix, prefix, middle; `percent` of the texts are changed, `spm_percent` of these
    to spm. restored() gives back the text. Lines end with their line feed; the last may have none.

    A narrow map, no shuffle. Texts are cut in runs of about 1 MB and leave the worker run by run; a longer text is a run of
    its own. Null texts are empty; empty texts, and texts with a sentinel in them, are plain. A null key is hashed as empty.
    Repeated rows are cut alike, each gives a row; an empty table none. Columns other than key, text and `keep` aren't read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    first = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or not all(sentinels) or any(c in s[1:] for s in sentinels for c in first):
        raise ValueError("three different sentinels are needed, in which no first character comes again")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    rows = docs.select(*keep, F.col(text).alias("_text"), *drawn)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_text", *(f"_h{i}" for i in range(4)))) + ", n long, form string, prefix_chars long, middle_chars long, output string"
    marks = [s.encode() for s in sentinels]

    def work(batches):
        for batch in batches:
            texts = common.utf8(batch.column("_text"))
            hashes = [batch.column(f"_h{i}").to_numpy() for i in range(4)]
            for a, b in common.runs(texts):
                run = texts[a:b]
                h1, h2, h3, h4 = (h[a:b] for h in hashes)
                data = b"".join(run)
                base = np.zeros(len(run) + 1, np.int64)
                np.cumsum([len(t) for t in run], out=base[1:])
                begin, end = base[:-1], base[1:]
                words = words_of(data)
                ends, characters = unit_ends(words, unit), Marks(begins_character(words))
                before = ends.rank(begin)
                whole = ends.rank(end) - before
                open_end = (end > begin) & (ends.rank(end) == ends.rank(np.maximum(end - 1, begin)))
                n = whole + open_end

                def place(k):
                    """Where the k-th unit of each text ends (0: its begin)."""
                    out = np.where(k == 0, begin, end)
                    inside = (k > 0) & (k <= whole)
                    out[inside] = ends.select((before + k - 1)[inside]) + 1
                    return out

                x, y = h1 % (n + 1), h2 % (n + 1)
                low, high = place(np.minimum(x, y)), place(np.maximum(x, y))
                plain = np.array([not t or any(m in t for m in marks) for t in run], bool) | (h3 % 100 >= percent)
                spm = h4 % 100 < spm_percent
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                output = []
                for i, t in enumerate(run):
                    if plain[i]:
                        output.append(t)
                    else:
                        p, m, s = t[: low[i] - begin[i]], t[low[i] - begin[i] : high[i] - begin[i]], t[high[i] - begin[i] :]
                        output.append(b"".join((marks[1], s, marks[0], p, marks[2], m) if spm[i] else (marks[0], p, marks[1], s, marks[2], m)))
                at_low = characters.rank(low)
                counts = [pa.array(c, pa.int64(), mask=plain) for c in (at_low - characters.rank(begin), characters.rank(high) - at_low)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), *counts, pa.array(output, pa.binary()).cast(pa.string())], [*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(work, schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of, from output and form alone."""
    p, s, m = (F.lit(x) for x in sentinels)
    lead = F.when(form == "psm", p).otherwise(s)
    second = F.when(form == "psm", s).otherwise(p)
    rest = F.substr(output, F.length(lead) + 1)
    one = F.call_function("substring_index", rest, second, F.lit(1))
    rest = F.substr(rest, F.length(one) + F.length(second) + 1)
    two = F.call_function("substring_index", rest, m, F.lit(1))
    middle = F.substr(rest, F.length(two) + F.length(m) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM cut),
parts AS (SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(units[greatest(x, y) + 1:n], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 100 THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
