"""Sentences of sections, scored; and what is selected from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans.rules import RulePack

KEYS = ("doc_id", "chunk_no")


def sentence_array(c: Column, pack: RulePack) -> Column:
    """Split after each terminator, trimmed; short pieces go."""
    ends = T.quoted(pack.terminators)
    pieces = F.regexp_extract_all(c, F.lit(f"[^{ends[1:]}*+{ends}|[^{ends[1:]}++"), F.lit(0))
    return F.filter(F.transform(pieces, T.strip), lambda s: F.length(s) >= pack.sentence)


def numbered(pack: RulePack) -> Column:
    """Of a section's row: array of (ord, in the section; position, in the paragraph after short ones are gone; sentence)."""
    of = lambda p: F.transform(sentence_array(p["text"], pack), lambda s, i: F.struct((i + 1).alias("position"), s.alias("sentence")))
    return F.transform(F.flatten(F.transform("paras", of)), lambda s, i: F.struct((i + 1).alias("ord"), s["position"].alias("position"), s["sentence"].alias("sentence")))


def sentences(sections: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, chunk_no, raw_chars, ord, position, sentence: a row for each sentence."""
    return sections.select(*KEYS, "raw_chars", F.inline(numbered(pack)))


def with_sentences(sections: DataFrame, pack: RulePack) -> DataFrame:
    """Sections with their sentences, and with what isn't noise among their paragraphs."""
    plain = F.transform(F.filter("paras", lambda p: ~T.marked(p["text"], pack)), lambda p: p["text"])
    return sections.withColumns({"sentences": numbered(pack), "plain": plain})


def _by_score(score) -> Column:
    """Sentences with a score, the best first (ties: text order), as array of (less, ord, sentence)."""
    scored = F.transform("sentences", lambda s: F.struct((-score(s)).alias("less"), s["ord"].alias("ord"), s["sentence"].alias("sentence")))
    return F.array_sort(F.filter(scored, lambda s: s["less"] < 0))


def study_array(pack: RulePack, limit: int) -> Column:
    """Of a row of with_sentences(): the best sentences, in the order of their scores.

    Of sentences with the same beginning, the first in that order stays. Where fewer than three are left, the beginnings
    of the section's paragraphs follow, but for noise.
    """
    best = _by_score(lambda s: T.study_score(s["sentence"], pack))
    head = lambda c: F.substring(c, 1, pack.prefix)
    fresh = lambda chosen, s: (F.size(chosen) < limit) & ~F.exists(chosen, lambda x: head(x) == head(s["sentence"]))
    chosen = F.aggregate(best, F.array().cast("array<string>"), lambda chosen, s: F.when(fresh(chosen, s), F.array_append(chosen, s["sentence"])).otherwise(chosen))
    least, cut = pack.fallback
    more = F.transform("plain", lambda p: F.substring(p, 1, cut))
    return F.transform(F.array(chosen), lambda c: F.when(F.size(c) < least, F.slice(F.concat(c, more), 1, limit)).otherwise(c))[0]


def outline_array(pack: RulePack) -> Column:
    """The first few study points, cut short."""
    return F.transform(study_array(pack, pack.outline_limit), lambda s: F.substring(s, 1, pack.outline_cut))


def digest_array(pack: RulePack) -> Column:
    """Of a row of with_sentences(): (ord, sentence) by score until a third of the section (and some least length) is reached.

    A sentence is taken while the total before it is below the target. A section without scored sentences gives whole
    paragraphs, but for noise, to the same rule; their ord counts paragraphs.
    """
    floor, percent = pack.budget
    target = F.greatest(F.lit(floor), F.floor(F.col("raw_chars") * percent / 100).cast("int"))
    best = F.transform(_by_score(lambda s: T.digest_score(s["sentence"], s["position"], pack)), lambda s: F.struct(s["ord"].alias("ord"), s["sentence"].alias("sentence")))
    whole = F.transform("plain", lambda p, i: F.struct((i + 1).alias("ord"), p.alias("sentence")))
    none = F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<ord:int,sentence:string>>").alias("taken"))
    take = lambda state, s: F.struct((state["total"] + F.length(s["sentence"])).alias("total"), F.array_append(state["taken"], s).alias("taken"))
    pick = lambda rows: F.aggregate(rows, none, lambda state, s: F.when(state["total"] < target, take(state, s)).otherwise(state))["taken"]
    return F.transform(F.array(best), lambda b: pick(F.when(F.size(b) > 0, b).otherwise(whole)))[0]


def group_array(digest: Column, pack: RulePack) -> Column:
    """A digest's sentences in text order, some to a paragraph, without separators."""
    ordered = F.transform(F.array_sort(digest), lambda s: s["sentence"])
    group = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0))), lambda i: (i % pack.group == 0) & (i < F.size(c))), lambda i: F.array_join(F.slice(c, i + 1, pack.group), ""))
    return F.transform(F.array(ordered), group)[0]


def _ranked(rows: DataFrame, points: Column) -> DataFrame:
    return rows.select(*KEYS, F.posexplode(points).alias("at", "sentence")).select(*KEYS, (F.col("at") + 1).alias("rank"), "sentence")


def study_points(sections: DataFrame, pack: RulePack, limit: int) -> DataFrame:
    """doc_id, chunk_no, rank, sentence: a row for each study point (see study_array). Nothing is shuffled."""
    return _ranked(with_sentences(sections, pack), study_array(pack, limit))


def outline_points(sections: DataFrame, pack: RulePack) -> DataFrame:
    return _ranked(with_sentences(sections, pack), outline_array(pack))


def digest_sentences(sections: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, chunk_no, ord, sentence: a row for each sentence of the digest (see digest_array). Nothing is shuffled."""
    return with_sentences(sections, pack).select(*KEYS, F.inline(digest_array(pack)))


def digest_groups(sections: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, chunk_no, group_no, text: a row for each paragraph of the digest."""
    rows = with_sentences(sections, pack).withColumn("digest", digest_array(pack))
    return rows.select(*KEYS, F.posexplode(group_array(F.col("digest"), pack)).alias("at", "text")).select(*KEYS, (F.col("at") + 1).alias("group_no"), "text")
