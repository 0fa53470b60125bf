"""Text expressions: trimming, cleaning by a rule pack, noise, titles, scores, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.html import html_text
from scriptorium.plans.rules import BLANKS, NOT_ASCII, NOT_INK, NOT_LATER, WS, RulePack


def quoted(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[.!?;" else c for c in chars) + "]"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.trim(c, F.lit(BLANKS))


def is_timestamp(c: Column, pack: RulePack) -> Column:
    """The whole text is `speaker HH:MM:SS`."""
    return c.rlike(rf"\A(?:{pack.timestamp})\z")


def clean(c: Column, pack: RulePack) -> Column:
    """The pack's cleaning rules, in order, without noise marking."""
    c = F.regexp_replace(c, rf"\A{pack.timestamp}{WS}*", "")
    c = reduce(lambda x, rule: F.regexp_replace(x, *rule), pack.clean, c)
    c = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), pack.replacements, c)
    beyond = NOT_ASCII if min(pack.terminators) > "~" else ""
    c = F.regexp_replace(c, rf"{beyond}({quoted(pack.terminators)})\1+", "$1")
    comma = "，" if "，" in pack.trim else ","
    c = F.regexp_replace(c, rf"[，,]{WS}*[，,]+", comma)
    return F.trim(c, F.lit(pack.trim))


def is_noise(c: Column, pack: RulePack) -> Column:
    """Long, with hardly any sentence ends and very many of one character: what speech recognition makes of noise."""
    longer, ends, chars = pack.noise
    return (F.length(c) > longer) & (F.regexp_count(c, F.lit(quoted(pack.noise_terminators))) <= ends) & (F.length(c) - F.length(F.replace(c, F.lit(pack.noise_char), F.lit(""))) > chars)


def mark_noise(c: Column, pack: RulePack) -> Column:
    return F.when(is_noise(c, pack), F.concat(F.lit(pack.noise_marker), F.substring(c, 1, pack.noise_cut), F.lit("..."))).otherwise(c)


def cleaned(c: Column, pack: RulePack) -> Column:
    """clean() and mark_noise(): the cleaning is bound, as marking reads it several times and would repeat it each time."""
    return F.transform(F.array(clean(c, pack)), lambda x: mark_noise(x, pack))[0]


def marked(c: Column, pack: RulePack) -> Column:
    """Begins with the noise marker."""
    return c.startswith(pack.noise_marker[:5])


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (c.contains(w) for w in words))


def title(c: Column, number: Column, pack: RulePack) -> Column:
    """The first of the pack's titles whose rule holds, else a numbered one."""
    out = None
    for rule in pack.titles:
        holds = reduce(lambda x, y: x & y, (contains_any(c, g) for g in rule.groups))
        out = F.when(holds, rule.title) if out is None else out.when(holds, rule.title)
    numbered = F.concat(F.lit(pack.untitled), number.cast("string"))
    return numbered if out is None else out.otherwise(numbered)


def word_score(c: Column, words: tuple[str, ...]) -> Column:
    """Two for each distinct word that occurs."""
    return F.lit(2) * reduce(lambda x, y: x + y, (c.contains(w).cast("int") for w in words))


def study_score(c: Column, pack: RulePack) -> Column:
    low, high = pack.study_band
    return word_score(c, pack.study_words) + F.length(c).between(low, high).cast("int") - pack.noise_penalty[0] * marked(c, pack).cast("int")


def digest_score(c: Column, position: Column, pack: RulePack) -> Column:
    low, high = pack.digest_band
    return word_score(c, pack.digest_words) + 2 * F.length(c).between(low, high).cast("int") + (position <= pack.early).cast("int") - pack.noise_penalty[1] * marked(c, pack).cast("int")


#: Characters that HTML text escapes, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def rendered_length(c: Column) -> Column:
    """html_text_length of HTML that this library has rendered: plain tags, and html_escape()'s references alone; each of these
    is a character, and texts hold no tags."""
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), WS + "+", "")
    return F.length(F.regexp_replace(c, "&(?:amp|lt|gt|quot|#x27);", "&"))


def inked(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), f"{NOT_INK}{NOT_LATER}{WS}+", ""))


def html_text_length(c: Column) -> Column:
    """Characters of HTML's text that aren't white space."""
    return F.length(F.regexp_replace(html_text(c), WS + "+", ""))


def inject_after_meta(html: Column, block: Column, chunk_ids: tuple[str, ...], mark: str) -> Column:
    """Puts a block after the first line of the first of these sections that exists, else before everything; once only."""
    out = F.concat(block, html)
    for chunk_id in reversed(chunk_ids):
        pattern = f'(?s)(<section class="long-section" id="{chunk_id}">.*?<p class="chunk-meta">.*?</p>)'
        text = F.regexp_replace(block, r"([\\$])", r"\\$1")
        out = F.when(html.rlike(pattern), F.regexp_replace(html, F.lit(pattern), F.concat(F.lit("$1"), text))).otherwise(out)
    return F.when(html.contains(mark) | (F.length(html) == 0) | html.isNull(), html).otherwise(out)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def ten_thousands(c: Column) -> Column:
    """In ten-thousands, to two decimals of the quotient as a double: 0.145 is a little less than it looks, and gives 0.14."""
    return F.round(c / 10000 * 100) / 100


def format_chars(c: Column, large: str = " 万字", small: str = " 字") -> Column:
    """From 10000 on in ten-thousands with two decimals, below in hundreds, at least 1."""
    return F.when(c >= 10000, F.concat(F.format_string("%.2f", F.round(c / 10000, 2)), F.lit(large))).otherwise(F.concat(F.greatest(F.lit(1), (F.round(c / 100) * 100).cast("long")).cast("string"), F.lit(small)))


def compression(chars: Column, raw: Column, about: str = "约 ") -> Column:
    """Share of the raw length in per cent; empty where there is no raw text."""
    return F.when(F.coalesce(raw, F.lit(0)) == 0, "").otherwise(F.concat(F.lit(about), F.round(chars / raw * 100).cast("long").cast("string"), F.lit("%")))
