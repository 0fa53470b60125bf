"""HTML as the tokenizer of its standard reads it: text of any page, and an index of elements, nested ones too."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content; those whose content is text up to their own end tag, without and with entities;
# start tags that end an open element of a kind; code points that stand for others in numeric references.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW, ESCAPABLE = ("script", "style", "xmp", "iframe", "noembed", "noframes"), ("title", "textarea")
BLOCKS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
)
IMPLIED = {"p": BLOCKS, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option", "optgroup"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr")}
BARRIERS = ("ul", "ol", "dl", "table", "select", "td", "th", "div", "section", "article", "body", "html")
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"

_S = r"\t\n\f\r "
#: What follows a tag's name: attributes, whose quoted values may hold anything. Possessive, so no input makes it backtrack.
_VALUE = rf"""[{_S}]*+=[{_S}]*+(?:"[^"]*+"|'[^']*+'|[^{_S}>"'][^{_S}>]*+|(?=>))"""
_REST = rf"""(?:[{_S}/]*+[^{_S}/>][^{_S}/>=]*+(?:{_VALUE}|(?![{_S}]*=)))*+[{_S}/]*+>"""
_TAG = rf"</?[A-Za-z][^{_S}/>]*+{_REST}"
_COMMENT = r"<!---?>|<!--.*?(?:--!?>|\z)"
#: Declarations, instructions and end tags without a name count as comments; a tag that isn't closed takes all that follows.
_OTHER = r"<[!?][^>]*+(?:>|\z)|</[^A-Za-z>][^>]*+(?:>|\z)|</>|</?[A-Za-z].*"
_LONG = "|".join(rf"<{name}(?=[{_S}/>]){_REST}.*?(?=</{name}[{_S}/>]|\z)" for name in RAW + ESCAPABLE)
MARKUP = rf"(?s){_COMMENT}|{_TAG}|{_OTHER}"
TOKENS = rf"(?si){_COMMENT}|{_LONG}|{_TAG}|{_OTHER}|[^<]++|<"
_HOLDS_TEXT = rf"(?i)<(?:{'|'.join(RAW + ESCAPABLE)})[{_S}/>]"
_REFERENCES = r"&(?:#[xX][0-9a-fA-F]++;?+|#[0-9]++;?+|[A-Za-z][A-Za-z0-9]*+;?+)|[^&]++|&"


@cache
def _names() -> tuple[str, str]:
    """Character references with semicolon, by first letter, as JSON; a pattern for those that need none, longest first."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    short = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(by_letter), f"^(?:{'|'.join(short)})"


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number in digits: what can't be one is U+FFFD."""
    number = F.conv(F.regexp_replace(digits, "^0+(?=.)", ""), base, 10)
    code = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 7, F.lit(1 << 30)).otherwise(number.cast("int"))
    odd = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    old = F.substring(F.lit(WINDOWS_1252), (code - 127).cast("int"), F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(odd, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
    return F.when(code.between(0x80, 0x9F), old).otherwise(plain)


def unescaped(c: Column) -> Column:
    """Text with its character references decoded: named ones, of which some need no semicolon, and numeric ones."""
    names, short = _names()
    table = F.from_json(F.lit(names), "map<string,map<string,string>>")

    def named(name: Column) -> Column:
        of = F.try_element_at(table, F.substring(name, 1, 1))
        known = F.regexp_extract(name, short, 0)
        prefix = F.when(known != "", F.concat(F.try_element_at(of, known), F.substr(name, F.length(known) + 1)))
        return F.coalesce(F.try_element_at(of, name), prefix, F.concat(F.lit("&"), name))

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
        number = F.when(piece.rlike("^&#[xX]"), _numbered(digits, 16)).otherwise(_numbered(digits, 10))
        return F.when(~piece.startswith("&") | (F.length(piece) == 1), piece).when(piece.startswith("&#"), number).otherwise(named(F.substr(piece, F.lit(2))))

    return F.when(c.contains("&"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCES), F.lit(0)), one), "")).otherwise(c)


def html_text(c: Column) -> Column:
    """The text of HTML as a browser has it (textContent): tags, comments and declarations go, references are decoded, and
    what stands in scripts and styles stays as it is. Null stays null.

    Pages without scripts and the like take one pass of a pattern; marks stay where tags were, so that no reference is put
    together from two texts. Others are split into tokens.
    """
    simple = F.replace(unescaped(F.regexp_replace(c, MARKUP, "\x00")), F.lit("\x00"), F.lit(""))
    start = F.lit(rf"(?s)^{_TAG}")
    raw, escapable = (rf"(?i)^<(?:{'|'.join(names)})[{_S}/>]" for names in (RAW, ESCAPABLE))

    def text(token: Column) -> Column:
        inner = F.regexp_replace(token, start, F.lit(""))
        return F.when(~token.startswith("<") | (F.length(token) == 1), unescaped(token)).when(token.rlike(raw), inner).when(token.rlike(escapable), unescaped(inner)).otherwise("")

    split = F.replace(F.array_join(F.transform(F.regexp_extract_all(c, F.lit(TOKENS), F.lit(0)), text), ""), F.lit("\x00"), F.lit(""))
    return F.when(c.rlike(_HOLDS_TEXT), split).otherwise(simple)


_TOKEN, _NAME = re.compile(TOKENS.replace(r"\z", r"\Z")), re.compile(rf"</?([A-Za-z][^{_S}/>]*)")
_ATTRIBUTE = re.compile(rf"""[{_S}/]*([^{_S}/>][^{_S}/>=]*)(?:[{_S}]*=[{_S}]*(?:"([^"]*)"|'([^']*)'|([^{_S}>"'][^{_S}>]*)|(?=>)))?""")
_START = re.compile(rf"(?s){_TAG}")


def _elements(html: str) -> Iterator[tuple[str, str | None, int, int, int]]:
    """(name, id, begin, end, depth) of each element: one pass with a stack of what is open."""
    stack: list[tuple[str, str | None, int]] = []

    def close(down_to: int, end: int):
        while len(stack) > down_to:
            name, own, begin = stack.pop()
            yield name, own, begin, end, len(stack)

    def open_one(names, barriers=()) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in barriers:
                return None
        return None

    for m in _TOKEN.finditer(html):
        token = m[0]
        tag = _NAME.match(token)
        if not tag or not (start := _START.match(token)):
            continue
        name = tag[1].lower()
        if token[1] == "/":
            if (at := open_one((name,))) is not None:
                yield from close(at + 1, m.start())
                yield from close(at, m.end())
            continue
        for old, by in IMPLIED.items():
            if name in by and (at := open_one((old,), BARRIERS)) is not None:
                yield from close(at, m.start())
        own = next((unescape(next((v for v in a.groups()[1:] if v is not None), "")) for a in _ATTRIBUTE.finditer(start[0], tag.end(), start.end() - 1) if a[1].lower() == "id"), None)
        if name in VOID:
            yield name, own, m.start(), m.end(), len(stack)
        else:
            stack.append((name, own, m.start()))
    yield from close(0, len(html))


def element_index(pages: DataFrame, key: str, html: str, identified: bool = True) -> DataFrame:
    """key, id, name, begin (from 0), end, depth: the interval of each element (of those with an id, unless told otherwise).

    An element ends with its end tag, or where a start tag or its parent's end implies it. A page is one task's work; ids may
    repeat. Null pages have no elements.
    """
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = sorted((b, d, e, n, own) for n, own, b, e, d in _elements(text or "") if own is not None or not identified)
                rows += found
                at += [i] * len(found)
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            begin, depth, end, name, own = (pa.array(c, k) for c, k in zip(columns, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), own, name, begin, end, depth], [key, "id", "name", "begin", "end", "depth"])

    return pages.select(key, html).mapInArrow(work, f"`{key}` {kind}, id string, name string, begin long, end long, depth long")


def elements_by_id(pages: DataFrame, key: str, html: str, ids: Column) -> DataFrame:
    """key, id, element: for each page and each of `ids` (an array), the HTML of the first element with that id, the whole page
    where there is none. One pass: a page is indexed once for all ids that are asked for. Null pages give nothing."""
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, asked, out = [], [], []
            for i, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if text is None or not wanted:
                    continue
                places: dict[str, tuple[int, int]] = {}
                for _, own, begin, end, _ in sorted(_elements(text), key=lambda e: (e[2], -e[3])):
                    if own is not None:
                        places.setdefault(own, (begin, end))
                for one in wanted:
                    begin, end = places.get(one, (0, len(text)))
                    at.append(i)
                    asked.append(one)
                    out.append(text[begin:end])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(asked, pa.string()), pa.array(out, pa.string())], [key, "id", "element"])

    return pages.select(key, F.col(html).alias("_html"), ids.alias("_ids")).mapInArrow(work, f"`{key}` {kind}, id string, element string")


def element_by_id(pages: DataFrame, asked: DataFrame, key: str, html: str) -> DataFrame:
    """As elements_by_id, for a table of what is asked (key, id); rows asked twice are answered twice."""
    wanted = asked.groupBy(key).agg(F.collect_list("id").alias("_wanted"))
    return elements_by_id(pages.join(wanted, key), key, html, F.col("_wanted"))
