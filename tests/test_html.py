"""Text and elements of HTML against Python's parser, and against the standard's states written out."""

import random
import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import html as H
from scriptorium.functions import text as T
from scriptorium.operators import report
from scriptorium.operators import sections as S
from scriptorium.plans.rules import LATIN

SPACE = "\t\n\f\r "


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)


def parsed(page):
    p = Text()
    p.feed(page)
    p.close()
    return "".join(p.parts)


def by_states(page):
    """The tokenizer's states one character at a time: the text."""
    out, i, n, text = [], 0, len(page), []

    def flush():
        out.append(unescape("".join(text)))
        text.clear()

    while i < n:
        if page[i] != "<" or i + 1 == n or not re.match(r"[A-Za-z!?/]", page[i + 1]) or (page[i + 1] == "/" and i + 2 == n):
            text.append(page[i])
            i += 1
            continue
        flush()
        if page.startswith("<!--", i):
            if m := re.match("<!---?>", page[i:]):
                i += m.end()
            else:
                ends = [(at + len(e)) for e in ("-->", "--!>") if (at := page.find(e, i + 4)) >= 0]
                firsts = sorted((page.find(e, i + 4), len(e)) for e in ("-->", "--!>") if page.find(e, i + 4) >= 0)
                i = firsts[0][0] + firsts[0][1] if ends else n
            continue
        if page[i + 1] in "!?" or page[i + 1] == "/" and not page[i + 2].isalpha() or page[i + 1] == "/" and not page[i + 2].isascii():
            at = page.find(">", i)
            i = at + 1 if at >= 0 else n
            continue
        closing = page[i + 1] == "/"
        j = i + 1 + closing
        while j < n and page[j] not in SPACE + "/>":
            j += 1
        name, state = page[i + 1 + closing : j].lower(), "before"
        while j < n:
            c = page[j]
            if state == "before":
                if c == ">":
                    break
                if c not in SPACE + "/":
                    state = "name"
            elif state == "name":
                if c == ">":
                    break
                if c in SPACE:
                    state = "after"
                elif c == "/":
                    state = "before"
                elif c == "=":
                    state = "value"
            elif state == "after":
                if c == ">":
                    break
                if c == "=":
                    state = "value"
                elif c == "/":
                    state = "before"
                elif c not in SPACE:
                    state = "name"
            elif state == "value":
                if c in "\"'":
                    state = c
                elif c == ">":
                    break
                elif c not in SPACE:
                    state = "bare"
            elif state == "bare":
                if c == ">":
                    break
                if c in SPACE:
                    state = "before"
            elif c == state:
                state = "before"
            j += 1
        i = j + 1
        if j >= n:
            break
        if not closing and name in H.RAW + H.ESCAPABLE:
            m = re.compile(rf"</{name}[\t\n\f\r />]", re.I).search(page, i)
            content = page[i : m.start() if m else n]
            out.append(content if name in H.RAW else unescape(content))
            i = m.start() if m else n
    flush()
    return "".join(out).replace("\x00", "")


HARD = [
    "", "a", "<", "a<", "a < b", "<>", "</", "</>", "</ x>y", "<!>", "<!-->x", "<!--->x", "<!-- > -- -->x", "<!-- --!>x", "<!-- never", "<!doctype html>x", "<?php a > b ?>", "<b", "<b x=\"", "<a title=\"x>y\">t</a>", "<a title='x>\"y'>t",
    "<a b=c>d", "<a b=>c", "<a =\"b>c\">d", "<a \"b>c", "<a b = 'x>y' c>d", "<a b=c\"d>e", "<a/b='>'/>x", "<A\nB='>'\n>x", "<script>if (a<b) '</p>' &amp; </script>x&amp;", "<SCRIPT src='>'>1&lt;2</sCript >x", "<script>no end &amp;",
    "<title>a&amp;<b></title>&amp;", "<style>p>a{}</style>", "<scripty>a&amp;</scripty>b", "<textarea></textarea ></p>x", "&am<b>p;", "&amp", "&ampx", "&notit;", "&notin;", "&hellip", "&hellip;", "&nosuch;", "&", "&&amp;&", "&#65;", "&#65", "&#x41;", "&#X41g", "&#", "&#;", "&#x;",
    "&#128;&#x9f;&#129;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000000000065;", "&#x1F600;", "&NotEqualTilde;&acE;", "\x00a\x00", "漢<b>字</b>😀&copy", "<p>" * 2000, "<a " + "b='c' " * 5000 + ">x", "<a x='" + "y" * 200_000 + "'>z", "<script>" + "x" * 200_000 + "</script>y", "&amp;" * 5000, "<!--" + "-" * 100_000,
]


def texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    return [r.t for r in df.select("i", H.html_text(F.col("html")).alias("t")).orderBy("i").collect()]


def test_hard_pages(spark):
    draw = random.Random(3)
    pieces = [*"<>/=\"' -!&;#xab", "<a", "</a", "<!--", "-->", "&amp", "&lt;", "<script>", "</script>", "<title>", "</title ", "='", '="', "\n", "x"]
    pages = HARD + ["".join(draw.choices(pieces, k=draw.randint(1, 25))) for _ in range(3000)]
    for page, got in zip(pages, texts(spark, pages)):
        assert got == by_states(page), page[:200]
    assert spark.range(1).select(H.html_text(F.lit(None).cast("string"))).first()[0] is None


def test_every_reference(spark):
    pages = [f"a&{name}b" for name in html5] + [f"&{name}" for name in html5]
    for page, got in zip(pages, texts(spark, pages)):
        assert got == unescape(page), page


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_have_the_text_that_a_parser_finds(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html", H.html_text(F.col("html")).alias("text")).collect()
    assert rows and all(r.text == parsed(r.html) == by_states(r.html) for r in rows)


def test_length_of_rendered_html(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.concat(F.lit("a &amp; <b> 'x' \"y\" &#x27; &amp;lt;\n"), "text", F.lit("\nlast & <p>")).alias("text"))
    rows = report.with_html(S.sections(docs, LATIN), LATIN)
    html = rows.select(F.explode(F.array(*(f"html_{v}" for v in (*report.VERSIONS, "raw")))).alias("html"))
    assert html.where(T.rendered_length(F.col("html")) != T.html_text_length(F.col("html"))).count() == 0 and html.count() > 100


class Tree(HTMLParser):
    """Elements with ids by Python's parser, with the same rules for ends that are implied."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.lines, self.stack, self.found = [0], [], []
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()
        self.pop(0, len(page))

    def at(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def pop(self, to, end):
        while len(self.stack) > to:
            name, own, begin = self.stack.pop()
            self.found.append((begin, end, name, own, len(self.stack)))

    def handle_starttag(self, tag, attrs):
        for old, by in H.IMPLIED.items():
            if tag in by:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == old:
                        self.pop(k, self.at())
                        break
                    if self.stack[k][0] in H.BARRIERS:
                        break
        own = dict(reversed(attrs)).get("id")
        if tag in H.VOID:
            self.found.append((self.at(), self.at() + len(self.get_starttag_text()), tag, own, len(self.stack)))
        else:
            self.stack.append((tag, own, self.at()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        names = [s[0] for s in self.stack]
        if tag in names:
            k = len(names) - 1 - names[::-1].index(tag)
            self.pop(k + 1, self.at())
            self.pop(k, self.rawdata.index(">", self.at() - self.gone) + 1 + self.gone)

    gone = 0

    def goahead(self, end):
        super().goahead(end)


NESTED = [
    '<section id="a"><section id="b">x</section><section id=\'c\'>y<p id=p1>one<p id=p2>two</section></section>z', '<div id="a"><div><div id="b"></div></div><br id="c"></div>', "<ul id=u><li id=l1>a<ul><li id=l2>b</ul><li id=l3>c</ul>d",
    '<table id=t><tr id=r1><td id=d1>1<td id=d2>2<tr id=r2><td>3</table>', '<b id=b><i id=i></b></i>x', '<section id="a">no end', '</section><section id="a"></section></section>', '<p title=\'id="no"\' id="yes">a</p>', '<a id="漢">字</a>', "",
]


def test_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    every = NESTED + [r.html for r in pages]
    df = spark.createDataFrame([*enumerate(every), (-1, None)], "i int, html string").repartition(4)
    got = {}
    for r in H.element_index(df, "i", "html", identified=False).collect():
        got.setdefault(r.i, []).append((r.begin, r.end, r.name, r.id, r.depth))
    for i, page in enumerate(every):
        assert sorted(got.get(i, []), key=str) == sorted(Tree(page).found, key=str), page[:300]


def test_element_by_id(spark):
    rows = [(i, p) for i, p in enumerate(NESTED)]
    df = spark.createDataFrame(rows, "i int, html string")
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (0, "p1"), (0, "none"), (2, "l1"), (2, "l1"), (5, "a"), (7, "yes"), (7, "no"), (9, "a")], "i int, id string")
    found = sorted((r.i, r.id, r.element) for r in H.element_by_id(df, asked, "i", "html").collect())
    page = NESTED[0]
    assert found == sorted([
        (0, "a", page[:-1]), (0, "b", '<section id="b">x</section>'), (0, "c", "<section id='c'>y<p id=p1>one<p id=p2>two</section>"), (0, "p1", "<p id=p1>one"), (0, "none", page), (2, "l1", "<li id=l1>a<ul><li id=l2>b</ul>"),
        (2, "l1", "<li id=l1>a<ul><li id=l2>b</ul>"), (5, "a", NESTED[5]), (7, "yes", NESTED[7]), (7, "no", NESTED[7]), (9, "a", ""),
    ])
