"""The page of a lesson on odd rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import lessons, report
from scriptorium.plans.rules import LATIN

BASE = "id int, source_file string, stats_text string, summary string, versions map<string,string>, review_items array<string>, extra int"
FULL = "id int, source_file string, stats struct<paragraphs:int,raw_chars:bigint,chunks:int>, versions map<string,string>, review_items array<string>, extra int"
RESOURCE = "k int, title string, type string, summary string, points array<string>, examples array<string>"
WORK = "k int, title string, type string, summary string, course string, words array<string>, appreciation string"


def test_the_result_in_force(spark):
    base = spark.createDataFrame(
        [
            (1, "a.docx", "old", "About.", {"study": "s", "digest": "d"}, ["x"], 1),
            (2, "b.docx", "old", None, {"study": "s", "digest": ""}, None, 1),
            (3, "c.docx", "old", "Kept.", {"study": "s"}, ["y"], 1),
            (4, None, None, None, None, None, None),
            (None, "n.docx", "old", "No key.", {"study": "s", "digest": "d"}, [], 1),
        ],
        BASE,
    )
    full = spark.createDataFrame([(1, "", (3, 12345, 2), {"study": "S", "digest": "", "clean": "C"}, ["f"], 2), (2, "f.docx", (1, 10, 1), {"study": "S", "digest": "D"}, None, 2), (None, "never", (1, 1, 1), {}, [], 2)], FULL)
    got = {r.id: r for r in lessons.active(base, full, "id").collect()}
    assert len(got) == 5
    one = got[1]
    assert (one.has_full, one.source_file, one.stats_text) == (True, "a.docx", "3 段 / 原文约 1.23 万字 / 2 个处理块")
    assert one.versions == {"study": "S", "clean": "C", "digest": "S"} and one.review_items == ["f", "x"] and one.summary.startswith("About. 当前") and "2 个" in one.summary
    assert got[2].source_file == "f.docx" and got[2].versions["digest"] == "D" and got[2].review_items == []
    assert (got[3].has_full, got[3].stats_text, got[3].summary, got[3].versions, got[3].review_items) == (False, "old", "Kept.", {"study": "s", "digest": "s"}, ["y"])
    assert got[4].versions == {"digest": None} and got[4].review_items == [] and not got[None].has_full and got[None].versions["digest"] == "d"
    assert lessons.active(base.limit(0), full, "id").count() == 0 and lessons.active(base, full.limit(0), "id").where("has_full").count() == 0


def test_sizes_are_rounded_as_in_sql(spark):
    import duckdb

    shown = [lessons.shown_stats(F.struct(F.lit(1).alias("paragraphs"), F.col("id").alias("raw_chars"), F.lit(1).alias("chunks"))), F.format_string("%.2f", T.ten_thousands(F.col("id")))]
    got = {r.id: r for r in spark.range(0, 400000, 50).select("id", *(c.alias(n) for c, n in zip(shown, "ab"))).collect()}
    want = dict(duckdb.sql("SELECT i, printf('%.2f', round(i / 10000.0, 2)) FROM range(0, 400000, 50) t(i)").fetchall())
    assert {i: r.b for i, r in got.items()} == want
    assert want[1450] == "0.14" and "约 0.14 万字" in got[1450].a


def test_columns_of_a_comparison(spark):
    pack = replace(LATIN, max_chars=30)
    text = "head\n" + "\n".join("a line of words, some of it" for _ in range(3))
    docs = spark.createDataFrame([(1, text), (2, "head\nonly one line of words"), (3, "head"), (4, None), (5, "")], "doc_id int, text string")
    for version in ("clean", "digest", "study", "outline", "raw"):
        got = {r.doc_id: r for r in report.compare_view(docs, pack, version, "c02").collect()}
        assert set(got) == {1, 2, 3, 4, 5}
        whole = report.samples(docs, pack).where("doc_id = 2").select(F.col("versions")[version]).first()[0]
        if version != "raw":
            assert got[1].left_title.endswith("C02") and 'id="c02"' in got[1].right_html and 'id="c01"' not in got[1].right_html
            assert got[2].left_title.endswith("C01") and got[2].right_html == whole  # no such section: all of the version
        assert all(got[i].left_html == got[i].right_html == "" and got[i].left_title.endswith("C02") for i in (3, 4, 5))


def test_cards_without_statistics(spark):
    rows = spark.createDataFrame([(1, "t", None, "s", ["k"]), (2, None, "u", None, None), (None, "x", "y", "z", [])], "id int, title string, subtitle string, summary string, keywords array<string>")
    stats = spark.createDataFrame([(1, 15000, 4)], "id int, raw_chars long, chunks int")
    counts = spark.createDataFrame([(1, "c01", 2, 1, 0), (1, "c02", 9, 9, 9)], "lesson_id int, chunk_id string, cards long, materials long, review long")
    got = sorted(map(tuple, lessons.cards(rows, stats, counts, "id", "c01").collect()), key=repr)
    assert got == [(1, "t：", "s", ["k"], ["原文 1.50 万字", "4 个正文分段"], 2, 1, 0), (2, "：u", None, None, None, 0, 0, 0), (None, "x：y", "z", [], None, 0, 0, 0)]


def test_tabs(spark):
    empty = spark.createDataFrame([], RESOURCE)
    cards = spark.createDataFrame([(2, "b", "t", None, None, None), (1, "a", None, "s", [], ["e"]), (3, None, "t", "s", None, ["e", "f"]), (3, None, "t", "s", None, ["e", "f"])], RESOURCE)
    works = spark.createDataFrame([(1, "w", "t", "s", "c", ["x", "y"], None), (2, "v", "t", "s", None, None, "a")], WORK)
    got = lessons.assets({"methods": cards, "works": works, "words": empty, "materials": cards.limit(0)}, ["k"]).orderBy("tab", "ord").collect()
    assert [(r.tab, r.ord, r.heading, r.details) for r in got] == [
        ("methods", 0, "知识点：a", []),
        ("methods", 1, "知识点：b", ["来源课程：五上寒假第七讲"]),
        ("methods", 2, "知识点：", ["e", "f"]),
        ("methods", 3, "知识点：", ["e", "f"]),
        ("works", 0, "作品：w", ["关联课堂：c", "已记字词：x、y", "主题："]),
        ("works", 1, "作品：v", ["关联课堂：", "已记字词：", "主题：a"]),
    ]
    assert lessons.assets({"methods": empty}, ["k"]).count() == 0
