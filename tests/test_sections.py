"""Cleaning, sections, sentences, selections and reports on hand-made cases."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium import queries
from scriptorium.functions import text as T
from scriptorium.operators import long_documents, report, sections, sentences
from scriptorium.plans.rules import LATIN, LECTURE_CLASSICAL, LECTURE_ESSAY, WS
from scriptorium.sources import text as sources
from scriptorium.streaming import ingest

ZH = LECTURE_CLASSICAL


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cleaned(spark, *texts, pack=ZH):
    rows = docs(spark, *texts).select("doc_id", T.clean(F.col("text"), pack).alias("c")).orderBy("doc_id").collect()
    return [r.c for r in rows]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("eyes", "e"), ("Mmm 好Mmm好", "好Mmm好"), ("就就", ""), ("好我们", "我们"), ("甲。。乙", "甲。乙"), ("甲，，乙", "甲，乙"), ("嗯嗯，对吧？走", "走"),
        ("呵呵哈哈甲", "甲"), ("是不是啊？甲", "甲"), ("懂了吗，甲", "甲"), ("能理解吧。甲", "甲"), ("罪首和醉手", "醉叟和醉叟"), ("甲  　乙", "甲 乙"), ("，甲。", "甲"),
        ("老师 00:00:09 甲", "甲"), ("老师　00:00:09", ""), ("好，那么", "那么"), ("好吧", "好吧"),
    ],
)
def test_cleaning(spark, raw, want):
    assert cleaned(spark, raw) == [want]


def test_time_stamps_are_dropped_but_counted(spark):
    text = "标题\n老师 00:00:09\n甲乙丙\n\n  \n老师　00:01:00\n丁"
    row = sections.sections(docs(spark, text), ZH).collect()
    assert [(r.start_para, r.end_para, r.raw_chars, r.body, r.title) for r in row] == [(1, 5, 4, "甲乙丙\n丁", "课堂片段 1")]


def test_noise(spark):
    noise = "我" * 13 + "啊" * 220
    row = sections.sections(docs(spark, f"标题\n{noise}\n{'我' * 13 + '啊' * 207}"), ZH).first()
    assert row.paras[0].text == ZH.noise_marker + noise[:180] + "..."
    assert row.paras[1].text == "我" * 13 + "啊" * 207
    flags = report.review_flags(docs(spark, f"标题\n{noise}", "标题\n甲"), ZH).orderBy("doc_id", "flag_no").collect()
    assert [r.flag_no for r in flags] == [1, 2, 3, 4, 1, 2, 3] and flags[3].flag == ZH.noise_flag


@pytest.mark.parametrize("sizes, want", [((3000, 600), [2]), ((3000, 601), [1, 1]), ((4000,), [1]), ((4000, 1, 5000), [1, 1, 1]), ((), [])])
def test_capacity(spark, sizes, want):
    rows = sections.sections(docs(spark, "\n".join(["t", *("z" * n for n in sizes)])), ZH).orderBy("chunk_no").collect()
    assert [len(r.paras) for r in rows] == want


def test_no_documents_and_null_texts(spark):
    some = docs(spark, None, "", "only a heading")
    assert sections.sections(some, LATIN).count() == 0
    assert [(r.paragraphs, r.raw_chars, r.chunks) for r in report.stats(some, LATIN).orderBy("doc_id").collect()] == [(0, 0, 0), (0, 0, 0), (1, 14, 0)]
    assert report.version_stats(some.where("doc_id < 0"), LATIN).count() == 0


def test_study_points(spark):
    alike = "第一重点方法作用说明题型" + "同" * 12
    text = "标题\n" + alike + "甲甲。" + alike + "乙乙。所以说明方法作用很好的。" + "这一句话完全没有得分。"
    s = sections.sections(docs(spark, text), ZH)
    assert [r.sentence[:8] for r in sentences.study_points(s, ZH, 7).orderBy("rank").collect()][:2] == [alike[:8], "所以说明方法作用"]


def test_fallbacks(spark):
    paragraphs = ["啊" * 7] * 3 + ["波" * 400] * 4
    s = sections.sections(docs(spark, "\n".join(["标题", *paragraphs])), ZH)
    points = [r.sentence for r in sentences.study_points(s, ZH, 7).orderBy("rank").collect()]
    assert points == [p[:150] for p in paragraphs]
    # sentences of eight characters score at the start of a paragraph, so only shorter ones fall back
    s = sections.sections(docs(spark, "\n".join(["标题", *["啊" * 7] * 200])), ZH)
    assert [r.ord for r in sentences.digest_sentences(s, ZH).orderBy("ord").collect()] == list(range(1, 110))  # 108 * 7 < 760 <= 109 * 7


def test_titles_take_the_first_rule(spark):
    rows = docs(spark, "明线 祖母", "偷钱 父亲", "偷钱", "题型").select(T.title(F.col("text"), F.col("doc_id"), ZH).alias("a"), T.title(F.col("text"), F.col("doc_id"), LECTURE_ESSAY).alias("b")).collect()
    assert [r.a for r in rows] == ["线索、明线与暗线", "《偷钱》情节与人物心理", "课堂片段 2", "课堂片段 3"]
    assert rows[3].b == "现代文阅读三步法"


def test_ranges_are_contiguous_and_nothing_is_lost(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    by = {}
    for r in sections.sections(d, LATIN).orderBy("doc_id", "chunk_no").collect():
        by.setdefault(r.doc_id, []).append(r)
    stats = {r.doc_id: r for r in report.stats(d, LATIN).collect()}
    for i, own in by.items():
        assert own[0].start_para == 1 and own[-1].end_para == stats[i].paragraphs
        assert all(a.end_para + 1 == b.start_para for a, b in zip(own, own[1:]))
        assert sum(r.raw_chars for r in own) == stats[i].clean_chars


def test_shown_sizes(spark):
    rows = spark.createDataFrame([(0,), (49,), (9949,), (9999,), (10000,), (123456,)], "n long").select(T.format_chars(F.col("n")).alias("s"), T.compression(F.col("n"), F.lit(0)).alias("e")).collect()
    assert [r.s for r in rows] == ["1 字", "1 字", "9900 字", "10000 字", "1.00 万字", "12.35 万字"]
    assert {r.e for r in rows} == {""}


def test_word_files(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    found = sources.paragraphs(sources.read_docx(spark, str(tmp_path))).orderBy("para_no").collect()
    assert [(r.para_no, r.raw) for r in found] == [(1, "one two"), (2, "three")]


def test_stream(spark, tmp_path):
    d = docs(spark, "t\nsome words here.\nmore", "t\nother")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, LATIN, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sections.sections(d, LATIN).count() == 2


def test_json_round_trip(spark, tmp_path):
    s = sections.sections(docs(spark, "标题\n甲乙"), ZH).select("doc_id", "body")
    sources.write_json(s, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().body == "甲乙"


PLAIN_LATIN = (r"(?i)\b(u+h+m*|hmm+|e+h+)\b", r"(?i)\b(ha){2,}h?\b[,. ]*", r"(?i)\byou know\b[?,. ]*", r"(?i)\bok[,. ]+(?=so|then|now|next)", r"(?i)\b(the the|and and|of of)\b")
PLAIN_ZH = (
    r"(?iU)\bMm+\b|hmm|yes", r"[嗯呃]{1,3}[，。 ]*", r"呵呵|哈哈", r"是不是(啊|呀)?[？?，,。 ]*", r"对吧[？?，,。 ]*", r"能理解吧[？?，,。 ]*", r"懂了吗[？?，,。 ]*",
    r"好[，,。 ]*(?=第|接下来|我们|那么|来|翻|往下)", r"这个这个|那个那个|就就|把把|的的的",
)


@pytest.mark.parametrize("pack, plain", [(LATIN, PLAIN_LATIN), (ZH, PLAIN_ZH)])
def test_rules_with_look_aheads_do_what_the_plain_ones_do(spark, pack, plain):
    draw = random.Random(3)
    bits = [*"uhmeHaAo ,.?!;x9_é\u212a\u017f\u00a0\u3000\t\x1f\u200a\U0001d4d0嗯呃好，。？！；第来这个那就把的", "haha", "you know", "ok", "so", "the the", "AND and", "of of", "hmm", "Mm", "yes", "ye\u017f", "呵呵", "哈哈", "是不是啊", "对吧", "能理解吧", "懂了吗", "我们", "这个这个", "那个那个"]
    rows = docs(spark, *("".join(draw.choices(bits, k=draw.randint(0, 40))) for _ in range(20000)))
    c = F.col("text")
    pairs = [(F.regexp_replace(c, rule, to), F.regexp_replace(c, old, to)) for (rule, to), old in zip(pack.clean, plain)]
    pairs += [(F.regexp_replace(c, *pack.clean[-1]), F.regexp_replace(c, WS + "+", " ")), (T.strip(c), F.regexp_replace(c, f"^{WS}+|{WS}+$", "")), (T.inked(c), F.length(F.regexp_replace(c, WS + "+", "")))]
    cut = F.filter(F.transform(F.split(c, f"(?<={T.quoted(pack.terminators)})", -1), T.strip), lambda s: F.length(s) >= pack.sentence)
    pairs.append((sentences.sentence_array(c, pack), cut))
    wrong = rows.select(*(F.sum((~a.eqNullSafe(b)).cast("int")).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    assert len(pack.clean) == len(plain) + 1 and not any(wrong)


@pytest.mark.parametrize("name", ["flt_empty_clean", "agg_exists_noise", "flt_noise_flag", "lecture_cleaned", "lecture_study", "lecture_flags", "out_raw", "topk_outline", "agg_version_stats"])
def test_texts_are_cleaned_once(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ZH.clean[3][0] if name.startswith("lecture") else LATIN.clean[0][0]) == 1


def test_arriving_paragraphs_are_cleaned_once(spark):
    rows = spark.createDataFrame([(1, 2, "uh a text")], "doc_id long, para_no int, raw string")
    plan = long_documents.measured(rows, LATIN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(LATIN.clean[0][0]) == 1


def test_lengths_of_versions_are_those_of_their_text(spark, small):
    some = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(60).unionByName(docs(spark, "h\n<b> & \"it's\" &lt; a text, which is longer than some.", "h", "").withColumn("doc_id", -F.col("doc_id") - 1))
    got = {(r.doc_id, r.version): r.chars for r in report.version_stats(some, LATIN).collect()}
    made = report.samples(some, LATIN).where("size(chunks) > 0").select("doc_id", F.explode("versions").alias("version", "html"))
    want = {(r.doc_id, r.version): r.n for r in made.select("doc_id", "version", T.html_text_length(F.col("html")).alias("n")).collect()}
    assert want and want == {k: v for k, v in got.items() if k[1] != "raw"}
    assert {k for k, v in got.items() if k[0] == -2} == {(-2, "raw")}
