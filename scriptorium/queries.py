"""The registered queries of the library's own operators over the driver's tables, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import html
from scriptorium.functions import text as T
from scriptorium.functions.automaton import with_words
from scriptorium.operators import catalog, lessons, long_documents, report, search
from scriptorium.operators import sections as S
from scriptorium.operators import sentences as N
from scriptorium.operators.positions import circular_siblings, positions, sibling
from scriptorium.plans.rules import LATIN, LECTURE_CLASSICAL, LECTURE_ESSAY, LECTURE_WORDS, PACKS
from scriptorium.sources.document_file import read_document, write_document
from scriptorium.sources.shared import shared_folder
from scriptorium.sources.text import dealt, docx_texts, from_json, paragraph_array, paragraphs, registry, to_docx, to_json
from scriptorium.sources.word_files import read_word_files, write_word_files
from scriptorium.streaming import incremental

P = LATIN
#: Nothing scores: every section falls back on its paragraphs.
NO_SCORE = replace(P, name="no-score", study_words=("\x01",), digest_words=("\x01",), study_band=(1, 0), digest_band=(1, 0), early=0)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def sections_of(spark: SparkSession, d: str) -> DataFrame:
    return S.sections(docs_of(spark, d), P)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---- sources, paragraphs, cleaning ------------------------------------------------------------------------------------


@query
def gen_paragraph(spark, d):
    return longs(paragraphs(docs_of(spark, d)), "para_no")


@query
def src_docx(spark, d):
    """Documents as Word files, read again."""
    return longs(paragraphs(docx_texts(to_docx(docs_of(spark, d)), "doc_id")), "para_no")


@query
def src_docx_files(spark, d):
    """Documents in Word files of about 256 each, written to a folder and read by the data source."""
    docs = docs_of(spark, d)
    files = docs.count() // 256 + 1
    lines = paragraphs(docs).select("doc_id", "para_no", F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "raw").alias("text"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_word_files(lines, path, "file", "doc_id", "para_no").agg(F.sum("paragraphs")).collect()
    found = read_word_files(spark, path).where("error is null").select(F.substring_index("text", ":", 1).cast("long").alias("doc_id"), F.length("text").alias("n"))
    return found.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.col("n") - F.length(F.col("doc_id").cast("string")) - 1).alias("chars"))


@query
def src_registry(spark, d):
    return longs(registry(spark, [(p.name, p.untitled, p.noise_text, f"/packs/{p.name}.docx", p.max_chars) for p in PACKS.values()]).withColumn("file", T.basename(F.col("source"))), "max_chars")


@query
def flt_header(spark, d):
    return longs(paragraphs(docs_of(spark, d)).where("para_no > 1").groupBy("doc_id").agg(F.count("*").alias("kept"), F.min("para_no").alias("first_no")), "first_no")


@query
def flt_timestamp(spark, d):
    """Turns of conversations as speaker lines: `role HH:MM:SS` before each text."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%s 00:%02d:%02d", "role", (F.floor(F.col("turn") / 60) % 60).cast("int"), (F.col("turn") % 60).cast("int")).alias("stamp"), "text")
    lines = turns.select("conv_id", "turn", F.explode(F.array("stamp", F.concat("stamp", F.lit("  "), "text"), F.col("text"))).alias("line"))
    return lines.where(~T.is_timestamp(F.col("line"), P)).select("conv_id", "turn", F.regexp_replace("line", rf"\A{P.timestamp}[\t-\r ]*", "").alias("line"))


@query
def cln_rules(spark, d):
    return longs(paragraphs(docs_of(spark, d)).select("doc_id", "para_no", T.clean(F.col("raw"), P).alias("text")), "para_no")


def kept(spark, d):
    return S.kept_paragraphs(S.documents(docs_of(spark, d), P))


@query
def flt_empty_clean(spark, d):
    return kept(spark, d)


@query
def flt_noise_flag(spark, d):
    found = F.filter(F.array(F.struct(T.clean(F.col("raw"), P).alias("text"))), lambda p: T.is_noise(p["text"], P))  # bound, so cleaned once
    rows = paragraphs(docs_of(spark, d)).select("doc_id", "para_no", F.inline(found))
    return longs(rows, "para_no").select("doc_id", "para_no", T.mark_noise(F.col("text"), P).alias("text"))


# ---- sections -----------------------------------------------------------------------------------------------------------


@query
def seg_fold(spark, d):
    s = sections_of(spark, d).select("doc_id", "chunk_no", "start_para", "end_para", F.size("paras").alias("n_paras"), F.col("raw_chars").alias("chars"))
    return longs(s, "chunk_no", "start_para", "end_para", "n_paras", "chars")


@query
def seg_fold_long(spark, d):
    """The same sections from rows of paragraphs, in blocks of 8192 characters: a document is spread over tasks."""
    return longs(long_documents.sections(paragraphs(docs_of(spark, d)), P, block=8192), "chunk_no", "start_para", "end_para", "n_paras", "chars")


@query
def seg_fold_stream(spark, d):
    """The same sections from paragraphs that arrive in three deliveries, a third of each document at a time: one run each on the state before."""
    lines = F.coalesce(paragraph_array(F.col("text")), F.array().cast("array<string>"))
    every = dealt(docs_of(spark, d)).select("doc_id", lines.alias("lines"), F.size(lines).alias("paras"))
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for k in range(3):
        begin, end = (F.floor(F.col("paras") * i / 3).cast("int") for i in (k, k + 1))
        part = every.select("doc_id", "paras", begin.alias("begin"), F.posexplode(F.slice("lines", begin + 1, end - begin)).alias("at", "raw"))
        part.select("doc_id", (F.col("begin") + F.col("at") + 1).alias("para_no"), "raw", "paras").write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema("doc_id long, para_no int, raw string, paras int").parquet(f"{base}/in")
        incremental.ingest(arriving, P, f"{base}/out", f"{base}/state").awaitTermination()
    s = spark.read.parquet(f"{base}/out")
    return longs(s.select("doc_id", "chunk_no", "start_para", "end_para", "n_paras", F.col("raw_chars").alias("chars")), "chunk_no")


@query
def gen_chunk(spark, d):
    return longs(S.section_paragraphs(sections_of(spark, d)).select("doc_id", "chunk_no", "pos", "para_no"), "chunk_no", "pos", "para_no")


@query
def agg_chunk_body(spark, d):
    return sections_of(spark, d).select("doc_id", "chunk_id", "body")


@query
def fn_title_first_match(spark, d):
    return sections_of(spark, d).select("doc_id", "chunk_id", "title")


@query
def nav_chunk(spark, d):
    return S.neighbours(sections_of(spark, d))


@query
def nav_current(spark, d):
    return catalog.current(sections_of(spark, d), "c02").select("doc_id", "chunk_id", F.upper("chunk_id").alias("label"))


@query
def out_toc(spark, d):
    return longs(sections_of(spark, d).select("doc_id", F.upper("chunk_id").alias("label"), "title", "start_para", "end_para", "raw_chars"), "start_para", "end_para", "raw_chars")


@query
def flt_compact(spark, d):
    return sections_of(spark, d).select("doc_id", "chunk_id", "title", F.format_string(report.RAW_META, "start_para", "end_para", "raw_chars").alias("meta"))


# ---- sentences and selections -------------------------------------------------------------------------------------------


@query
def gen_sentence(spark, d):
    return longs(N.sentences(sections_of(spark, d), P).drop("raw_chars"), "chunk_no", "ord", "position")


@query
def rank_study_score(spark, d):
    return longs(N.sentences(sections_of(spark, d), P).select("doc_id", "chunk_no", "ord", T.study_score(F.col("sentence"), P).alias("score")).where("score > 0"), "chunk_no", "ord", "score")


@query
def rank_digest_score(spark, d):
    return longs(N.sentences(sections_of(spark, d), P).select("doc_id", "chunk_no", "ord", T.digest_score(F.col("sentence"), F.col("position"), P).alias("score")).where("score > 0"), "chunk_no", "ord", "score")


@query
def agg_keyword_score(spark, d):
    return longs(N.sentences(sections_of(spark, d), P).select("doc_id", "chunk_no", "ord", T.word_score(F.col("sentence"), P.study_words).alias("score")), "chunk_no", "ord", "score")


def lexicon(spark, d):
    """Words of four letters and more in the texts of `benchmark`, a table that doesn't grow."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}{4,})"))).alias("w")).distinct()
    return sorted(r.w for r in words.collect())


@query
def agg_lexicon_score(spark, d):
    """Two for each word of a lexicon in a sentence: all words are looked for in one pass."""
    rows = N.sentences(sections_of(spark, d), P).select("doc_id", "chunk_no", "ord", "sentence")
    found = with_words(rows, "sentence", lexicon(spark, d)).select("doc_id", "chunk_no", "ord", (2 * F.size("found")).alias("score")).where("score > 0")
    return longs(found, "chunk_no", "ord", "score")


@query
def agg_lexicon_words(spark, d):
    """Documents in which each word of the lexicon stands."""
    words = lexicon(spark, d)
    found = with_words(dealt(docs_of(spark, d)), "text", words).select(F.explode("found.word").alias("word")).groupBy("word").agg(F.count("*").alias("documents"))
    return found.select(F.element_at(F.lit(words), F.col("word") + 1).alias("word"), "documents")


@query
def topk_study(spark, d):
    return longs(N.study_points(sections_of(spark, d), P, P.study_limit), "chunk_no", "rank")


@query
def topk_outline(spark, d):
    return longs(N.outline_points(sections_of(spark, d), P), "chunk_no", "rank")


@query
def topk_fallback(spark, d):
    """With no band and no words that can score, every section falls back on its paragraphs."""
    return longs(N.study_points(sections_of(spark, d), NO_SCORE, P.study_limit), "chunk_no", "rank")


@query
def budget_digest(spark, d):
    return longs(N.digest_sentences(sections_of(spark, d), P), "chunk_no", "ord")


@query
def budget_fallback(spark, d):
    return longs(N.digest_sentences(sections_of(spark, d), NO_SCORE), "chunk_no", "ord")


@query
def gen_digest_group(spark, d):
    return longs(N.digest_groups(sections_of(spark, d), P), "chunk_no", "group_no")


@query
def agg_point_count(spark, d):
    return longs(N.study_points(sections_of(spark, d), P, P.study_limit).groupBy("doc_id", "chunk_no").agg(F.count("*").alias("points")), "chunk_no")


# ---- reports ------------------------------------------------------------------------------------------------------------


@query
def agg_stats(spark, d):
    return longs(report.stats(docs_of(spark, d), P), "paragraphs", "chunks", "chunk_target_chars")


@query
def fn_review_flags(spark, d):
    return longs(report.review_flags(docs_of(spark, d), P), "flag_no")


@query
def agg_exists_noise(spark, d):
    return kept(spark, d).groupBy("doc_id").agg(F.bool_or(F.contains("text", F.lit(P.noise_text))).alias("noisy"))


@query
def out_clean(spark, d):
    s = sections_of(spark, d)
    return longs(s.select("doc_id", "chunk_id", "title", "start_para", "end_para", "raw_chars", F.explode("paras").alias("p")).select("doc_id", "chunk_id", "title", "start_para", "end_para", "raw_chars", F.col("p.para_no").alias("para_no"), F.col("p.text").alias("text")), "start_para", "end_para", "raw_chars", "para_no")


@query
def out_raw(spark, d):
    return report.render_sections(sections_of(spark, d), P, "raw").select("doc_id", "chunk_id", "html")


@query
def out_digest(spark, d):
    s = sections_of(spark, d)
    return longs(N.digest_groups(s, P).withColumn("chunk_id", F.format_string("c%02d", "chunk_no")).withColumn("html", T.html_escape(F.col("text"))).select("doc_id", "chunk_id", "group_no", "html"), "group_no")


def _sections_out(version):
    def run(spark, d):
        return report.render_sections(sections_of(spark, d), P, version).select("doc_id", "chunk_id", "html")

    return run


QUERIES["snk_html_digest"], QUERIES["out_study"], QUERIES["out_outline"] = (_sections_out(v) for v in ("digest", "study", "outline"))


@query
def agg_version_stats(spark, d):
    return report.version_stats(docs_of(spark, d), P)


@query
def out_overview(spark, d):
    """Statistics of each document beside its label, sizes as shown."""
    s = report.stats(docs_of(spark, d), P)
    shown = s.select("doc_id", "chunks", T.format_chars(F.col("raw_chars")).alias("raw_size"), T.format_chars(F.col("clean_chars")).alias("clean_size"), T.compression(F.col("clean_chars"), F.col("raw_chars")).alias("share"))
    return longs(catalog.look_up(shown, "doc_id", table(spark, d, "labels"), "doc_id", "quality", F.lit(-1)), "chunks", "quality")


@query
def out_sample(spark, d):
    s = report.samples(docs_of(spark, d), P)
    return longs(s.select("doc_id", "stats.paragraphs", "stats.clean_chars", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunks"), F.element_at("review_items", 1).alias("first_flag"), F.coalesce(F.length(F.element_at("versions", "study")), F.lit(0)).alias("study_length")).withColumn("chunks", F.greatest("chunks", F.lit(0))), "paragraphs", "chunks", "study_length")


@query
def fn_html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text_length(F.col("html")).cast("long").alias("chars"))


@query
def fn_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html.html_text(F.col("html")).cast("binary")).alias("text"))


@query
def fn_html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("html"))


@query
def fn_basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("name"))


@query
def fn_hash_route(spark, d):
    """The id in routes like #/courses/<id>."""
    routes = table(spark, d, "labels").select("doc_id", F.concat(F.when(F.col("toxic") > 0, "#/assets/").otherwise("#/courses/"), F.col("doc_id").cast("string")).alias("route"))
    return routes.select("doc_id", F.regexp_extract("route", r"^#/courses/([^/]+)$", 1).alias("course_id"))


@query
def fn_format_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.format_chars(F.col("n_chars")).alias("size"))


@query
def fn_compression(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.compression(F.floor("o_totalprice"), F.col("o_orderkey") * 100).alias("share"))


@query
def fn_round(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 100).cast("long").alias("hundreds"))


# ---- catalogue ----------------------------------------------------------------------------------------------------------


def resources(spark, d):
    """Cards, materials and review items of lessons: paragraphs of conversations by role, dealt to sections by their index."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("lesson_id"), "turn", F.col("text").alias("title"))
    kinds = [("cards", 0), ("materials", 1), ("review", 2)]
    parts = [turns.where(F.col("turn") % 3 == i).select("lesson_id", F.lit(k).alias("kind"), F.floor(F.col("turn") / 3).alias("ord"), "title").withColumn("chunk_id", catalog.assign(F.col("ord"), k)) for k, i in kinds]
    return catalog.union(*parts)


@query
def join_lesson_full(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("chars"))
    full = table(spark, d, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("source"), F.col("toxic").cast("long").alias("chars"))
    return catalog.merge(base, full, "doc_id", ["source", "chars"])


@query
def join_keyword_ref(spark, d):
    """Nations by their region's name, the default where there is none."""
    return catalog.look_up(table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 7 > 0, F.col("n_regionkey")).alias("key")), "key", table(spark, d, "region"), "r_regionkey", "r_name", F.lit("none")).select("n_name", "r_name")


@query
def join_ref_key(spark, d):
    return catalog.look_up(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


@query
def join_chunk_assign(spark, d):
    return resources(spark, d).select("lesson_id", "kind", "ord", "chunk_id")


@query
def agg_resource_counts(spark, d):
    return catalog.resource_counts(resources(spark, d))


@query
def flt_chunk_scope(spark, d):
    return catalog.scoped(resources(spark, d), "c02").select("lesson_id", "kind", "ord", "chunk_id")


@query
def set_union_resources(spark, d):
    extra = table(spark, d, "benchmark").select(F.col("item_id").alias("lesson_id"), F.lit("cards").alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("text").alias("title"), F.lit("c08").alias("chunk_id"))
    return catalog.union(resources(spark, d).drop("part"), extra).select("lesson_id", "kind", "ord", "chunk_id", F.col("part").cast("long").alias("part"))


@query
def set_union_cards(spark, d):
    """Two lists whole and the first two of a third one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return catalog.union(c.where("role = 'user'"), c.where("role <> 'user'"), catalog.head(c, 2, "conv_id", "turn")).select("conv_id", "turn", F.col("part").cast("long").alias("part"))


@query
def set_dedupe_prefix(spark, d):
    p = paragraphs(docs_of(spark, d))
    return longs(catalog.head_of_each(p.withColumn("prefix", F.substring("raw", 1, P.prefix)), 1, ["doc_id", "prefix"], "para_no").select("doc_id", "para_no", "prefix"), "para_no")


@query
def join_compare(spark, d):
    """Raw sections beside the clean version of each; tests show a version without such sections."""
    out = report.compared(sections_of(spark, d), P, "clean", "outline")
    return out.select("doc_id", "chunk_id", F.length("raw_html").cast("long").alias("raw_length"), F.md5(F.col("version_html").cast("binary")).alias("version"))


@query
def nav_sibling(spark, d):
    return circular_siblings(table(spark, d, "documents").select("doc_id"), "doc_id", "doc_id")


@query
def limit_head(spark, d):
    return catalog.head(table(spark, d, "documents").select("doc_id", "lang", "source"), 3, "doc_id")


@query
def flt_course_ui(spark, d):
    courses = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("teacher"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("status"))
    first = courses.agg(F.min("type").alias("t"))
    found = catalog.search(courses, text="a").join(first, F.col("type") == F.col("t"), "left_semi")
    return found.select("p_partkey", "title")


@query
def flt_course_search(spark, d):
    """Parts of the names and brands of all parts, each searched for among all of them, by postings."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    index = search.build(parts, "p_partkey", ("p_name", "p_brand"))
    asked = parts.select(F.explode(F.array(F.substring("p_name", 3, 6), F.substring("p_brand", 5, 4), F.substring("p_name", 1, 2))).alias("asked")).distinct()
    return search.search_many(spark, index, asked, "asked").groupBy("asked").agg(F.count("*").alias("found"), F.sum("key").alias("keys"))


@query
def out_assets(spark, d):
    turns = table(spark, d, "conversations")
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("points"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))), lambda x: x["text"]).alias("examples"), F.min("text").alias("summary"))
    return catalog.details(rows).select("conv_id", F.size("details").cast("long").alias("items"), F.element_at("details", 1).alias("first_item"))


@query
def fn_section_by_id(spark, d):
    whole = report.render(sections_of(spark, d), P, "clean")
    found = html.elements_by_id(whole, "doc_id", "html", F.array(F.lit("c02")))
    return found.select("doc_id", F.md5(F.col("element").cast("binary")).alias("section"))


@query
def fn_section_nested(spark, d):
    """Sections within parts of three: a part by its id, with the sections that it holds."""
    rows = report.whole_versions(sections_of(spark, d), P, ("clean",))
    own = lambda p: F.array_join(F.transform(F.slice("rows", p * 3 + 1, 3), lambda r: r["html_clean"]), "")
    part = lambda p: F.concat(F.lit('<section id="p'), p.cast("string"), F.lit('">'), own(p), F.lit("</section>"))
    pages = rows.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / 3).cast("int")), part), "").alias("html"))
    return html.elements_by_id(pages, "doc_id", "html", F.array(*map(F.lit, ("p0", "p1", "c05")))).select("doc_id", "id", F.md5(F.col("element").cast("binary")).alias("section"))


@query
def fn_element_index(spark, d):
    """How many elements of each name the index of a page has."""
    return html.element_index(table(spark, d, "pages"), "page_id", "html", identified=False).groupBy("page_id", "name").agg(F.count("*").alias("elements"))


@query
def fn_inject_block(spark, d):
    whole = report.render(sections_of(spark, d), P, "clean")
    return whole.select("doc_id", F.instr(T.inject_after_meta(F.col("html"), F.lit('<aside class="extra">note</aside>'), ("c02", "c01"), 'class="extra"'), '<aside class="extra">').cast("long").alias("at"))


# ---- lectures: the packs in Chinese over documents with some of their words -----------------------------------------------


def lectures(spark, d):
    return docs_of(spark, d).withColumn("text", reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), LECTURE_WORDS, F.col("text")))


def _cleaning(rule):
    def run(spark, d):
        return longs(paragraphs(lectures(spark, d)).select("doc_id", "para_no", F.regexp_replace("raw", *rule).alias("text")), "para_no")

    return run


_RULES = ("cln_filler_latin", "cln_filler_cjk", "cln_laugh", "cln_tag_isnt", "cln_tag_right", "cln_tag_understand", "cln_tag_gotit", "cln_ok_lookahead", "cln_stutter")
QUERIES |= {name: _cleaning(rule) for name, rule in zip(_RULES, LECTURE_CLASSICAL.clean)}


@query
def lecture_cleaned(spark, d):
    return S.kept_paragraphs(S.documents(lectures(spark, d), LECTURE_CLASSICAL))


@query
def lecture_sections(spark, d):
    return longs(S.sections(lectures(spark, d), LECTURE_CLASSICAL).select("doc_id", "chunk_no", "title", "start_para", "end_para", F.col("raw_chars").alias("chars")), "chunk_no", "start_para", "end_para", "chars")


@query
def lecture_essay_titles(spark, d):
    return S.sections(lectures(spark, d), LECTURE_ESSAY).select("doc_id", "chunk_id", "title")


@query
def lecture_study(spark, d):
    return longs(N.study_points(S.sections(lectures(spark, d), LECTURE_CLASSICAL), LECTURE_CLASSICAL, LECTURE_CLASSICAL.study_limit), "chunk_no", "rank")


@query
def lecture_digest(spark, d):
    return longs(N.digest_groups(S.sections(lectures(spark, d), LECTURE_ESSAY), LECTURE_ESSAY), "chunk_no", "group_no")


@query
def lecture_flags(spark, d):
    return longs(report.review_flags(lectures(spark, d), LECTURE_CLASSICAL), "flag_no")


# ---- result tables --------------------------------------------------------------------------------------------------------


@query
def src_literals(spark, d):
    return catalog.courses(spark)


RESULT = "doc_id long, paragraphs long, raw_chars long, clean_chars long, chunks long, chunk_target_chars long"


@query
def snk_json(spark, d):
    return to_json(longs(report.stats(docs_of(spark, d), P), "paragraphs", "chunks", "chunk_target_chars"))


@query
def src_generated(spark, d):
    """Results written as JSON, read again."""
    return from_json(snk_json(spark, d), RESULT).select("doc_id", "paragraphs", "raw_chars", "chunks")


def digests(s):
    """Of nested results, all sections and versions as digests."""
    md5 = lambda c: F.md5(c.cast("binary"))
    chunk = lambda c: F.concat_ws("|", *(c[k].cast("string") for k in ("id", "title", "start_para", "end_para", "chars", "raw_html")))
    return s.select("doc_id", md5(F.array_join(F.transform("chunks", chunk), "\n")).alias("chunks"), *(md5(F.element_at("versions", v)).alias(v) for v in report.VERSIONS))


@query
def out_sample_html(spark, d):
    return digests(report.samples(docs_of(spark, d), P))


@query
def snk_document(spark, d):
    """Nested results written as one JSON document, with what a script needs around it, and read again from its files."""
    results = report.samples(docs_of(spark, d), P)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_document(results, path, prefix="window.samples = ", suffix=";")
    return digests(read_document(spark, path, results.schema.simpleString()))


def courses_of(spark, d):
    done = F.when(F.col("p_size") % 2 == 0, "已完成").otherwise("处理中")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("teacher"), F.col("p_type").alias("type"), done.alias("status"), (F.col("p_size") % 3).cast("long").alias("review_count"))


@query
def out_courses(spark, d):
    return catalog.listed(courses_of(spark, d))


@query
def out_recent(spark, d):
    return catalog.listed(catalog.head(courses_of(spark, d), 3, "id"))


@query
def out_detail(spark, d):
    """A document's header, statistics as shown, what is left to review, and its study version."""
    s = report.stats(docs_of(spark, d), P)
    shown = F.format_string("%d 段 / 原文约 %.2f 万字 / %d 个处理块", "paragraphs", T.ten_thousands(F.col("raw_chars")), "chunks")
    header = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("｜"), F.coalesce("source", F.lit(""))).alias("header"))
    review = table(spark, d, "conversations").where("role = 'system'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("review_count"))
    body = report.render(sections_of(spark, d), P, "study")
    out = s.select("doc_id", shown.alias("stats_text")).join(header, "doc_id").join(review, "doc_id", "left").join(body, "doc_id", "left")
    return out.select("doc_id", "header", "stats_text", F.coalesce("review_count", F.lit(0).cast("long")).alias("review_count"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("body"))


@query
def fn_overview(spark, d):
    words = catalog.overview(F.col("lang"), catalog.KEYWORDS)
    return table(spark, d, "documents").select("doc_id", words[0].alias("first_keyword"), F.size(words).cast("long").alias("keywords"))


def drawers(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("lesson_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("type"), F.col("text").alias("title"))
    own = turns.where("turn % 2 = 0").withColumn("ord", F.floor(F.col("turn") / 2))
    every = positions(turns, "lesson_id", "turn", "title")
    words = positions(table(spark, d, "benchmark").select("item_id", F.lit("word").alias("type"), F.col("text").alias("title")), "item_id")
    asked = turns.select("lesson_id", F.explode(F.array(F.col("turn") * 3, F.col("lesson_id") * 2 + F.col("turn"))).alias("ord")).distinct()
    return catalog.drawer(asked, own, every, words, ["type", "title"])


@query
def join_drawer(spark, d):
    return longs(drawers(spark, d).select("lesson_id", "ord", "level", "title"), "level")


@query
def out_drawer(spark, d):
    shown = F.concat(report.tag("p", T.html_escape(F.col("type")), attrs='class="page-kicker"'), report.tag("h2", T.html_escape(F.col("title"))))
    return drawers(spark, d).select("lesson_id", "ord", shown.alias("html"))


@query
def out_classics_block(spark, d):
    """A reference block for each version; nations stand for the references."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    terms = F.array("n_name", "r_name", F.lit("a & b"), F.lit("<i>"), F.lit("fifth"))
    refs = table(spark, d, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("quote"), F.concat(F.lit("of "), "r_name").alias("translation"), terms.alias("terms"))
    every = refs.withColumn("version", F.explode(F.array(*map(F.lit, report.VERSIONS))))
    return every.select("key", "version", catalog.reference_block(F.col("version")).alias("html"))


@query
def set_union_materials(spark, d):
    """Two lists whole and the first of a third one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return catalog.union(c.where("role = 'assistant'"), c.where("role = 'user'"), catalog.head(c, 1, "conv_id", "turn")).select("conv_id", "turn", F.col("part").cast("long").alias("part"))


@query
def set_union_review(spark, d):
    """Flags that were made, then items that were there."""
    there = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("items"))
    made = docs_of(spark, d).select("doc_id", F.array(*map(F.lit, P.flags)).alias("flags"))
    every = F.concat("flags", F.coalesce("items", F.array().cast("array<string>")))
    return made.join(there, "doc_id", "left").select("doc_id", F.posexplode(every).alias("at", "item")).select("doc_id", (F.col("at") + 1).cast("long").alias("ord"), "item")


@query
def out_side(spark, d):
    rows = catalog.scoped(resources(spark, d), "c02")
    place = F.row_number().over(Window.partitionBy("lesson_id", "kind").orderBy("ord"))
    return longs(rows.select("lesson_id", "kind", place.alias("place"), F.upper("chunk_id").alias("label"), "title"), "place")


@query
def nav_sibling_unknown(spark, d):
    """Ids that aren't in the list have the siblings of its first item."""
    asked = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("doc_id"))
    return sibling(table(spark, d, "documents").select("doc_id"), asked, "doc_id", "doc_id")


@query
def join_lesson_fallback(spark, d):
    """Unknown documents have what the first known one has."""
    return longs(catalog.or_first(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), ["quality", "toxic"]), "quality", "toxic")


# ---- the page of a lesson -------------------------------------------------------------------------------------------------


@query
def join_lesson_active(spark, d):
    """Each document as a catalogue has it (only English ones with a digest there), with the full result of those that have a label."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "conversations").where("role = 'system'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("review_items"))
    versions = F.create_map(F.lit("study"), F.substring_index("text", "\n", 1), F.lit("digest"), F.when(F.col("lang") == "en", F.col("source")).otherwise(""))
    base = docs.select("doc_id", F.col("source").alias("source_file"), F.col("lang").alias("stats_text"), F.concat("lang", F.lit(".")).alias("summary"), versions.alias("versions")).join(items, "doc_id", "left")
    full = report.samples(docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), P).withColumn("source_file", F.lit(""))
    out = lessons.active(base, full, "doc_id")
    return out.select("doc_id", "has_full", "source_file", "stats_text", "summary", *(F.md5(F.col("versions")[v].cast("binary")).alias(v) for v in ("study", "digest")), F.array_join("review_items", "|").alias("items"))


@query
def out_detail_compare(spark, d):
    """The page of a document while it is compared: header, statistics, its second section beside that of the digest."""
    header = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("｜"), F.coalesce("source", F.lit(""))).alias("header"))
    s = report.compare_view(docs_of(spark, d), P, "digest", "c02").join(header, "doc_id")
    return s.select("doc_id", "header", lessons.shown_stats(F.col("stats")).alias("stats_text"), "left_title", F.md5(F.col("left_html").cast("binary")).alias("left_html"), "right_title", F.md5(F.col("right_html").cast("binary")).alias("right_html"))


@query
def out_detail_outline(spark, d):
    """The same beside an outline, of the third section: items of the outline, or all of it."""
    s = report.compare_view(docs_of(spark, d), P, "outline", "c03")
    return s.select("doc_id", "left_title", "right_title", F.md5(F.col("right_html").cast("binary")).alias("right_html"))


@query
def out_overview_card(spark, d):
    """The card over each document: summary and keywords of its language, sizes, and what belongs to its second section."""
    docs = table(spark, d, "documents")
    shown = docs.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("subtitle"), catalog.overview(F.col("lang"), lessons.SUMMARIES)[0].alias("summary"), catalog.overview(F.col("lang"), catalog.KEYWORDS).alias("keywords"))
    out = lessons.cards(shown, report.stats(docs, P), catalog.resource_counts(resources(spark, d)), "doc_id", "c02")
    return out.withColumns({"keywords": F.array_join("keywords", "、"), "process": F.array_join("process", "｜")})


@query
def out_version_buttons(spark, d):
    return lessons.buttons(report.version_stats(docs_of(spark, d), P))


@query
def out_assets_tabs(spark, d):
    """All four tabs: questions as methods, nations as works, benchmark items as words, answers as materials."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("k1"), F.col("turn").cast("long").alias("k2"), "role", F.col("role").alias("type"), F.substring("text", 1, 12).alias("title"), F.col("text").alias("summary"))
    none = F.lit(None).cast("array<string>")
    methods = turns.where("role = 'user'").withColumns({"points": F.when(F.col("k2") % 4 == 0, F.array("title", "type")), "examples": none})
    materials = turns.where("role = 'assistant'").withColumns({"points": none, "examples": F.array("summary")})
    words = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.substring_index("text", " ", 1).alias("title"), F.lit("word").alias("type"), F.col("text").alias("summary"), F.split("text", " ").alias("points"), none.alias("examples"))
    regions = table(spark, d, "region")
    works = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("n_name").alias("title"), F.col("r_name").alias("type"), F.lower("n_name").alias("summary"), F.col("r_name").alias("course"), F.array("n_name", "r_name").alias("words"), F.lower("r_name").alias("appreciation"))
    out = lessons.assets({"methods": methods, "works": works, "words": words, "materials": materials}, ["k1", "k2"])
    return out.select("tab", "ord", "heading", "type", "summary", F.array_join("details", "|").alias("details"))
