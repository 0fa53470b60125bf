"""Statistics, review flags, rendered versions and the nested result of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.sections import documents, neighbour, of_documents
from scriptorium.operators.sentences import KEYS, digest_array, group_array, outline_array, study_array, with_sentences
from scriptorium.plans.rules import RulePack

# Labels of the rendered versions.
LABELS = {"clean": ("保真清洗", "保留课堂顺序"), "digest": ("精简整理", "保留展开脉络"), "study": ("学习整理", "默认阅读版"), "outline": ("结构提纲", "快速复盘"), "raw": ("原文", "转写稿")}
CLEAN_META = "片段 %s｜原段落 %d-%d｜约 %d 字"
DIGEST_META = "精简整理｜覆盖原段落 %d-%d｜约保留 30%%-35%%"
STUDY_META = "学习整理｜覆盖原段落 %d-%d｜保留重点 %d 条"
OUTLINE_META = "片段 %s｜原段落 %d-%d"
RAW_META = "原段落 %d-%d｜约 %d 字"
OUTLINE_TITLE = "全文结构提纲"
FOOTER = ("上一段", "回到目录", "下一段")


def stats_columns(pack: RulePack) -> list[Column]:
    """Of a row of documents(): counts of its paragraphs, characters and sections."""
    total = lambda c, size: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + size(x))
    return [
        F.size("raw").alias("paragraphs"), total(F.col("raw"), F.length).alias("raw_chars"), total(F.col("paras"), lambda p: F.length(p["text"])).alias("clean_chars"),
        F.size("begins").alias("chunks"), F.lit(pack.max_chars).alias("chunk_target_chars"),
    ]


def stats(docs: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, paragraphs, raw_chars, clean_chars, chunks, chunk_target_chars."""
    return documents(docs, pack).select("doc_id", *stats_columns(pack))


def flags(pack: RulePack) -> Column:
    """Of a row of documents(): the pack's flags, and one more where a paragraph is marked as noise."""
    noisy = F.exists("paras", lambda p: p["text"].contains(pack.noise_text))
    fixed = F.array(*map(F.lit, pack.flags))
    return F.when(noisy, F.array_append(fixed, F.lit(pack.noise_flag))).otherwise(fixed)


def review_flags(docs: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, flag_no, flag: a row for each of a document's flags."""
    return documents(docs, pack).select("doc_id", F.posexplode(flags(pack)).alias("at", "flag")).select("doc_id", (F.col("at") + 1).alias("flag_no"), "flag")


def tag(name: str, *parts: Column, attrs: Column | str = "") -> Column:
    head = F.concat(F.lit(f"<{name} "), attrs, F.lit(">")) if isinstance(attrs, Column) else F.lit(f"<{name}{' ' + attrs if attrs else ''}>")
    return F.concat(head, *parts, F.lit(f"</{name}>"))


def _meta(template: str, *columns: str | Column) -> Column:
    return tag("p", F.format_string(template, *columns), attrs='class="chunk-meta"')


# Class names of the rendered versions, here and in the functions that follow.
def _footer() -> Column:
    button = lambda label, to: tag("button", F.lit(label), attrs=F.concat(F.lit('class="tiny-button" data-jump-chunk="'), to, F.lit('" '), F.when(to == "", "disabled").otherwise("")))
    return tag("nav", button(FOOTER[0], neighbour(-1)), tag("button", F.lit(FOOTER[1]), attrs='class="tiny-button" data-jump-toc'), button(FOOTER[2], neighbour(1)), attrs='class="chunk-footer"')


def _section(*parts: Column) -> Column:
    return tag("section", tag("h2", T.html_escape(F.col("title"))), *parts, attrs=F.concat(F.lit('class="long-section" id="'), F.col("chunk_id"), F.lit('"')))


def _items(texts: Column, name: str) -> Column:
    return F.array_join(F.transform(texts, lambda t: tag(name, T.html_escape(t))), "\n")


VERSIONS = ("clean", "digest", "study", "outline")


def _selected(sections: DataFrame, pack: RulePack, versions: tuple[str, ...]) -> DataFrame:
    """Sections with what the versions digest, study and outline select, as arrays of texts in _<version>. An outline is the head
    of the study points, if it is to have no more of them and the same fallback."""
    if not {"digest", "study", "outline"} & set(versions):
        return sections
    cut = F.transform(F.slice("_study", 1, pack.outline_limit), lambda s: F.substring(s, 1, pack.outline_cut))
    shared = "study" in versions and pack.fallback[0] <= pack.outline_limit <= pack.study_limit
    arrays = {"digest": lambda: group_array(digest_array(pack), pack), "study": lambda: study_array(pack, pack.study_limit), "outline": lambda: outline_array(pack)}
    rows = with_sentences(sections, pack).withColumns({f"_{v}": arrays[v]() for v in versions if v in arrays and not (v == "outline" and shared)})
    return rows.withColumn("_outline", cut) if shared and "outline" in versions else rows


def _lengths() -> dict[str, Column]:
    """Of a row of _selected() with all versions: characters of each version's text in with_html() that aren't white space. Tags
    have no text and an escaped character is one, so nothing is rendered."""
    head = lambda template, *columns: T.inked(F.concat("title", F.format_string(template, *columns)))
    own = lambda texts: T.inked(F.array_join(texts, ""))
    foot = len("".join(FOOTER))
    return {
        "clean": head(CLEAN_META, "chunk_id", "start_para", "end_para", "raw_chars") + own(F.transform("paras", lambda p: p["text"])) + foot,
        "digest": head(DIGEST_META, "start_para", "end_para") + own(F.col("_digest")) + foot,
        "study": head(STUDY_META, "start_para", "end_para", F.size("_study")) + own(F.col("_study")) + foot,
        "outline": head(OUTLINE_META, "chunk_id", "start_para", "end_para") + own(F.col("_outline")),
    }


def with_html(sections: DataFrame, pack: RulePack, versions: tuple[str, ...] = (*VERSIONS, "raw")) -> DataFrame:
    """Sections with a column html_<version> for each of the versions, all from one pass over their paragraphs."""
    rows = _selected(sections, pack, versions)
    texts = F.transform("paras", lambda p: p["text"])
    html = {
        "clean": lambda: _section(_meta(CLEAN_META, "chunk_id", "start_para", "end_para", "raw_chars"), _items(texts, "p"), _footer()),
        "raw": lambda: tag("section", tag("h2", T.html_escape(F.col("title"))), _meta(RAW_META, "start_para", "end_para", "raw_chars"), _items(texts, "p"), attrs='class="raw-chunk"'),
        "digest": lambda: _section(_meta(DIGEST_META, "start_para", "end_para"), _items(F.col("_digest"), "p"), _footer()),
        "study": lambda: _section(_meta(STUDY_META, "start_para", "end_para", F.size("_study")), tag("ul", _items(F.col("_study"), "li")), _footer()),
        "outline": lambda: tag(
            "li", tag("strong", T.html_escape(F.col("title"))), tag("span", F.format_string(OUTLINE_META, "chunk_id", "start_para", "end_para"), attrs='class="chunk-meta"'), tag("ul", _items(F.col("_outline"), "li")),
            attrs=F.concat(F.lit('id="'), F.col("chunk_id"), F.lit('" class="outline-chunk"')),
        ),
    }
    return rows.select(*sections.columns, *(html[v]().alias(f"html_{v}") for v in versions))


def render_sections(sections: DataFrame, pack: RulePack, version: str) -> DataFrame:
    """doc_id, chunk_no, chunk_id, html of each section in a version (clean, digest, study, outline or raw)."""
    return with_html(sections, pack, (version,)).select(*KEYS, "chunk_id", F.col(f"html_{version}").alias("html"))


def _whole(rows: Column, version: str) -> Column:
    """A document's html, from its sections' structs in order."""
    html = F.array_join(F.transform(rows, lambda r: r[f"html_{version}"]), "\n")
    if version == "outline":
        html = tag("section", tag("h2", F.lit(OUTLINE_TITLE)), tag("ol", html, attrs='class="outline-list"'), attrs='class="long-section"')
    return html


def whole_versions(sections: DataFrame, pack: RulePack, versions: tuple[str, ...], *extra: str) -> DataFrame:
    """doc_id, rows (of the sections in order: chunk_no, the columns extra and each version's html): one shuffle by document."""
    rows = with_html(sections, pack, versions).select("doc_id", F.struct("chunk_no", *extra, *(f"html_{v}" for v in versions)).alias("row"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def render(sections: DataFrame, pack: RulePack, version: str) -> DataFrame:
    """doc_id, html: all sections of a document, in order."""
    return whole_versions(sections, pack, (version,)).select("doc_id", _whole(F.col("rows"), version).alias("html"))


def _rendered(docs: DataFrame, pack: RulePack, versions: tuple[str, ...], *extra: str) -> DataFrame:
    """doc_id, stats, review_items, rows (see whole_versions; null without sections): documents are read, cleaned and rendered
    once. They are dealt by doc_id before anything else, so that sections find together again where they are."""
    d = documents(docs, pack, None, "doc_id").withColumns({"stats": F.struct(*stats_columns(pack)), "review_items": flags(pack)})
    # a document without sections goes along as an empty one, which is left out of its rows
    none = F.size("begins") == 0
    d = d.withColumns({"begins": F.when(none, F.array(F.lit(1))).otherwise(F.col("begins")), "none": none})
    rows = with_html(of_documents(d, pack, "stats", "review_items", "none"), pack, versions)
    row = F.when(~F.col("none"), F.struct("chunk_no", *extra, *(f"html_{v}" for v in versions)))
    out = rows.groupBy("doc_id").agg(F.first("stats").alias("stats"), F.first("review_items").alias("review_items"), F.array_sort(F.collect_list(row)).alias("rows"))
    return out.withColumn("rows", F.when(F.size("rows") > 0, F.col("rows")))


def compared(sections: DataFrame, pack: RulePack, version: str, whole: str) -> DataFrame:
    """doc_id, chunk_id, raw_html, version_html: raw sections beside the same section of a version, from one rendering; where the
    version has no such sections (an outline), beside the whole of `whole`."""
    if version != "outline":
        rows = with_html(sections, pack, ("raw", version))
        return rows.select("doc_id", "chunk_id", F.col("html_raw").alias("raw_html"), F.col(f"html_{version}").alias("version_html"))
    rows = whole_versions(sections, pack, tuple(dict.fromkeys(("raw", whole))), "chunk_id")
    return rows.select("doc_id", F.explode("rows").alias("r"), _whole(F.col("rows"), whole).alias("version_html")).select("doc_id", "r.chunk_id", F.col("r.html_raw").alias("raw_html"), "version_html")


# Headings of the two columns.
COLUMN_TITLES = ("原始转写稿｜", "当前整理版｜")


def compare_view(docs: DataFrame, pack: RulePack, version: str, chunk_id: str) -> DataFrame:
    """doc_id, stats, left_title, left_html, right_title, right_html: a document's raw section beside a version of it.

    Left is the section chunk_id, or else the first one; right that section of the version (an item of an outline), or else
    the whole version. A document without sections has empty columns under the id asked for. Documents are read, cleaned and
    rendered once; a document's sections meet where they are.
    """
    made = _rendered(docs, pack, tuple(dict.fromkeys(("raw", version))), "chunk_id")
    own = F.try_element_at(F.filter("rows", lambda r: r["chunk_id"] == chunk_id), F.lit(1))
    left = F.coalesce(own, F.try_element_at("rows", F.lit(1)))
    label = LABELS.get(version, LABELS["study"])[0]
    return made.select(
        "doc_id",
        "stats",
        F.concat(F.lit(COLUMN_TITLES[0]), F.upper(F.coalesce(left["chunk_id"], F.lit(chunk_id)))).alias("left_title"),
        F.coalesce(left["html_raw"], F.lit("")).alias("left_html"),
        F.lit(COLUMN_TITLES[1] + label).alias("right_title"),
        F.coalesce(own[f"html_{version}"], _whole(F.col("rows"), version), F.lit("")).alias("right_html"),
    )


def version_stats(docs: DataFrame, pack: RulePack) -> DataFrame:
    """doc_id, version, label, chars, tone: text lengths of the four versions (where there are sections) and the raw text (1 where
    it is empty). A whole text's length is the sum of its sections', so sections are measured in their rows and no HTML is made."""
    label, tone = (F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[i]))) for i in (0, 1))
    d = documents(docs, pack, None, "doc_id").withColumns({"raw_length": stats_columns(pack)[1], "none": F.size("begins") == 0})
    d = d.withColumn("begins", F.when(F.col("none"), F.array(F.lit(1))).otherwise(F.col("begins")))
    rows = _selected(of_documents(d, pack, "raw_length", "none"), pack, VERSIONS)
    sums = rows.groupBy("doc_id").agg(F.first("raw_length").alias("raw"), F.first("none").alias("none"), *(F.sum(n).alias(v) for v, n in _lengths().items()))
    about = {"outline": F.lit(len("".join(OUTLINE_TITLE.split())))}  # what the whole has besides its sections
    shown = F.array(*(F.when(~F.col("none"), F.struct(F.lit(v).alias("version"), (F.col(v) + about.get(v, F.lit(0))).cast("long").alias("chars"))) for v in VERSIONS), F.struct(F.lit("raw").alias("version"), F.greatest(F.col("raw"), F.lit(1)).cast("long").alias("chars")))
    out = sums.select("doc_id", F.inline(F.filter(shown, lambda x: x.isNotNull())))
    return out.select("doc_id", "version", F.element_at(label, F.col("version")).alias("label"), "chars", F.element_at(tone, F.col("version")).alias("tone"))


def samples(docs: DataFrame, pack: RulePack, about: DataFrame | None = None) -> DataFrame:
    """The nested result of each document: title, subtitle, source_file, stats, chunks, review_items and versions.

    about: doc_id, title, subtitle, source; the file's name is the last part of its source. Documents are read and rendered
    once. Documents without sections have empty chunks and versions. Timing isn't part of a result: it belongs to the run.
    """
    made = _rendered(docs, pack, (*VERSIONS, "raw"), "chunk_id", "title", "start_para", "end_para", "raw_chars")
    chunk = lambda r: F.struct(r["chunk_id"].alias("id"), *(r[c].alias(c) for c in ("title", "start_para", "end_para")), r["raw_chars"].alias("chars"), r["html_raw"].alias("raw_html"))
    versions = F.create_map(*(x for v in VERSIONS for x in (F.lit(v), F.when(F.col("rows").isNull(), "").otherwise(_whole(F.col("rows"), v)))))
    out = made.select("doc_id", "stats", F.transform("rows", chunk).alias("chunks"), "review_items", versions.alias("versions"))
    out = out.withColumn("chunks", F.coalesce("chunks", F.array().cast(out.schema["chunks"].dataType)))
    if about is not None:
        out = out.join(about.select("doc_id", "title", "subtitle", T.basename(F.col("source")).alias("source_file")), "doc_id", "left")
        return out.select("doc_id", "title", "subtitle", "source_file", "stats", "chunks", "review_items", "versions")
    return out
