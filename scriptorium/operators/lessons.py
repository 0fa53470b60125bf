"""What the page of a lesson shows: the result in force, its overview, and the tabs of all resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.positions import positions

# How statistics are shown, and what is added to the summary of a lesson with full results.
STATS = "%d 段 / 原文约 %.2f 万字 / %d 个处理块"
FULL_SUMMARY = "%s 当前页面已接入全文试处理结果：保真清洗、精简整理、学习整理和结构提纲按 %d 个语义块合并生成。"
#: The process line of an overview.
RAW_SIZE, PARTS = "原文 %.2f 万字", "%d 个正文分段"
#: What stands before a title in each tab, and before the parts of a work's last list.
TABS = {"methods": "知识点：", "works": "作品：", "words": "词：", "materials": "素材："}
WORK_META = ("关联课堂：", "已记字词：", "主题：")
NO_POINTS = "来源课程：五上寒假第七讲"
#: Summaries by language, and of any other one.
SUMMARIES = {"fr": ("Lecture guidée et vocabulaire.",), "de": ("Aufbau und Wortschatz des Textes.",), "": ("A reading of the text, its structure and its words.",)}


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; else the last."""
    return F.coalesce(*(F.when(F.length(c) > 0, c) for c in columns[:-1]), columns[-1])


def shown_stats(stats: Column) -> Column:
    return F.format_string(STATS, stats["paragraphs"], T.ten_thousands(stats["raw_chars"]), stats["chunks"])


def active(base: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """key, has_full, source_file, stats_text, summary, versions, review_items of each lesson in base.

    base: key and these columns (a map of versions, an array of items); full: key, source_file, stats, versions,
    review_items (as report.samples gives them). Where full has the lesson, its versions and statistics hold, its file if it
    names one, its items come before base's, and the summary says so. In both cases the version `digest`, where it is
    missing or empty, is the study version. Null versions and items count as empty ones; a lesson with a null key has no
    full result; keys repeated in full repeat the lesson. Other columns are not read.
    """
    strings = "array<string>"
    own = full.select(F.col(key).alias("_key"), F.struct("source_file", "stats", "versions", "review_items").alias("_full"))
    rows = base.select(key, "source_file", "stats_text", "summary", "versions", "review_items")
    out = rows.join(own, rows[key] == own["_key"], "left")
    has, of = F.col("_key").isNotNull(), F.col("_full")
    versions = F.coalesce(F.when(has, of["versions"]).otherwise(F.col("versions")), F.create_map().cast("map<string,string>"))
    digest = F.create_map(F.lit("digest"), filled(F.try_element_at(versions, F.lit("digest")), F.try_element_at(versions, F.lit("study"))))
    items = F.coalesce("review_items", F.array().cast(strings))
    return out.select(
        key,
        has.alias("has_full"),
        F.when(has, filled(of["source_file"], F.col("source_file"))).otherwise(F.col("source_file")).alias("source_file"),
        F.when(has, shown_stats(of["stats"])).otherwise(F.col("stats_text")).alias("stats_text"),
        F.when(has, F.format_string(FULL_SUMMARY, F.coalesce("summary", F.lit("")), of["stats"]["chunks"])).otherwise(F.col("summary")).alias("summary"),
        F.map_concat(F.map_filter(versions, lambda k, v: k != "digest"), digest).alias("versions"),
        F.when(has, F.concat(F.coalesce(of["review_items"], F.array().cast(strings)), items)).otherwise(items).alias("review_items"),
    )


def cards(lessons: DataFrame, stats: DataFrame, counts: DataFrame, key: str, chunk_id: str) -> DataFrame:
    """The card over a lesson: key, heading, summary, keywords (array), process (array; null without statistics), and how many
    cards, materials and review belong to the section chunk_id.

    lessons: key, title, subtitle, summary, keywords; stats: key, raw_chars, chunks; counts: lesson_id, chunk_id and a count
    for each kind (catalog.resource_counts). A null title or subtitle counts as empty.
    """
    here = counts.where(F.col("chunk_id") == chunk_id).select(F.col("lesson_id").alias("_lesson"), "cards", "materials", "review")
    process = F.array(F.format_string(RAW_SIZE, T.ten_thousands(F.col("raw_chars"))), F.format_string(PARTS, "chunks"))
    sized = stats.select(F.col(key).alias("_key"), process.alias("process"))
    out = lessons.join(sized, lessons[key] == sized["_key"], "left").join(here, lessons[key] == here["_lesson"], "left")
    heading = F.concat(F.coalesce("title", F.lit("")), F.lit("："), F.coalesce("subtitle", F.lit("")))
    return out.select(lessons[key], heading.alias("heading"), "summary", "keywords", "process", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("cards", "materials", "review")))


def buttons(version_stats: DataFrame) -> DataFrame:
    """doc_id, version, label, shown of the four versions (report.version_stats): a version's size, and its share of the raw text's."""
    sizes = F.map_from_entries(F.collect_list(F.struct("version", F.struct("label", "chars"))))
    out = version_stats.groupBy("doc_id").agg(sizes.alias("sizes"))  # five rows each, and one shuffle
    out = out.select("doc_id", F.col("sizes")["raw"]["chars"].alias("raw"), F.explode(F.map_filter("sizes", lambda k, v: k != "raw")).alias("version", "x"))
    return out.select("doc_id", "version", "x.label", F.concat(T.format_chars(F.col("x.chars")), F.lit(" · "), T.compression(F.col("x.chars"), F.col("raw"))).alias("shown"))


def assets(tabs: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """tab, ord (from 0 in its tab), heading, type, summary, details of the tabs of all resources (see TABS).

    A tab's rows: title, type, summary, points, examples, and the columns `order`; works have course, words (array) and
    appreciation instead of points and examples. What a resource lists are its points, or else (null) its examples, or else a
    fixed line; a work's are its course, words and theme. Places come from counts of range partitions over all tabs at once.
    Repeated rows stay, as rows of their own. Null titles count as empty.
    """
    parts = []
    for tab, rows in tabs.items():
        if tab == "works":
            text = (F.coalesce("course", F.lit("")), F.array_join("words", "、"), F.coalesce("appreciation", F.lit("")))
            details = F.array(*(F.concat(F.lit(label), F.coalesce(c, F.lit(""))) for label, c in zip(WORK_META, text)))
        else:
            details = F.coalesce("points", "examples", F.array(F.lit(NO_POINTS)))
        parts.append(rows.select(F.lit(tab).alias("tab"), F.concat(F.lit(TABS[tab]), F.coalesce("title", F.lit(""))).alias("heading"), "type", "summary", details.alias("details"), *order))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    placed = positions(every, "tab", *order, name="_all")
    first = placed.groupBy("tab").agg(F.min("_all").alias("_first"))  # a row for each tab
    return placed.join(F.broadcast(first), "tab").select("tab", (F.col("_all") - F.col("_first")).alias("ord"), "heading", "type", "summary", "details")
