"""Catalogue operations: merging, look-ups, unions, scopes and counts over lessons and their resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import html_escape

#: The sections that resources go to, in turn, by kind.
PRESETS = {"cards": ("c01", "c02", "c03", "c06", "c09"), "materials": ("c02", "c04", "c09"), "review": ("c01", "c03", "c08", "c09")}

COURSE = "id string, title string, subtitle string, teacher string, type string, status string, updated string, review_count long"
#: The list of courses.
COURSES = (
    ("sample-classical", "五上寒假第三/四讲", "《偷钱》线索讲评 + 文言文《醉叟传》", "张老师", "阅读 + 文言文", "已完成", "样例试处理", 9),
    ("sample-essay", "五上寒假第七讲", "现代文阅读 + 作文点评", "张老师", "阅读作文", "已完成", "样例试处理", 7),
    ("lesson-8", "五上秋季第八讲", "古诗词讲评", "陈老师", "古诗词", "有待复核", "周一 19:44", 8),
    ("lesson-9", "五上秋季第九讲", "现代文阅读 + 应试作文", "陈老师", "阅读作文", "处理中", "刚刚", 0),
)
#: Schemas of the other tables of a catalogue, which are read from files.
TABLES = {
    "cards": "lesson_id string, ord long, title string, type string, summary string, points array<string>",
    "materials": "lesson_id string, ord long, title string, type string, summary string, examples array<string>",
    "review": "lesson_id string, ord long, title string",
    "classics": "key string, type string, title string, subtitle string, summary string, source string, quote string, translation string, appreciation string, terms array<struct<term:string,note:string>>",
    "words": "ord long, title string, type string, summary string, points array<string>",
}
#: What a reference block says in each version, and in any other one.
NOTES = {
    "clean": "保真清洗保留课堂讲法，并用参考库把疑似错字低干扰标出。",
    "digest": "精简整理保留文言文讲解脉络，译文和字词可按需展开。",
    "study": "学习整理把原文、译文、字词和老师讲解分层，方便复习。",
    "": "学习整理把古文参考资料放在正文旁边，方便复习。",
}
#: Keywords by language, and of any other one.
KEYWORDS = {"fr": ("lecture", "plan", "vocabulaire"), "de": ("Aufbau", "Wortschatz"), "": ("reading", "structure", "vocabulary", "style")}


def courses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COURSES), COURSE)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a catalogue (see TABLES) from JSON, one object a line."""
    return spark.read.schema(TABLES[name]).json(path)


def listed(courses_: DataFrame, *keep: str) -> DataFrame:
    """Courses as a list shows them: title and teacher, type, status, and how much is left to review."""
    review = F.when(F.col("review_count") > 0, F.concat(F.col("review_count").cast("string"), F.lit(" 条"))).otherwise("无")
    return courses_.select("id", *keep, F.concat("title", F.lit(" · "), "teacher").alias("shown"), "type", "status", review.alias("review"))


def overview(key: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The constants of a key, or else those of the key ''."""
    found = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(found, F.coalesce(key, F.lit(""))), F.try_element_at(found, F.lit("")))


def drawer(asked: DataFrame, own: DataFrame, every: DataFrame, words: DataFrame, columns: Sequence[str]) -> DataFrame:
    """asked: lesson_id, ord -> + level and columns: of the lesson's own list (level 0), else of all lists together (1), else of
    the words (2), the record at that place. Places without any have no row."""
    out, levels = asked, []
    for level, (table, keys) in enumerate(((own, ["lesson_id", "ord"]), (every, ["ord"]), (words, ["ord"]))):
        record = F.struct(*columns, F.lit(level).alias("level"))
        out = out.join(table.select(*keys, record.alias(f"_{level}")), keys, "left")
        levels.append(f"_{level}")
    return out.withColumn("_found", F.coalesce(*levels)).where("_found is not null").select("lesson_id", "ord", "_found.*")


# Class names of the block.
def reference_block(version: Column) -> Column:
    """HTML of a reference (columns quote, translation, terms): its first four terms, and the version's note."""
    notes = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    note = F.coalesce(F.try_element_at(notes, version), F.lit(NOTES[""]))
    terms = F.array_join(F.transform(F.slice("terms", 1, 4), lambda t: F.concat(F.lit("<li>"), html_escape(t), F.lit("</li>"))), "")
    parts = ('<aside class="classical-appreciation-block"><p class="classical-original">', html_escape(F.col("quote")), "</p><p>", html_escape(F.col("translation")), "</p><ul>", terms, '</ul><p class="teacher-note">', note, "</p></aside>")
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def or_first(rows: DataFrame, key: str, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with the columns of the table's row of their key; an unknown key has those of the table's first one."""
    first = table.agg(F.min_by(F.struct(*columns), key).alias("_first"))
    own = table.select(F.col(key).alias("_key"), F.struct(*columns).alias("_own"))
    out = rows.join(own, rows[key] == own["_key"], "left").crossJoin(F.broadcast(first))
    return out.select(*rows.columns, *(F.coalesce("_own", "_first")[c].alias(c) for c in columns), F.col("_key").isNotNull().alias("known"))


def merge(base: DataFrame, full: DataFrame, key: str, override: Sequence[str]) -> DataFrame:
    """base with the columns `override` replaced where full has a row and a value; base's other columns as they are."""
    other = full.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in override), F.lit(True).alias("_full"))
    out = base.join(other, base[key] == other["_key"], "left")
    own = set(base.columns)
    return out.select(*(c for c in base.columns if c not in override), *(F.coalesce(F.col(f"_{c}"), base[c]).alias(c) if c in own else F.col(f"_{c}").alias(c) for c in override), F.coalesce("_full", F.lit(False)).alias("has_full"))


def look_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: Column | None = None) -> DataFrame:
    """rows with one more column, from the row of table with that key. The optimizer broadcasts a table that is small."""
    found = table.select(F.col(table_key).alias("_key"), F.col(value).alias(f"_{value}"))
    out = rows.join(found, rows[key] == found["_key"], "left").drop("_key")
    return out.withColumn(value, F.coalesce(F.col(f"_{value}"), default) if default is not None else F.col(f"_{value}")).drop(f"_{value}")


def assign(index: Column, kind: str) -> Column:
    """The section of the resource with that index (from 0) among those of its kind."""
    ids = PRESETS[kind]
    return F.element_at(F.array(*map(F.lit, ids)), (F.pmod(index, F.lit(len(ids))) + 1).cast("int"))


def union(*parts: DataFrame) -> DataFrame:
    """All rows of the parts in turn (ord: part, then the part's own ord); nothing is made distinct."""
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def head_of_each(rows: DataFrame, n: int, keys: Sequence[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def resource_counts(resources: DataFrame, kinds: Sequence[str] = ("cards", "materials", "review")) -> DataFrame:
    """lesson_id, chunk_id and a count for each kind. The kinds are given, so that no job looks for them."""
    return resources.groupBy("lesson_id", "chunk_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def scoped(resources: DataFrame, chunk_id: str, show_all: bool = False, few: int = 3) -> DataFrame:
    """Resources of a section; of lessons without any there, the first few; or all of them."""
    if show_all:
        return resources
    w = Window.partitionBy("lesson_id", "kind")
    here = F.col("chunk_id") == chunk_id
    out = resources.withColumns({"_here": F.count_if(here).over(w), "_n": F.row_number().over(w.orderBy("ord"))})
    return out.where(F.when(F.col("_here") > 0, here).otherwise(F.col("_n") <= few)).drop("_here", "_n")


def current(rows: DataFrame, chunk_id: str) -> DataFrame:
    """Of each document, the section with that id, or else the first one."""
    best = Window.partitionBy("doc_id").orderBy((F.col("chunk_id") != chunk_id).cast("int"), "chunk_no")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def compare(raw: DataFrame, version: DataFrame, whole: DataFrame) -> DataFrame:
    """Raw sections beside the same section of a version; where it has none, beside the whole version."""
    left = raw.select("doc_id", "chunk_id", F.col("html").alias("raw_html"))
    right = version.select("doc_id", "chunk_id", F.col("html").alias("_section"))
    return left.join(right, ["doc_id", "chunk_id"], "left").join(whole.select("doc_id", F.col("html").alias("_whole")), "doc_id", "left").select("doc_id", "chunk_id", "raw_html", F.coalesce("_section", "_whole").alias("version_html"))


def search(courses: DataFrame, text: str | None = None, kind: str | None = None, status: str | None = None, columns: Sequence[str] = ("title", "teacher", "type")) -> DataFrame:
    """Courses with the text in one of the columns (any case), of a type and status; None: any."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        courses = courses.where(hit)
    if kind is not None:
        courses = courses.where(F.col("type") == kind)
    return courses if status is None else courses.where(F.col("status") == status)


def details(rows: DataFrame) -> DataFrame:
    """What a resource lists: its points, else its examples, else its summary."""
    own = lambda c: F.when(F.size(c) > 0, F.col(c))
    return rows.withColumn("details", F.coalesce(own("points"), own("examples"), F.array("summary")))
