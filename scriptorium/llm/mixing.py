"""Operator 8: mix sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORDS, table

#: Relative weights of the sources in code point order (null last), repeating; total share of all words; most repeats.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Slices of the key range of a source; only their sums meet in one window.
SLICES = 4096
#: Sampling weight of a document by its quality label; no label counts as UNLABELLED.
GOOD, BAD, UNLABELLED = 1.0, 0.25, 0.5


def targets(sizes: DataFrame) -> DataFrame:
    """src, source, source_size -> + target, by filling up in proportion to the weights under caps of REPEATS x size.

    Sources are sorted by the level at which their cap binds; with the first k of them capped, the rest share what is
    left by weight, and the first k whose level stays below the next cap is the answer. One row per source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(everything) - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = (F.col("source_size") * REPEATS).cast("double")
    return (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("cap_level", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(SHARE))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("level", F.coalesce(F.min_by(F.when(F.col("level") <= F.col("cap_level"), F.col("level")), F.when(F.col("level") <= F.col("cap_level"), F.col("rank"))).over(whole), F.max("cap_level").over(whole)))
        .select("src", "source", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"))
    )


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns `keep` for every row of docs (doc_id, text, source).

    size counts words (null text: 0). A source whose target is e times its size and a rest takes every document e times
    (complete epochs) and the rest from the documents with the smallest exponential keys -ln(u) / weight, u from a hash of
    doc_id and seed: a prefix sum of sizes in key order runs up to the rest, the document at the border is taken in part.
    The order within a source is never made in one task: keys fall into SLICES slices, whose sums are added up per source,
    and documents are only ordered within their slice. Null source: a source of its own. Null doc_id: u of an empty id.
    Repeated rows count each; ties in the key go by doc_id, size and `keep`. An empty table gives no rows; sources without words
    take nothing. quality: doc_id, quality (1 good, 0 bad; several rows: the best); other columns are ignored.
    """
    base = docs.select(
        F.col("doc_id"), F.col("source"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*keep).alias("own")] if keep else []),
    )
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        base = base.join(best, "doc_id", "left")
    else:
        base = base.withColumn("quality", F.lit(None).cast("int"))
    weight = F.when(F.col("quality") > 0, GOOD).when(F.col("quality") <= 0, BAD).otherwise(UNLABELLED)
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = base.withColumn("key", -F.log(u) / weight).withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((1 - F.exp(-F.col("key") * UNLABELLED)) * SLICES)).cast("int"))
    slices = keyed.groupBy("src", "source", "slice").agg(F.sum("size").alias("slice_size"))
    goal = targets(slices.groupBy("src", "source").agg(F.sum("slice_size").alias("source_size"))).drop("source")
    ahead = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.drop("source").withColumn("ahead", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).join(goal, "src")
    within = Window.partitionBy("src", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *(["own"] if keep else [])).rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    start = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return (
        keyed.join(slices.select("src", "slice", "ahead", "source_size", "target"), ["src", "slice"])
        .withColumn("epochs", epochs)
        .withColumn("start", start)
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))).cast("long"))
        .select("doc_id", "size", "source_size", "target", "taken", *(F.col("own")[c].alias(c) for c in keep))
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = r"""
WITH base AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(d.doc_id AS VARCHAR), 'mix')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / CASE WHEN l.quality > 0 THEN 1.0::DOUBLE WHEN l.quality <= 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sources),
capped AS (SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS cap_level FROM weighted),
levels AS (
  SELECT *, row_number() OVER o AS rank,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY cap_level, source NULLS LAST)),
goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, rank) FROM levels WHERE level <= cap_level), (SELECT max(cap_level) FROM levels)) * weight) AS target
  FROM levels),
parts AS (
  SELECT b.doc_id, b.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id NULLS LAST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - start)) AS BIGINT) AS taken
FROM parts
"""
