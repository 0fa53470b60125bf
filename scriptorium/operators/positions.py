"""Positions, neighbours and running sums over a whole table, from range partitions and their borders; no task sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.shared import written

#: monotonically_increasing_id() has the partition above this bit and the place in it below.
_PLACE = (1 << 33) - 1


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows in range partitions of that order, as a written table, with _part and _at (place in the part, from 0).

    The order needs to tell rows apart, or those that it doesn't tell apart share a part.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_at")))


def positions(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """rows with their place (from 0) in that order of all of them: what parts count, summed up, is where the next one begins.

    The driver holds a number for each part. Rows that the order doesn't tell apart have places in any order.
    """
    table = ranged(rows, *order)
    counts = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    begin, begins = 0, []
    for part in range(max(counts, default=-1) + 1):
        begins.append(begin)
        begin += counts.get(part, 0)
    first = F.element_at(F.lit(begins or [0]), F.col("_part") + 1)
    return table.withColumn(name, first.cast("long") + F.col("_at")).drop("_part", "_at")


def circular_siblings(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The ids before and after each row's in a list that goes around; within parts by a window, at their borders by a join.

    Each part's first and last id are its border, a row; equal places have any order. A single row is its own neighbour.
    """
    table = ranged(rows.select(key, *([order] if order != key else [])), order)
    w = Window.partitionBy("_part").orderBy("_at")
    inner = table.select(key, "_part", F.lag(F.struct(key)).over(w).alias("_prev"), F.lead(F.struct(key)).over(w).alias("_next"))
    borders = table.groupBy("_part").agg(F.min_by(F.struct(key), "_at").alias("first"), F.max_by(F.struct(key), "_at").alias("last"))
    ends = [r.asDict() for r in borders.orderBy("_part").collect()]  # a row for each part
    if not ends:
        return rows.select(key, F.col(key).alias("prev_id"), F.col(key).alias("next_id"))
    around = [(e["_part"], ends[i - 1]["last"], ends[(i + 1) % len(ends)]["first"]) for i, e in enumerate(ends)]
    kind = rows.schema[key].dataType.simpleString()
    beyond = rows.sparkSession.createDataFrame(around, f"_part int, _before struct<`{key}`:{kind}>, _after struct<`{key}`:{kind}>")
    out = inner.join(F.broadcast(beyond), "_part")  # a row for each part
    return out.select(key, F.coalesce("_prev", "_before")[key].alias("prev_id"), F.coalesce("_next", "_after")[key].alias("next_id"))


def sibling(items: DataFrame, asked: DataFrame, key: str, order: str) -> DataFrame:
    """The siblings of the ids in asked; an id that isn't in the list has those of its first item."""
    around = circular_siblings(items, key, order)
    first = items.agg(F.min_by(key, order).alias("_first"))
    known = asked.select(key).join(items.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left").crossJoin(F.broadcast(first)).select(key, F.coalesce("_key", "_first").alias("_key"))
    return known.join(around.withColumnRenamed(key, "_key"), "_key").select(key, "prev_id", "next_id")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """rows with, in that order and for each combination of keys: _no (from 1) and _before (sum of `size` over earlier rows).

    A window sums up within each part; what the parts before it hold of the same keys is added, a row for each part and
    combination. So a combination with any number of rows is spread over as many parts as they fill.
    """
    table = ranged(rows, *keys, *order)
    own = table.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lead = own.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"))
    here = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*keys, "_part")]
    out = table.withColumns({"_no": F.row_number().over(here), "_upto": F.sum(size).over(here)}).alias("r").join(lead.alias("l"), same)
    return out.select(*(f"r.{c}" for c in rows.columns), (F.col("_no") + F.col("_n0")).alias("_no"), (F.col("_upto") + F.col("_sum0") - F.col(size)).cast("long").alias("_before"))
