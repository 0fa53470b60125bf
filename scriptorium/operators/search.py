"""Search for parts of names: a table of postings by runs of three letters finds candidates, which are then looked at."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scriptorium.sources.shared import shared_folder

#: Letters of a gram; folders that postings and rows are dealt to, of which a search reads those it needs.
GRAM, FOLDERS = 3, 64
#: Letters of the searched columns that a task makes postings of (up to GRAM each): at most, and enough for a task of its own.
MOST, ENOUGH = 1 << 21, 1 << 17


def _runs(small: Column, size: int) -> Column:
    starts = F.when(F.length(small) >= size, F.sequence(F.lit(1), F.length(small) - size + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(small, i, F.lit(size))), F.array().cast("array<string>"))


def grams(c: Column) -> Column:
    """The different runs of up to GRAM letters of a text, in small letters."""
    small = F.lower(c)
    return F.array_distinct(F.flatten(F.array(*(_runs(small, size) for size in range(1, GRAM + 1)))))


def asked_grams(small: Column) -> Column:
    """What a text is looked up by: its runs of GRAM letters, a shorter one as it is."""
    return F.when(F.length(small) < GRAM, F.array(small)).otherwise(F.array_distinct(_runs(small, GRAM)))


def _folder(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Where the tables are (rows, postings, counts), the rows' key, the columns that are searched, and the rows' schema."""

    path: str
    key: str
    columns: tuple[str, ...]
    schema: StructType

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        kind = self.schema[self.key].dataType.simpleString()
        of = {"postings": f"key {kind}, gram string, folder int", "counts": "gram string, n long", "rows": StructType([*self.schema, StructField("_folder", IntegerType())])}
        return spark.read.schema(of[table]).parquet(f"{self.path}/{table}")


def _shares(rows: DataFrame, texts: Column) -> DataFrame:
    """rows dealt to tasks by how many letters they have, however few partitions the table is read in: a task sorts its postings."""
    letters = rows.agg(F.sum(F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.length(t)))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(min(cores, letters // ENOUGH + 1), letters // MOST + 1))


def build(rows: DataFrame, key: str, columns: Sequence[str], path: str | None = None) -> SearchIndex:
    """Writes the index of rows (one for each key) to a folder that all executors share.

    postings: a row for each key and gram, in folders by gram and sorted in these, so that a search reads little of them; a
    gram that a third of all rows have is as many rows, never a list. counts: how many rows have each gram. rows: dealt to
    folders by key. Each task writes the postings and rows of at most MOST letters.
    """
    index = SearchIndex(path or f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}", key, tuple(columns), rows.schema)
    texts = F.filter(F.array(*(F.col(c).cast("string") for c in columns)), lambda t: t.isNotNull())
    rows = _shares(rows, texts)
    each = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.transform(texts, grams)))).alias("gram"))
    each.withColumn("folder", _folder(F.col("gram"))).sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{index.path}/postings")
    index.read(rows.sparkSession, "postings").groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{index.path}/counts")
    rows.withColumn("_folder", _folder(F.col(key))).write.partitionBy("_folder").parquet(f"{index.path}/rows")
    return index


def holds(columns: Sequence[str], small: Column | str) -> Column:
    """One of the columns has the text (in small letters) in it."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.contains(F.lower(F.col(c).cast("string")), small if isinstance(small, Column) else F.lit(small)), F.lit(False))
    return out


def search(spark: SparkSession, index: SearchIndex, text: str) -> DataFrame:
    """Rows with the text in one of the searched columns, capitals or not: the same as looking at every row.

    The postings of the text's grams are read (folder and gram are pushed down to the scan), keys that have all of them are
    candidates, and only folders that hold candidates are read of the rows, whose texts decide. An empty text finds all.
    """
    small, rows = text.lower(), index.read(spark, "rows")
    if not small:
        return rows.drop("_folder")
    parts = sorted({small[i : i + GRAM] for i in range(max(1, len(small) - GRAM + 1))})
    folders = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "g string").select(_folder(F.col("g"))).distinct().collect()]
    met = index.read(spark, "postings").where(F.col("folder").isin(folders) & F.col("gram").isin(parts))
    keys = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("key", _folder(F.col("key")).alias("_in"))
    found = rows.join(keys, (rows["_folder"] == keys["_in"]) & (rows[index.key] == keys["key"]), "left_semi")
    return found.where(holds(index.columns, small)).drop("_folder")


def search_many(spark: SparkSession, index: SearchIndex, asked: DataFrame, text: str) -> DataFrame:
    """asked with a row for each row found (key): every text of a table is searched for, all in one job.

    Of a text's grams, the one that the fewest rows have gives its candidates, so that common grams are hardly read; texts
    decide. Null and empty texts find nothing here; a text asked for twice is answered twice.
    """
    small = F.lower(F.col(text))
    texts = asked.select(small.alias("_small")).where("length(_small) > 0").distinct()
    every = texts.select("_small", F.explode(asked_grams(F.col("_small"))).alias("gram"))
    counted = every.join(index.read(spark, "counts"), "gram", "left")
    rarest = counted.groupBy("_small").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(index.read(spark, "postings").select("gram", "key"), "gram").select("_small", "key")
    rows = index.read(spark, "rows").select(F.col(index.key).alias("key"), *(F.col(c).alias(f"_{c}") for c in index.columns))
    found = candidates.join(rows, "key").where(holds([f"_{c}" for c in index.columns], F.col("_small"))).select("_small", "key")
    return asked.join(found, small == F.col("_small")).select(*asked.columns, "key")
