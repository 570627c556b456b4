"""Chains: rows in order, of which each one that counts decides which later one counts next.

A compare-and-set write counts only if it names the revision that the writes before it left; a failure is cached only if no earlier one still is. Such folds
run here without a loop over rows: every row is linked to the one that would count after it (``nearest``), and ``reached`` doubles the way that a
link spans until the chain from each start is known, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark runs in one process (tests), a new local one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in the shared folder, which cuts its lineage and outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def nearest(asking: DataFrame, points: DataFrame, keys: list[str], at: str, block: Column, found: str, before: bool = False) -> DataFrame:
    """``asking`` with the struct ``found`` of the first point of its keys at or after ``at``, or of the last one at or before it; null if there is none.

    ``points`` has the keys, ``at`` and ``found``; keys are not null and points of one key differ in ``at``. ``block`` is a number that does not fall as ``at`` grows: rows are sorted within the blocks of a
    key only, and what a block lacks comes from the ends of the others, so that a key of very many rows is many small groups.
    """
    down = F.asc if before else F.desc
    rows = asking.select(*keys, block.alias("__block"), F.col(at).alias("__at"), F.struct(*asking.columns).alias("__row"))
    both = rows.unionByName(points.select(*keys, block.alias("__block"), F.col(at).alias("__at"), F.col(found).alias("__point")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__block").orderBy(down("__at"), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__near", F.last("__point", ignorenulls=True).over(inside)).where("__row is not null")
    end = (F.max_by if before else F.min_by)("__point", F.when(F.col("__point").isNotNull(), F.col("__at")))
    across = Window.partitionBy(*keys).orderBy(down("__block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "__block").agg(end.alias("__end"))
    far = ends.select(*keys, "__block", F.last("__end", ignorenulls=True).over(across).alias("__far"))
    return near.join(far, [*keys, "__block"]).select("__row.*", F.coalesce("__near", "__far").alias(found))


def running(df: DataFrame, keys: list[str], at: str, block: Column, value: Column, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its keys up to and with this one, in order of ``at``, which no two rows of them share; sorted in blocks as in ``nearest``."""
    rows = df.withColumns({"__block": F.coalesce(block, F.lit(-(1 << 62))), "__value": value})
    inside = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum")).select(*keys, "__block", F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__before"))
    found = rows.withColumn("__inside", F.sum("__value").over(inside)).join(before, [*keys, "__block"])
    return found.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(to))


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(id) of all rows that following ``links`` (id, next) from ``starts`` (id) meets, the starts included; links lead forward, so that there is no cycle."""
    jump = cut(links.where("next is not null").select("id", "next"))
    found = cut(starts.select("id").distinct())
    while True:
        more = cut(found.join(jump, "id").select(F.col("next").alias("id")).distinct())
        if more.isEmpty():
            return found
        found = found.union(more)
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("then"))
        jump = cut(jump.join(further, "next").select("id", F.col("then").alias("next")))
