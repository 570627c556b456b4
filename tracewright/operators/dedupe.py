"""Latest, best and first rows of a key, with every tie rule written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.chains import running


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total; null keys are equal."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_one(df, keys, [F.col(seq).asc_nulls_last()])


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_one(df, keys, [F.col(seq).desc_nulls_last()])


def keep_best(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of highest score; of equals the first by ``ties``."""
    return keep_one(df, keys, [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]])


def attempt_number(value: Column) -> Column:
    """An attempt as an integer of 0 at least; what is no integer by type (a boolean, a fraction, a text, null) is 0."""
    whole = F.typeof(value).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("int")


def latest_attempts(df: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    """All rows of the highest ``attempt_number`` of each key: a partial maximum and a join, so that a key of very many rows is no group."""
    top = df.groupBy(*keys).agg(F.max(attempt_number(F.col(attempt))).alias("__top"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = df.alias("a").join(top.alias("b"), [*same, attempt_number(F.col(f"a.{attempt}")) == F.col("b.__top")], "left_semi")
    return joined.select([F.col(f"a.{c}") for c in df.columns])


def numbered_names(df: DataFrame, name: str, seq: str, to: str = "unique_name", block: int = 1 << 16) -> DataFrame:
    """Repeated names get -2, -3, ... in order of ``seq``; a generated name may meet a given one (``paths.unique_paths`` makes names that do not).

    Where ``seq`` is a whole number, unique in a name, names are ranked in blocks of it, so that a name of very many rows is many small groups.
    """
    if isinstance(df.schema[seq].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = df.withColumn("__name", F.coalesce(name, F.lit(""))).withColumn("__null", F.col(name).isNull())
        ranked = running(key, ["__name", "__null"], seq, F.floor(F.col(seq) / block), F.lit(1), "__n").drop("__name", "__null")
    else:
        ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(seq)))
    n = F.col("__n")
    return ranked.withColumn(to, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string")))).drop("__n")


def row_index(df: DataFrame, keys: list[str], order: list[Column], to: str = "row_index") -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def top_with_rest(df: DataFrame, keys: list[str], order: list[Column], k: int, label: str) -> DataFrame:
    """The first ``k`` rows of each key, and one row for the rest: (keys, position, label, more).

    Tasks pass on ``k`` rows of a key and its number of rows, so that no task sorts a whole key.
    """
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= k)
    shown = ranked.select(*keys, "position", F.col(label).cast("string").alias("label"), F.lit(0).cast("long").alias("more"))
    rest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    rest = rest.select(*keys, F.lit(k + 1).alias("position"), F.lit(None).cast("string").alias("label"), (F.col("n") - k).alias("more"))
    return shown.unionByName(rest)
