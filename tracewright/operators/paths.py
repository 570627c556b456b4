"""Paths of generated modules: cleaned, with their extension, and each of them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.chains import cut, nearest, running

SCRIPT_EXTENSIONS = [".js", ".mjs", ".cjs", ".jsx"]


def extension(path: Column) -> Column:
    """From the last dot of the last part on; empty without one, and where the part only begins with it."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def module_path(path: Column) -> Column:
    """A path below the project: without a scheme, leading slashes, ``.`` and ``..``, with underscores for all but letters, digits, dots, hyphens and underscores; ``module`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", ""), "^/+", "")
    parts = F.filter(F.split(bare, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "[^A-Za-z0-9._-]", "_")), "/"), F.lit("")), F.lit("module"))


def typed_path(path: Column) -> Column:
    """The path with the extension ``.ts``, which takes the place of a script's; ``.ts`` and ``.tsx`` stay."""
    end = extension(path)
    cut_off = F.substring(path, F.lit(1), F.length(path) - F.length(end))
    return F.when(end.isin(".ts", ".tsx"), path).when(end.isin(SCRIPT_EXTENSIONS), F.concat(cut_off, F.lit(".ts"))).otherwise(F.concat(path, F.lit(".ts")))


def numbered(path: Column, number: Column) -> Column:
    """The path itself as number 1, else with ``-number`` before its extension."""
    end = extension(path)
    return F.when(number == 1, path).otherwise(F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(end)), F.lit("-"), number.cast("string"), end))


def unique_paths(df: DataFrame, path: str, seq: str, to: str = "unique_path", block: int = 1 << 16) -> DataFrame:
    """All rows with a path of their own: in order of ``seq`` (a unique number) each takes the first of path, path-2, path-3, ... that none before it took.

    A numbered path is met by one other path at most, the one that is so by itself. So the number of a row is its rank among equal paths, plus the numbers before it that were taken by
    such others, first rows of their paths. Whether one of them came first follows from the rows before it; all are settled at once, round after round, until nothing changes: a round for each level of
    names like a-2-2, and some where numbers taken are close together. A null path stays null. Rows are ranked in blocks of ``seq``, so that a path of very many rows is many small groups.
    """
    part = lambda at: F.floor(F.col(at) / block)
    named = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(seq).alias("seq"))
    rows = cut(running(named, ["path"], "seq", part("seq"), F.lit(1), "rank"))
    first = rows.where("rank = 1").select(F.col("path").alias("own"), F.col("seq").alias("first"))
    end = extension(F.col("own"))
    stem = F.substring("own", F.lit(1), F.length("own") - F.length(end))
    parent = F.concat(F.regexp_extract(stem, r"^(.*[^/])-([2-9]|[1-9][0-9]{1,17})$", 1), end)
    number = F.regexp_extract(stem, r"^(.*[^/])-([2-9]|[1-9][0-9]{1,17})$", 2).try_cast("bigint")
    met = first.select("own", "first", parent.alias("parent"), number.alias("number")).where((F.col("number") > 1) & (extension(F.col("parent")) == end))
    met = met.join(first.select(F.col("own").alias("parent")), "parent", "left_semi")
    met = cut(met.withColumns({"before": F.lit(True), "after": F.lit(False)}))
    while True:
        shifted = met.select(F.col("own").alias("parent"), F.col("after").cast("long").alias("shift"))
        counted = running(met, ["parent"], "number", part("number"), F.col("before").cast("long"), "sum")
        placed = counted.join(shifted, "parent", "left").fillna(0, ["shift"]).withColumn("rank", F.col("number") - F.col("shift") - F.col("sum") + F.col("before").cast("long"))
        landing = placed.join(rows.select(F.col("path").alias("parent"), "rank", F.col("seq").alias("at")), ["parent", "rank"], "left")
        now = {"now_before": F.coalesce(F.col("at") > F.col("first"), F.lit(False)), "now_after": F.coalesce(F.col("at") < F.col("first"), F.lit(False))}
        settled = cut(landing.withColumns(now))
        changed = not settled.where("before <> now_before or after <> now_after").isEmpty()
        met = settled.select("own", "first", "parent", "number", F.col("now_before").alias("before"), F.col("now_after").alias("after"), "rank", "sum", "shift")
        if not changed:
            break
        met = met.drop("rank", "sum", "shift")
    taken = met.where("before").groupBy(F.col("parent").alias("path"), "rank").agg(F.struct(F.max("sum").alias("n")).alias("taken"))
    found = nearest(rows, taken, ["path"], "rank", part("rank"), "taken", before=True)
    shifted = met.select(F.col("own").alias("path"), F.col("after").cast("long").alias("shift"))
    whole = found.join(shifted, "path", "left").withColumn("number", F.col("rank") + F.coalesce("shift", F.lit(0)) + F.coalesce("taken.n", F.lit(0)))
    unique = whole.select(F.col("seq").alias("__seq"), numbered(F.col("path"), F.col("number")).alias("__unique"))
    return df.join(unique, F.col(seq) == F.col("__seq"), "left").withColumn(to, F.col("__unique")).drop("__seq", "__unique")
