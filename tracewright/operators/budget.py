"""Budgets: trimming parts in a fixed order, bounded previews, sampling of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import prompt_tokens
from tracewright.operators.chains import running

#: Numbers of scenarios that are sorted together.
BLOCK = 1 << 16


def running_tokens(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Adds tokens and the running total of a key in order."""
    return parts.withColumn("tokens", prompt_tokens(F.col(text))).withColumn("running", F.sum("tokens").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def trimmed(parts: DataFrame, key: str, budget: str) -> DataFrame:
    """All parts with ``kept``. Parts go in order of (step, seq) until the rest is within the budget; a null step never goes.

    ``parts`` has key, step, seq, whole_step (the parts of the step go together), tokens and the key's budget. A key is one prompt:
    a bounded list of parts.
    """
    total = F.sum("tokens").over(Window.partitionBy(key))
    unit = F.when(F.col("whole_step"), F.lit(0)).otherwise(F.col("seq"))
    place = F.struct(F.col("step").isNull().alias("last"), F.col("step"), F.col("unit"))
    marked = parts.withColumn("total", total).withColumn("unit", unit).withColumn("place", place)
    # Peers of a place go together: what is gone before is all up to it less its own.
    upto = F.sum("tokens").over(Window.partitionBy(key).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("tokens").over(Window.partitionBy(key, "place"))
    goes = F.col("step").isNotNull() & (F.col("total") - (upto - own) > F.col(budget))
    return marked.withColumn("kept", ~goes).drop("unit", "place", "total")


def preview(items: Column, k: int = 5) -> Column:
    """The first ``k`` of an array and the number of the rest."""
    return F.struct(F.slice(items, 1, k).alias("shown"), F.greatest(F.size(items) - k, F.lit(0)).alias("more"))


def strings_of_first(items: Column, k: int) -> Column:
    """The non-null strings among the first ``k`` items: cut first, filtered then."""
    return F.filter(F.slice(items, 1, k), lambda x: x.isNotNull())


def viewport_matrix(scenarios: DataFrame, default_viewports: list[str]) -> DataFrame:
    """(scenario, viewport, index): own viewports of a scenario, or the default ones where it has none."""
    default = F.array(*[F.lit(v) for v in default_viewports])
    own = F.when(F.size(F.coalesce("viewports", F.array().cast("array<string>"))) > 0, F.col("viewports")).otherwise(default)
    rows = scenarios.select("scenario", "seq", F.posexplode(own).alias("place", "viewport")).withColumn("at", F.struct("seq", "place"))
    # Blocks of scenarios are counted, then numbered by themselves.
    return running(rows, [], "at", F.floor(F.col("seq") / BLOCK), F.lit(1), "n").select("scenario", "viewport", (F.col("n") - 1).cast("int").alias("index"))


def balanced(matrix: DataFrame, k: int) -> DataFrame:
    """``k`` rows of a matrix (``index`` from 0, each once), evenly spread with halves to even; all of them if there are no more.

    A row tells from its index and the number of rows whether it is one of them.
    """
    if k <= 0:
        return matrix.limit(0)
    sized = matrix.crossJoin(F.broadcast(matrix.agg(F.count(F.lit(1)).alias("__n"))))
    place = lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(k - 1, 1)))
    near = F.floor(F.col("index") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    chosen = F.lit(False)
    for step in (-1, 0, 1, 2):
        chosen = chosen | ((near + step).between(0, k - 1) & (place(near + step) == F.col("index")))
    return sized.where((F.col("__n") <= k) | chosen).drop("__n")
