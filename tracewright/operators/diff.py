"""Comparisons of two captures: collections, flattened values, log lines and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import ordered_case, without_origins

# Bounds of a flattened value and of a list of differences; statuses from worst to best.
DEPTH, ITEMS, DIFFERENCES = 4, 12, 80
WORST_FIRST = ["fail", "best_effort", "retry"]
CONSOLE_TYPES = ["error", "warning", "warn", "log", "info", "debug"]


def collection_diff(left: Column, right: Column) -> Column:
    """changed, counts (with repeats) and the sorted distinct items on both sides or on one of two string arrays."""
    shared, only_left, only_right = F.array_intersect(left, right), F.array_except(left, right), F.array_except(right, left)
    return F.struct(
        ((F.size(only_left) > 0) | (F.size(only_right) > 0)).alias("changed"),
        F.size(left).alias("left_count"),
        F.size(right).alias("right_count"),
        F.array_sort(shared).alias("shared"),
        F.array_sort(only_left).alias("left_only"),
        F.array_sort(only_right).alias("right_only"),
    )


def sides(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """(key, side) of rows that belong to the left, the right or both: one pass, in which tasks reduce a key to two flags first."""
    found = rows.groupBy(key).agg(F.bool_or(left).alias("l"), F.bool_or(right).alias("r")).where("l or r")
    return found.select(key, F.when(F.col("l") & F.col("r"), "shared").when(F.col("l"), "left_only").otherwise("right_only").alias("side"))


def table_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): which distinct keys are on both sides, or on the left or right only. For collections too large for an array."""
    both = left.select(key, F.lit(True).alias("__left")).unionByName(right.select(key, F.lit(False).alias("__left")))
    return sides(both, key, F.col("__left"), ~F.col("__left"))


def network_group(line: Column) -> Column:
    """The group of a network line: by the hundreds of its status, or by what went wrong."""
    first = F.split_part(line, F.lit(" "), F.lit(1))
    status = F.floor(first.try_cast("long") / 100).cast("string")
    return ordered_case(
        [
            (first.rlike(r"^\d+$"), F.concat(F.lit("status_"), status, F.lit("xx"))),
            (line.startswith("network_policy_denied"), "policy_denied"),
            (F.contains(line, F.lit("request failed")), "request_failed"),
        ],
        "network_other",
    )


def console_group(line: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
    return F.when(kind.isin(CONSOLE_TYPES), kind).otherwise("console_other")


def grouped_lines(lines: DataFrame, key: str, line: str, group: Column) -> DataFrame:
    """(key, group, lines): distinct lines of a capture by group, sorted. A capture's lines are a bounded list."""
    return lines.select(key, line).distinct().groupBy(key, group.alias("group")).agg(F.array_sort(F.collect_list(line)).alias("lines"))


@F.udtf(returnType=T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
class FlattenJson:
    """The leaves of a JSON text as (path, JSON value): four levels deep, twelve items of a list and the number of the rest."""

    def eval(self, text: str):
        import json

        def walk(value, prefix: str, depth: int):
            if depth >= DEPTH or not isinstance(value, dict | list):
                yield prefix or "value", json.dumps(value, sort_keys=True, ensure_ascii=False)
            elif isinstance(value, dict):
                for key in sorted(value):
                    yield from walk(value[key], f"{prefix}.{key}" if prefix else key, depth + 1)
            else:
                for i, item in enumerate(value[:ITEMS]):
                    yield from walk(item, f"{prefix}[{i}]", depth + 1)
                if len(value) > ITEMS:
                    yield (f"{prefix}.truncated" if prefix else "truncated"), str(len(value) - ITEMS)

        if text is not None:
            try:
                value = json.loads(text)
            except ValueError:
                return
            yield from walk(value, "", 0)


def flatten(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of the JSON documents in a column; what is no JSON has no leaves."""
    table = docs.select(F.col(key).alias("key"), F.col(json).alias("json"))
    return table.lateralJoin(FlattenJson(F.col("json").outer())).select(F.col("key").alias(key), "path", "value")


def value_differences(left: DataFrame, right: DataFrame, keys: list[str], path: str = "path", value: str = "value", limit: int = DIFFERENCES) -> DataFrame:
    """(keys, path, left_value, right_value) where the values differ, nulls equal: the first ``limit`` paths of each key."""
    a = left.select(*keys, path, F.col(value).alias("left_value"))
    b = right.select(*keys, path, F.col(value).alias("right_value"))
    found = a.join(b, [*keys, path], "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    if not keys:
        return found.orderBy(path).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(path))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def compare_captures(pairs: DataFrame) -> DataFrame:
    """Adds ``network`` and ``console`` (``collection_diff`` of the lines without origins) and ``status``.

    ``pairs`` has id and, with prefix left_ and right_: origins, requests, console (string arrays) and status.
    """

    def clean(column: str, side: str) -> Column:
        return F.transform(f"{side}_{column}", lambda line: without_origins(line, F.col(f"{side}_origins")))

    return pairs.select(
        "id",
        collection_diff(clean("requests", "left"), clean("requests", "right")).alias("network"),
        collection_diff(clean("console", "left"), clean("console", "right")).alias("console"),
        worst_status(F.array("left_status", "right_status")).alias("status"),
    )


def worst_status(statuses: Column) -> Column:
    """The worst of an array of statuses: fail, best_effort, retry, else pass."""
    return ordered_case([(F.array_contains(statuses, s), s) for s in WORST_FIRST], "pass")


def screenshot_reason(pixel_status: Column, ratio: Column, max_ratio: Column, changed: Column) -> Column:
    """Why a screenshot fails its gate: too many changed pixels, or a change that could not be compared; null if it passes."""
    over = F.coalesce(ratio, F.lit(0.0)) > max_ratio
    return F.when(pixel_status == "compared", F.when(over, "pixel_ratio")).when(changed, "changed_without_pixels")


def gate_observations(comparisons: DataFrame, fail_on: list[str], max_ratio: float) -> DataFrame:
    """(id, observation): one row for everything that speaks against a comparison.

    ``comparisons`` has id, status, dom_changed, network_changed, console_changed, pixel_status, changed_ratio, screenshot_changed.
    """
    found = [F.when(F.col("status").isin("fail", "retry"), F.concat(F.lit("status_"), F.col("status")))]
    found += [F.when(F.col(f"{what}_changed"), f"{what}_changed") for what in ("dom", "network", "console") if what in fail_on]
    if "screenshot" in fail_on:
        found.append(screenshot_reason(F.col("pixel_status"), F.col("changed_ratio"), F.lit(max_ratio), F.col("screenshot_changed")))
    return comparisons.select("id", F.explode(F.array_compact(F.array(*found))).alias("observation"))


def gate_verdict(comparisons: DataFrame, observations: DataFrame) -> DataFrame:
    """One row, ``status``: fail with any observation, and fail without any comparison."""
    n = comparisons.agg(F.count(F.lit(1)).alias("comparisons")).crossJoin(observations.agg(F.count(F.lit(1)).alias("observations")))
    return n.select("comparisons", "observations", F.when((F.col("observations") > 0) | (F.col("comparisons") == 0), "fail").otherwise("pass").alias("status"))


