"""Audit records: inferences, reviews and tool calls in one schema, by risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case

# Statuses that need attention, and risk groups in order.
ATTENTION = ["best_effort", "fail", "needs_review", "rejected", "retry", "unverified"]
RISK_GROUPS = ["blocking", "review", "passing"]

RECORD = ["category", "id", "label", "detail", "secondary", "status", "failure_class"]


def tone(status: Column) -> Column:
    return F.when(status.isin("pass", "accepted"), "pass").when(status.isin("fail", "rejected"), "fail").otherwise("warn")


def needs_attention(status: Column, failure_class: Column) -> Column:
    return F.coalesce(failure_class != "none", F.lit(False)) | F.coalesce(status.isin(ATTENTION), F.lit(False))


def risk_group(status: Column, failure_class: Column) -> Column:
    failed = F.coalesce(failure_class != "none", F.lit(False)) | (tone(status) == "fail")
    return ordered_case([(failed, "blocking"), (needs_attention(status, failure_class), "review")], "passing")


def union_records(*parts: DataFrame) -> DataFrame:
    """Several record types in one schema; columns that a part lacks are null."""
    out = None
    for part in parts:
        for name in RECORD:
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast("string"))
        part = part.select(*[F.col(c).cast("string").alias(c) for c in RECORD])
        out = part if out is None else out.unionByName(part)
    return out


def matches(category: str = "all", status: str = "all", query: str = "") -> Column:
    """The records that a filter shows; unknown filter values count as ``all``, and the query is a part of any field."""
    found = F.lit(True)
    if category != "all":
        found = found & (F.col("category") == category)
    if status == "attention":
        found = found & needs_attention(F.col("status"), F.col("failure_class"))
    elif status in ("pass", "fail"):
        found = found & (tone(F.col("status")) == status)
    if text := query.strip().lower():
        found = found & F.contains(F.lower(F.concat_ws(" ", *RECORD)), F.lit(text))
    return found


def counts_by_risk(records: DataFrame) -> DataFrame:
    """risk_group, n for every group, empty ones too."""
    groups = records.sparkSession.createDataFrame([(g,) for g in RISK_GROUPS], "risk_group string")
    counts = records.groupBy(risk_group(F.col("status"), F.col("failure_class")).alias("risk_group")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, "risk_group", "left").select("risk_group", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status_counts(records: DataFrame, status: str = "status") -> DataFrame:
    """status, n; null and blank statuses are ``unknown``."""
    return records.groupBy(F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def failure_summary(evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """The failures of the evidence, or those of the jobs where there is no evidence of any (job_id, failure_class, reason)."""
    found = evidence.where("failure_class <> 'none'").select("job_id", "failure_class", "reason")
    rest = jobs.where("failure_class <> 'none'").select("job_id", "failure_class", "reason").join(found, "job_id", "left_anti")
    return found.unionByName(rest)


def zero_filled(df: DataFrame, states: list[str], column: str) -> DataFrame:
    """state, n for each of ``states``, 0 where none has it."""
    grid = df.sparkSession.createDataFrame([(s,) for s in states], "state string")
    counts = df.groupBy(F.col(column).cast("string").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
