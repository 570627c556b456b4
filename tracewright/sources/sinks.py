"""What is written: append-only tables, expositions and index documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import prometheus_sample
from tracewright.operators import retention


def with_artifact_defaults(artifacts: DataFrame, now: Column) -> DataFrame:
    """New artifacts get their kind's retention class and expiry where they have none of their own."""
    kept = F.coalesce("retention_class", retention.default_class(F.col("kind")))
    return artifacts.withColumns({"retention_class": kept, "expires_at": F.coalesce("expires_at", retention.default_expiry(kept, now)), "created_at": F.coalesce("created_at", now)})


def append(table: DataFrame, path: str) -> None:
    """Append-only tables take rows as they are; latest-per-key views give the present state."""
    table.write.mode("append").parquet(path)


def exposition(samples: DataFrame) -> DataFrame:
    """The lines of a metrics page, sorted, from (name, labels, value)."""
    return samples.select(prometheus_sample(F.col("name"), F.col("labels"), F.col("value")).alias("line")).orderBy("line")


def evidence_index(artifacts: DataFrame) -> DataFrame:
    """One JSON document for each job: its artifacts by kind, in order of creation. A job's artifacts are a bounded list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda a: a["id"])
    kinds = artifacts.groupBy("job_id", "kind").agg(ordered.alias("ids"))
    return kinds.groupBy("job_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("kind", "ids"))).alias("sections"))).alias("index"))
