"""JSON evidence documents, with the four ways of treating bad ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(docs: DataFrame, json: str, schema: str) -> DataFrame:
    """Every document has to parse; a bad one fails the query."""
    return docs.withColumn("doc", F.from_json(json, schema, {"mode": "FAILFAST"}))


def lenient(docs: DataFrame, json: str, schema: str) -> DataFrame:
    """Documents that are no JSON objects are left out without a word."""
    return docs.where(_is_object(F.col(json))).withColumn("doc", F.from_json(json, schema))


def marked(docs: DataFrame, json: str, schema: str) -> DataFrame:
    """Every document stays; bad ones have no ``doc``, ``load_status`` unreadable and an error."""
    good = _is_object(F.col(json))
    return docs.withColumns(
        {
            "doc": F.when(good, F.from_json(json, schema)),
            "load_status": F.when(good, "ok").otherwise("unreadable"),
            "load_error": F.when(~good, F.when(F.try_parse_json(json).isNull(), "invalid JSON").otherwise("not an object")),
        }
    )


def json_or(json: Column, schema: str, default: Column | None = None) -> Column:
    """A column of a document; what does not parse is ``default``."""
    parsed = F.from_json(json, schema)
    return F.when(F.try_parse_json(json).isNotNull(), parsed).otherwise(default if default is not None else F.lit(None))


def string_list(json: Column) -> Column:
    """The strings of a JSON list; other members are dropped, and what is no list is empty."""
    members = F.from_json(json, "array<variant>")
    strings = F.filter(members, lambda v: F.schema_of_variant(v) == "STRING")
    empty = F.array().cast("array<string>")
    return F.when(F.substring(F.ltrim(json), 1, 1) == "[", F.coalesce(F.transform(strings, lambda v: v.cast("string")), empty)).otherwise(empty)


def entries(docs: DataFrame, json: str, element: str, keep_empty: bool = False) -> DataFrame:
    """One row for each member of the document's ``entries`` list; documents without any stay with ``keep_empty``."""
    parsed = docs.withColumn("__entries", F.from_json(json, f"struct<entries: array<{element}>>").getField("entries"))
    each = F.explode_outer("__entries") if keep_empty else F.explode("__entries")
    return parsed.select(*docs.columns, each.alias("entry"))


def _is_object(json: Column) -> Column:
    parsed = F.try_parse_json(json)
    return F.coalesce(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def project_history(artifacts: DataFrame, jobs: DataFrame, project_id: str, kinds: list[str], exclude_job: str | None = None, limit: int = 12) -> DataFrame:
    """The newest artifacts of a project's other jobs, soft-deleted ones left out."""
    own = jobs.where(F.col("project_id") == project_id).select(F.col("id").alias("job_id"))
    found = artifacts.where(F.col("kind").isin(kinds) & F.col("deleted_at").isNull()).join(own, "job_id")
    if exclude_job is not None:
        found = found.where(F.col("job_id") != exclude_job)
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def artifacts_of(artifacts: DataFrame, job_id: str, kind: str | None = None, stage: str | None = None, include_deleted: bool = False) -> DataFrame:
    """A job's artifacts by creation; the filters reach the scan."""
    found = artifacts.where(F.col("job_id") == job_id)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if stage is not None:
        found = found.where(F.col("stage") == stage)
    if not include_deleted:
        found = found.where("deleted_at is null")
    return found.orderBy("created_at", "id")
