"""Retention classes, expiry and the outcome of a clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The category of an artifact kind (others are derived), and the class of a category.
CATEGORY_OF_KIND = {
    "source_input": "source",
    "result_package": "package",
    "audit_report": "package",
    "html_report": "package",
    "evidence_index": "package",
    "build_log": "logs",
    "runtime_trace": "logs",
    "runtime_screenshot": "screenshots",
    "memory_record": "memory",
    "tool_registry": "derived",
    "runtime_diagnosis": "derived",
    "report_section": "derived",
}
CLASS_OF_CATEGORY = {"source": "archive", "derived": "project", "package": "archive", "logs": "ephemeral", "screenshots": "ephemeral", "memory": "project"}
EPHEMERAL_DAYS = 7


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def category(kind: Column) -> Column:
    return _lookup(CATEGORY_OF_KIND, kind, "derived")


def default_class(kind: Column) -> Column:
    return _lookup(CLASS_OF_CATEGORY, category(kind), "project")


def default_expiry(retention_class: Column, created_at: Column) -> Column:
    """A week for what is ephemeral, never for the rest."""
    return F.when(retention_class == "ephemeral", created_at + F.expr(f"INTERVAL {EPHEMERAL_DAYS} DAYS"))


def expired(expires_at: Column, now: Column) -> Column:
    """Inclusive: what expires now is expired. No expiry is never."""
    return F.coalesce(expires_at <= now, F.lit(False))


def matches(now: Column, categories: list[str] | None = None, classes: list[str] | None = None, delete_expired: bool = False) -> Column:
    """What a clean-up covers: every given selector has to hold; with none, nothing matches."""
    if not delete_expired and not categories and not classes:
        return F.lit(False)
    found = expired(F.col("expires_at"), now) if delete_expired else F.lit(True)
    if categories:
        found = found & category(F.col("kind")).isin(categories)
    if classes:
        found = found & F.coalesce(F.col("retention_class").isin(classes), F.lit(False))
    return found


def outcomes(artifacts: DataFrame, condition: Column, dry_run: bool) -> DataFrame:
    """(id, outcome) of the artifacts that match and are not deleted yet. Removing the blobs is the caller's part."""
    return artifacts.where(F.col("deleted_at").isNull() & condition).select("id", F.lit("dry_run" if dry_run else "deleted").alias("outcome"))
