"""Policies of a job from the JSON of its configuration: layers in which an absent key, a null and a wrong type differ.

Configurations are VARIANT columns (``F.try_parse_json``). An absent key gives way to the next layer; a null or a value of another type does not, but counts as the default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.operators.reports import ATTEMPTS, MOST_ATTEMPTS, REPAIR_ACTIONS

# Classes that an attachment policy may name.
SENSITIVITY_CLASSES = ["public", "derived", "source_sensitive", "secret"]
RETENTION_CLASSES = ["ephemeral", "project", "archive"]


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """What ``build`` makes of a value that it may name more than once, but that is computed once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def child(value: Column, name: str) -> Column:
    """A member of an object: null if it is absent, the VARIANT null if it is null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def as_object(value: Column) -> Column:
    """The value if it is an object, else null."""
    return bound(value, lambda v: F.when(_type(v).startswith("OBJECT"), v))


def has(value: Column, name: str) -> Column:
    return child(value, name).isNotNull()


def whole_number(value: Column, default: int, least: int, most: int) -> Column:
    """An integer within bounds: fractions are cut, true is 1, texts of digits are read; anything else is the default."""

    def number(v: Column) -> Column:
        type_, text = _type(v), F.btrim(F.try_variant_get(v, "$", "string"))
        found = F.when(type_ == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("double"))).when(type_ == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
        return found.when(type_.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))

    held = bound(bound(value, number), lambda n: F.when(n > most, F.lit(most)).when(n < least, F.lit(least)).when(n.isNotNull(), n.cast("int")))
    return F.coalesce(held, F.lit(default))


def switch(value: Column, default: Column | bool) -> Column:
    """A boolean; anything else is the default."""
    return F.coalesce(bound(value, lambda v: F.when(_type(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))), default if isinstance(default, Column) else F.lit(default))


def ratio(value: Column, default: Column | float) -> Column:
    """A number of 0 at least; anything else is the default."""
    number = bound(value, lambda v: F.when(_type(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.greatest(F.try_variant_get(v, "$", "double"), F.lit(0.0))))
    return F.coalesce(number, default if isinstance(default, Column) else F.lit(default))


def texts(value: Column) -> Column:
    """The distinct strings of a list in its order, or a single string; null for anything else."""

    def listed(v: Column) -> Column:
        strings = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        type_ = _type(v)
        return F.when(type_ == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(type_.startswith("ARRAY"), F.array_distinct(F.array_compact(strings)))

    return bound(value, listed)


def allowed_actions(*configs: Column) -> Column:
    """Of the first configuration whose allowedRepairActions is a list those that are known, in its order; all of them if none has one."""
    known = F.array(*[F.lit(a) for a in REPAIR_ACTIONS])
    lists = [bound(child(c, "allowedRepairActions"), lambda v: F.when(_type(v).startswith("ARRAY"), texts(v))) for c in configs]
    return F.coalesce(*[F.filter(found, lambda a: F.array_contains(known, a)) for found in lists], known)


def review_policy(config: Column) -> Column:
    """Attempts and actions of review and repair, for builds and for comparisons."""
    review, build, runtime = (as_object(child(config, n)) for n in ("reviewFix", "buildValidation", "runtimeCompare"))
    of_build, of_runtime = (as_object(child(review, n)) for n in ("buildValidation", "runtimeCompare"))
    low_risk = switch(child(review, "allowLowRiskRepairs"), True)
    attempts = lambda *layers: whole_number(F.coalesce(*[child(v, "maxAttempts") for v in layers]), ATTEMPTS, 1, MOST_ATTEMPTS)
    # A layer that is there with another type than a boolean counts as true.
    of_builds = switch(F.coalesce(child(build, "allowLowRiskRepairs"), child(of_build, "allowLowRiskRepairs")), F.lit(True))
    named = F.coalesce(child(build, "allowLowRiskRepairs"), child(of_build, "allowLowRiskRepairs")).isNotNull()
    runtimes = child(of_runtime, "allowLowRiskRepairs")
    return F.struct(
        low_risk.alias("allow_low_risk"),
        allowed_actions(review, of_build, of_runtime, build).alias("actions"),
        F.struct(attempts(build, of_build, review).alias("max_attempts"), F.when(named, of_builds).otherwise(low_risk).alias("allow_low_risk"), allowed_actions(review, of_build, build).alias("actions")).alias("build"),
        F.struct(attempts(runtime, of_runtime, review).alias("max_attempts"), F.when(runtimes.isNotNull(), switch(runtimes, True)).otherwise(low_risk).alias("allow_low_risk"), allowed_actions(review, of_runtime).alias("actions")).alias("runtime"),
    )


def gate_policy(config: Column) -> Column:
    """Which changes a comparison fails on, and the ratio of changed pixels that it bears; without runtimeCompare the configuration itself is read."""
    runtime = F.coalesce(as_object(child(config, "runtimeCompare")), as_object(config))
    gate = as_object(child(runtime, "reviewGate"))
    names = {"enabled": "enabled", "failOnDomChanged": "dom", "failOnNetworkChanged": "network", "failOnConsoleChanged": "console", "failOnScreenshotChanged": "screenshot"}
    bearable = ratio(child(gate, "maxChangedPixelRatio"), ratio(child(as_object(child(runtime, "imageDiff")), "maxChangedPixelRatio"), 0.0))
    return F.struct(*[switch(child(gate, name), True).alias(to) for name, to in names.items()], bearable.alias("max_ratio"))


def attachment_policy(config: Column, sensitivity: list[str] = SENSITIVITY_CLASSES, retention: list[str] = RETENTION_CLASSES) -> Column:
    """Which artifacts go into an archive; a list that is absent or of another type is null and limits nothing, an empty one lets nothing pass."""
    return bound(as_object(child(as_object(child(config, "packaging")), "evidenceAttachments")), lambda raw: _attachments(raw, sensitivity, retention))


def _attachments(raw: Column, sensitivity: list[str], retention: list[str]) -> Column:
    within = lambda found, known: F.filter(found, lambda c: c.isin(known))
    most = bound(child(raw, "maxBytesPerArtifact"), lambda size: F.when(_type(size) == "BIGINT", F.try_variant_get(size, "$", "bigint")))
    return F.struct(
        F.array_sort(texts(child(raw, "includeKinds"))).alias("include_kinds"),
        F.coalesce(F.array_sort(texts(child(raw, "excludeKinds"))), F.array().cast("array<string>")).alias("exclude_kinds"),
        F.array_sort(within(texts(child(raw, "includeSensitivityClasses")), sensitivity)).alias("sensitivity_classes"),
        F.array_sort(within(texts(child(raw, "includeRetentionClasses")), retention)).alias("retention_classes"),
        F.when(most >= 0, most).alias("max_bytes"),
    )
