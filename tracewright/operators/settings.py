"""Layered settings with revisions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewright.operators.dedupe import keep_one

# Parts of the names of settings that hold secrets; names of values that no archive may hold, and the form of placeholders.
SECRET_PARTS = ["apikey", "password", "credential", "token", "secret"]
SECRET_NAMES = ["access_token", "accesstoken", "password", "private_key", "privatekey", "secret", "secret_access_key", "secret_value", "secretaccesskey", "secretvalue", "token", "value"]
PLACEHOLDER = "<[^>]+>"


def latest_settings(revisions: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, scope_id, revision, settings) of every scope: its latest revision, or revision 0 with no settings."""
    last = keep_one(revisions, ["scope", "scope_id"], [F.col("revision").desc()]).select("scope", "scope_id", "revision", "settings")
    return scopes.join(last, ["scope", "scope_id"], "left").select("scope", "scope_id", F.coalesce("revision", F.lit(0)).alias("revision"), F.coalesce("settings", F.lit("{}")).alias("settings"))


def merged(base, update):
    """Objects merge key by key, the update winning; anything else is replaced, lists too."""
    if isinstance(base, dict) and isinstance(update, dict):
        return {**base, **{k: merged(base[k], v) if k in base else v for k, v in update.items()}}
    return update


def hidden(value):
    """Values of secret settings give way to a marker, empty ones excepted; references to secrets stay."""
    if isinstance(value, list):
        return [hidden(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for name, inner in value.items():
        plain = name.lower().replace("_", "")
        if not any(part in plain for part in SECRET_PARTS):
            out[name] = hidden(inner)
        else:
            out[name] = inner if plain.endswith("secretref") or inner in (None, "", False) else "[redacted]"
    return out


FINDINGS = StructType([StructField("path", StringType()), StructField("finding", StringType())])


@F.udtf(returnType=FINDINGS)
class FindInJson:
    """(path, finding) in a JSON text: named secrets, flags that secrets are held, and placeholders left in strings."""

    def eval(self, text: str):
        def walk(value, path: str, quiet: bool):
            # Below a named secret only placeholders and flags are looked for.
            if isinstance(value, dict):
                for name, inner in value.items():
                    plain = re.sub("[^a-z0-9_]", "", name.replace("-", "_").lower())
                    secret = not quiet and plain in SECRET_NAMES and inner not in (None, "", False)
                    if secret:
                        yield f"{path}.{name}", "secret"
                    if name == "containsSecretValues" and inner is True:
                        yield f"{path}.{name}", "flag"
                    yield from walk(inner, f"{path}.{name}", quiet or secret)
            elif isinstance(value, list):
                for i, inner in enumerate(value):
                    yield from walk(inner, f"{path}[{i}]", quiet)
            elif isinstance(value, str) and re.search(PLACEHOLDER, value):
                yield path, "placeholder"

        yield from walk(_load(text), "$", False)


def findings(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, finding) of the JSON documents in a column; what is no JSON has none."""
    table = docs.select(F.col(key).alias("key"), F.col(json).alias("json"))
    return table.lateralJoin(FindInJson(F.col("json").outer())).select(F.col("key").alias(key), "path", "finding")


def _text(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _load(text):
    try:
        return json.loads(text) if text else {}
    except ValueError:
        return {}


@F.pandas_udf(StringType())
def merge_json(base, update):
    return base.combine(update, lambda a, b: _text(merged(_load(a), _load(b))))


@F.pandas_udf(StringType())
def canonical_json(text):
    """Sorted keys and no spaces, the form that fingerprints are taken of; null for what is no JSON."""

    def one(value):
        try:
            return _text(json.loads(value))
        except (TypeError, ValueError):
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def redact_json(text):
    return text.map(lambda t: None if t is None else _text(hidden(_load(t))))


def effective(jobs: DataFrame, system: str, projects: DataFrame) -> DataFrame:
    """(job_id, settings): the system's, then the project's, then the job's own settings on top."""
    layered = jobs.join(projects.withColumnRenamed("settings", "project_settings"), "project_id", "left")
    under = merge_json(F.lit(system), F.coalesce("project_settings", F.lit("{}")))
    return layered.select("job_id", merge_json(under, F.coalesce("settings", F.lit("{}"))).alias("settings"))
