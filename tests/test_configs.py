"""JSON trees and policies of configurations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import rows
from tracewright.functions.text import without_origins
from tracewright.operators import policies, settings, trees


def documents(n, seed=3):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(6, 8) if depth < 2 else rng.randrange(8 if depth < 5 else 6)
        if kind < 6:
            return [None, True, False, rng.randrange(3), 1.5, rng.choice(["", "é\n\"x\\", "https://a.b/c https://a.b:1/", "日本"])][kind]
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randrange(1, 5))]
        return {rng.choice(["a", "b.c", "Pass-Word", "token", "Access-Token", 'q"', "ü"]): value(depth + 1) for _ in range(rng.randrange(1, 5))}

    return [(i, value(0)) for i in range(n)]


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.fixture(scope="module")
def parts(spark):
    docs = documents(80)
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(900, None), (901, "no json"), (902, "")], "id long, json string").repartition(3)
    return docs, trees.leaves(df, "id", "json")


def test_trees_come_back(parts):
    docs, leaves = parts
    found = {r.id: r.json for r in trees.put_together(leaves, "id").collect()}
    assert {i: canonical(json.loads(t)) for i, t in found.items()} == {i: canonical(v) for i, v in docs}
    assert not set(found) & {900, 901, 902}


def test_no_python_in_the_plan(parts):
    plan = trees.put_together(trees.with_texts(parts[1], F.upper), "id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_change_in_strings_only(parts):
    docs, leaves = parts
    origins = F.array(F.lit("https://a.b"), F.lit("https://a.b:1"))

    def changed(v):
        if isinstance(v, dict):
            return {k: changed(x) for k, x in v.items()}
        if isinstance(v, list):
            return [changed(x) for x in v]
        return v.replace("https://a.b:1", "<runtime-origin>").replace("https://a.b", "<runtime-origin>") if isinstance(v, str) else v

    found = trees.put_together(trees.with_texts(leaves, lambda t: without_origins(t, origins)), "id")
    assert {r.id: json.loads(r.json) for r in found.collect()} == {i: changed(v) for i, v in docs}


def test_hidden_values(parts):
    docs, leaves = parts

    def plain(name):
        return "".join(c for c in name.replace("-", "_").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789_")

    def hidden(v):
        if isinstance(v, dict):
            return {k: "<redacted>" if plain(k) in settings.SECRET_NAMES and x not in (None, "", False) else hidden(x) for k, x in v.items()}
        return [hidden(x) for x in v] if isinstance(v, list) else v

    found = trees.put_together(trees.hide_values(leaves, "id", settings.SECRET_NAMES, "<redacted>"), "id")
    want = {i: hidden(v) for i, v in docs}
    assert {r.id: json.loads(r.json) for r in found.collect()} == want and canonical(list(want.values())).count("<redacted>") > 5


def test_levels_are_stored_only_in_deep_documents(spark):
    def nested(n):
        return json.loads('{"k":[' * n + "1" + ',2,"é\\\\\\""]}' * n)

    flat = spark.range(3).select("id", F.lit(json.dumps(nested(2))).alias("json"))
    assert "ExistingRDD" not in trees.leaves(flat, "id", "json")._jdf.queryExecution().executedPlan().toString()
    deep = spark.createDataFrame([(n, json.dumps(nested(n))) for n in (1, 4, 5, 11)] + [(20, "3"), (21, "[]")], "id long, json string")
    found = {r.id: r.json for r in trees.put_together(trees.leaves(deep, "id", "json"), "id").collect()}
    assert found == {**{n: canonical(nested(n)) for n in (1, 4, 5, 11)}, 20: "3", 21: "[]"}


def test_forbidden_fields(spark):
    outputs = [(1, "a", '{"x": {"y": [{"z": 1}]}, "v": 2}'), (2, "a", '{"x": []}'), (3, "b", '{"x": 1}'), (4, "a", "[]"), (5, "a", None), (6, "a", "{}")]
    allowed = spark.createDataFrame([("a", "$.x"), ("a", "$.x.y"), ("a", "$.x.y")], "role string, path string")
    found = trees.forbidden_paths(spark.createDataFrame(outputs, "id long, role string, json string"), allowed)
    assert rows(found, "id", "role", "path") == [(1, "a", "$.v"), (1, "a", "$.x.y[*].z"), (3, "b", "$.x"), (4, "a", "$"), (5, "a", "$")]


def test_numbers_of_every_type(spark):
    cases = [("2", 2), (None, 3), ("null", 3), ("7", 5), ("-4", 1), ("2.9", 2), ("true", 1), ("false", 1), ('" 4 "', 4), ('"4.5"', 3), ('"x"', 3), ("[]", 3), ("1e30", 5), ('"99999999999999999999"', 5)]
    df = spark.createDataFrame(cases, "json string, want int").withColumn("got", policies.whole_number(F.try_parse_json("json"), 3, 1, 5))
    assert all(r.got == r.want for r in df.collect())


def test_lists_of_texts(spark):
    df = spark.createDataFrame([('["a", 1, "a", null, "b"]',), ('"x"',), ("{}",), ("null",), (None,)], "json string")
    assert [r[0] for r in df.select(policies.texts(F.try_parse_json("json"))).collect()] == [["a", "b"], ["x"], None, None, None]


def test_values_are_taken_from_a_configuration_once(spark):
    found = spark.range(2).select(F.try_parse_json(F.col("id").cast("string")).alias("config")).select(policies.attachment_policy(F.col("config")).alias("p")).select("p.*")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.evidenceAttachments") == plan.count("$.packaging") == 1 and plan.count("$.includeKinds") == 1
