"""Rules over texts: runtime markers, framework tokens, risk and failure classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import ordered_case, slug
from tracewright.operators.dedupe import keep_best

# Markers of bundle runtimes, in order of preference, and tokens of frameworks with their confidence.
RUNTIME_MARKERS = {
    "webpack": ["__webpack_require__", "webpackJsonp", "webpackChunk"],
    "vite_or_rollup": ["__vitePreload", "import.meta", "modulepreload"],
    "rollup": ["Object.freeze", "__esModule"],
    "esbuild": ["__defProp", "__export", "__toESM", "__commonJS"],
    "umd": ["typeof exports", "define.amd", "factory"],
    "browserify": ["function r(e,n,t)", "function o(i,f)", "browserify"],
    "systemjs": ["System.register", "System.import"],
    "parcel": ["parcelRequire", "newRequire"],
}
COMMONJS = r"\bmodule\.exports\b|\bexports\.[A-Za-z_$]"
FRAMEWORK_TOKENS = {
    "react": (["react", "react-dom", "jsx", "createelement", "usestate", "useeffect"], 0.72),
    "vue": (["vue", "createapp", "definecomponent", "__vue", ".vue"], 0.72),
    "vite_rollup": (["vite", "import.meta", "vite_or_rollup", "assets/"], 0.68),
    "webpack": (["__webpack_require__", "webpack", "webpackchunk"], 0.7),
}
# Tokens of globals with their confidence, and statuses that give feedback.
GLOBAL_TOKENS = {
    "dom_globals": (["window", "document", "navigator", "location"], 0.66),
    "node_globals": (["process", "buffer", "__dirname", "__filename", "global"], 0.65),
    "global_this": (["globalthis"], 0.6),
}
FEEDBACK = ["fail", "retry", "best_effort"]


def _any(text: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | F.contains(text, F.lit(token))
    return F.coalesce(found, F.lit(False))


def runtime_kinds(source: Column) -> Column:
    """The bundle runtimes whose markers a source text holds, as an array in fixed order."""
    return F.array_compact(F.array(*[F.when(_any(source, markers), kind) for kind, markers in RUNTIME_MARKERS.items()]))


def source_kinds(source: Column, links: Column, single_bundle: Column) -> Column:
    """The runtimes of a script: those of its markers, of its imports and exports (``links``, their number), and ``commonjs``; else ``iife`` for a bundle that stands alone, else ``unknown``."""
    modular = F.coalesce(links, F.lit(0)) > 0
    common = F.coalesce(source.rlike(COMMONJS), F.lit(False))
    found = F.array_distinct(F.concat(runtime_kinds(source), F.array_compact(F.array(F.when(modular, "vite_or_rollup"), F.when(common, "commonjs")))))
    return F.when(F.size(found) > 0, found).when(F.coalesce(single_bundle, F.lit(False)), F.array(F.lit("iife"))).otherwise(F.array(F.lit("unknown")))


def preferred_kind(kinds: Column) -> Column:
    """The first of the known order among several."""
    return F.get(F.filter(F.array(*[F.lit(k) for k in [*RUNTIME_MARKERS, "commonjs", "iife", "unknown"]]), lambda k: F.array_contains(kinds, k)), F.lit(0))


def marker_offset(source: Column, marker: Column) -> Column:
    """Characters before a marker; -1 without it."""
    return F.instr(source, marker) - 1


def framework_hits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, confidence) for each framework of which a text holds a token in any case."""
    low = F.lower(F.col(text))
    hits = [F.when(_any(low, tokens), F.struct(F.lit(f"knowledge_framework_{name}").alias("id"), F.lit(confidence).alias("confidence"))) for name, (tokens, confidence) in FRAMEWORK_TOKENS.items()]
    return texts.select(key, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(key, "hit.id", "hit.confidence")


def merged_hits(hits: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and, for those of ``keys`` without any, the fallback; of an id the most confident, the first of equals."""
    rest = fallback.join(hits.select(*keys).distinct(), keys, "left_anti")
    return keep_best(hits.unionByName(rest), [*keys, "id"], "confidence", ["seq"])


def by_part(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first part that the text holds in any case."""
    return ordered_case([(F.contains(F.lower(text), F.lit(part)), value) for part, value in rules], default)


def _hit(id: Column | str, category: str, confidence: Column | float, *kinds: str) -> Column:
    id, confidence = (x if isinstance(x, Column) else F.lit(x) for x in (id, confidence))
    return F.struct(id.alias("id"), F.lit(category).alias("category"), confidence.cast("double").alias("confidence"), F.array(*[F.lit(k) for k in kinds]).alias("source_kinds"))


def _some(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def _hits(df: DataFrame, keys: list[str], *found: Column) -> DataFrame:
    """(keys, position, id, category, confidence, source_kinds) of the hits that are not null, in order."""
    return df.select(*keys, F.posexplode(F.array_compact(F.array(*found))).alias("position", "hit")).select(*keys, "position", "hit.*")


def structural_hits(packages: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of what a package holds: entries, source maps, exports, chunks, manifests, styles.

    ``packages`` has arrays entries, scripts, styles, source_maps, manifests, runtimes and the booleans has_exports, single_bundle; null arrays are empty.
    """
    both = ("input_inventory", "ast_index")
    runtime = lambda name: F.coalesce(F.array_contains("runtimes", name), F.lit(False))
    return _hits(
        packages,
        keys,
        F.when(_some("entries"), _hit("knowledge_html_entry", "runtime_entry", 0.8, both[0])).otherwise(_hit("knowledge_browser_shim_missing_html_entry", "browser_shim", 0.72, both[0])),
        F.when(_some("source_maps"), _hit("knowledge_source_map_available", "source_map", 0.7, both[0])),
        F.when(F.col("has_exports"), _hit("knowledge_esm_exports", "module_pattern", 0.65, both[1])),
        F.when((F.coalesce(F.size("scripts"), F.lit(0)) > 1) | runtime("multi_chunk"), _hit("knowledge_runtime_multi_chunk", "build_runtime", 0.74, *both)),
        F.when(F.coalesce("single_bundle", F.lit(False)) | runtime("single_bundle_best_effort"), _hit("knowledge_runtime_single_bundle", "build_runtime", 0.68, *both)),
        F.when(_some("manifests"), _hit("knowledge_runtime_manifest", "build_runtime", 0.64, both[0])),
        F.when(_some("styles"), _hit("knowledge_runtime_stylesheet_assets", "build_runtime", 0.62, both[0])),
    )


def runtime_hits(packages: DataFrame, keys: list[str]) -> DataFrame:
    """One hit for each detected runtime whose name has a letter or digit."""
    named = packages.select(*keys, F.posexplode("runtimes").alias("position", "runtime")).withColumn("s", slug(F.col("runtime"))).where("s <> ''")
    return named.select(*keys, "position", _hit(F.concat(F.lit("knowledge_detected_runtime_"), "s"), "build_runtime", 0.66, "ast_index").alias("hit")).select(*keys, "position", "hit.*")


def shim_hits(packages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Hits of globals that a package's names tell of, in any case, and of scripts without an entry."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = [F.when(_any(low, tokens), _hit(f"knowledge_browser_shim_{name}", "browser_shim", confidence, "ast_index")) for name, (tokens, confidence) in GLOBAL_TOKENS.items()]
    return _hits(packages, keys, *rules, F.when(~_some("entries") & _some("scripts"), _hit("knowledge_browser_shim_generated_host", "browser_shim", 0.73, "input_inventory")))


def _named(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), slug(F.concat_ws("_", *parts)))


def _given(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def prior_hits(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of a job's own evidence: builds, runtime checks and traces, comparisons, reviews and repairs.

    ``documents`` has kind, status, failure_class, review_type, phase, target, target_stage, risk_level and runners (array). Repairs and runners always give a hit, the rest
    only if their status needs attention.
    """
    kind, bad, failure = F.col("kind"), F.col("status").isin(FEEDBACK), _given("failure_class", "none")
    feedback = lambda part, confidence, kind, *names: _hit(_named(f"knowledge_{part}_", *names), "validation_feedback", confidence, kind)
    review = F.coalesce(F.nullif(F.col("review_type"), F.lit("")), F.nullif(F.col("phase"), F.lit("")), F.lit("build"))
    return _hits(
        documents,
        keys,
        *[F.when((kind == k) & bad, feedback("validation_build", 0.78, k, review, failure)) for k in ("build_artifact", "build_log")],
        F.when((kind == "runtime_validation") & bad, feedback("validation_runtime", 0.8, "runtime_validation", _given("target", "runtime"), failure)),
        F.when((kind == "runtime_trace") & _some("runners"), _hit(_named("knowledge_browser_shim_runtime_boundary_", F.array_join("runners", "_")), "browser_shim", 0.77, "runtime_trace")),
        F.when((kind == "runtime_trace") & bad, feedback("validation_runtime_trace", 0.79, "runtime_trace", _given("target", "runtime_trace"), failure)),
        F.when((kind == "runtime_comparison") & bad, feedback("validation_runtime_comparison", 0.82, "runtime_comparison", F.col("status"))),
        F.when((kind == "review_run") & bad, feedback("review_feedback", 0.76, "review_run", _given("review_type", "review"), failure)),
        F.when(
            kind == "repair_instruction",
            _hit(_named("knowledge_repair_case_", _given("target_stage", "repair"), _given("risk_level", "unknown")), "repair_case", F.when(F.col("risk_level") == "low", 0.84).otherwise(0.72), "repair_instruction"),
        ),
    )


def historical_hits(documents: DataFrame, keys: list[str], artifact: str) -> DataFrame:
    """Hits of earlier jobs' repairs, reviews and comparisons, with less confidence; each document has its own."""
    kind, bad, own = F.col("kind"), F.col("status").isin(FEEDBACK), _given(artifact, "historical")
    risk = _given("risk_level", "unknown")
    return _hits(
        documents,
        keys,
        F.when(kind == "repair_instruction", _hit(_named("knowledge_historical_repair_case_", _given("target_stage", "repair"), risk, own), "historical_repair_case", F.when(risk == "low", 0.66).otherwise(0.58), "repair_instruction")),
        F.when((kind == "review_run") & bad, _hit(_named("knowledge_historical_review_feedback_", _given("review_type", "review"), _given("failure_class", "none"), own), "historical_validation_feedback", 0.62, "review_run")),
        F.when((kind == "runtime_comparison") & bad, _hit(_named("knowledge_historical_runtime_comparison_", F.col("status"), _given("failure_class", "unknown"), own), "historical_validation_feedback", 0.64, "runtime_comparison")),
    )


def feedback_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the hits of validation, of repairs that can be applied (low risk, with actions), of other repairs and of history, and the verdict.

    ``hits`` has category, risk and n_actions.
    """
    category = F.col("category")
    repair, validation = category == "repair_case", category == "validation_feedback"
    usable = repair & F.coalesce((F.col("risk") == "low") & (F.col("n_actions") > 0), F.lit(False))
    rows = hits.groupBy(*keys).agg(
        F.count_if(validation).alias("validation"),
        F.count_if(usable).alias("low_risk_repairs"),
        F.count_if(repair & ~usable).alias("audit_only_repairs"),
        F.count_if(category.isin("historical_repair_case", "historical_validation_feedback")).alias("historical"),
    )
    return rows.withColumn("status", F.when((F.col("validation") > 0) | (F.col("audit_only_repairs") > 0), "best_effort").otherwise("pass"))
