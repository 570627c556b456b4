"""Settings revisions with compare-and-set, and failures that are cached for a time: folds over rows in order, in batch.

The streaming forms are in ``tracewright.streaming.folds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.chains import nearest, reached

SCOPE = ["scope", "scope_id"]


def settle_writes(writes: DataFrame, current: DataFrame | None = None, block: int = 1 << 16) -> DataFrame:
    """All writes with current_revision (before the write), accepted, and revision (that of an accepted write, else null).

    ``writes`` has scope, scope_id (null counts as empty), seq (its order, unique in a scope), expected_revision; ``current`` (scope, scope_id, revision) is what is
    stored already, 0 where nothing is. A write is accepted if it expects the revision that the accepted ones before it left, and makes the next one. A null expectation is
    never accepted. An empty table gives no rows; further columns stay. ``block`` numbers of seq are one group of a scope at most.
    """
    rows = writes.withColumn("scope_id", F.coalesce("scope_id", F.lit("")))
    if current is None:
        begun = rows.select(*SCOPE).distinct().withColumn("stored", F.lit(0).cast("long"))
    else:
        stored = current.select("scope", F.coalesce("scope_id", F.lit("")).alias("scope_id"), F.col("revision").cast("long").alias("stored"))
        begun = rows.select(*SCOPE).distinct().join(stored, SCOPE, "left").fillna(0, ["stored"])
    part = F.floor(F.col("at") / block)
    points = rows.where("expected_revision is not null").select(*SCOPE, F.col("expected_revision").cast("long").alias("level"), F.col("seq").alias("at"), F.struct("seq").alias("hit"))
    asking = points.select(*SCOPE, (F.col("level") + 1).alias("level"), (F.col("at") + 1).alias("at"), F.col("at").alias("seq"))
    name = lambda seq: F.struct(*SCOPE, seq.alias("seq"))
    followed = nearest(asking, points, [*SCOPE, "level"], "at", part, "hit")
    links = followed.where("hit is not null").select(name(F.col("seq")).alias("id"), name(F.col("hit.seq")).alias("next"))
    first = points.join(begun, SCOPE).where("level = stored").groupBy(*SCOPE).agg(F.min("at").alias("seq"))
    counted = reached(links, first.select(name(F.col("seq")).alias("id"))).select("id.*").join(rows, [*SCOPE, "seq"])
    made = counted.select(*SCOPE, F.col("seq").alias("at"), F.struct((F.col("expected_revision") + 1).cast("long").alias("revision")).alias("left"))
    seen = nearest(rows.withColumn("at", F.col("seq") - 1), made, SCOPE, "at", part, "left", before=True).drop("at")
    now = F.coalesce("left.revision", "stored")
    taken = F.coalesce(F.col("expected_revision") == now, F.lit(False))
    seen = seen.join(begun, SCOPE).withColumns({"current_revision": now, "accepted": taken})
    return seen.withColumn("revision", F.when(F.col("accepted"), F.col("current_revision") + 1)).drop("left", "stored")


def revision_of(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``revisions`` that ``wanted`` (scope, scope_id, revision) names; a null scope_id counts as empty."""
    plain = lambda df: df.withColumn("scope_id", F.coalesce("scope_id", F.lit("")))
    return plain(revisions).join(plain(wanted).select(*SCOPE, "revision").distinct(), [*SCOPE, "revision"], "left_semi")


def failure_key(provider: Column, model: Column, base_url: Column, agent: Column) -> Column:
    """What failures are cached by: the model's service without differences of case, blanks and final slashes, and the agent."""
    plain = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f\v"))
    return F.struct(F.lower(plain(provider)).alias("provider"), plain(model).alias("model"), F.lower(F.rtrim(plain(base_url), F.lit("/"))).alias("base_url"), F.coalesce(agent, F.lit("")).alias("agent"))


def cached_failures(calls: DataFrame, ttl_seconds: float, block_seconds: int = 3600) -> DataFrame:
    """All calls with outcome and message: ``cached`` with an earlier failure's message, ``failed`` with its own, or ``passed`` with null.

    ``calls`` has key (not null), at (timestamp), seq (order among equal times, unique), failed, cacheable, message. A call within ``ttl_seconds`` after a failure that was cached is not made, and so
    prolongs nothing; a call at the very end is made. Failures that are not cacheable (those of form) leave nothing. Null flags count as false. An empty table gives no rows; further columns stay.
    """
    ttl = int(ttl_seconds * 1_000_000)
    if ttl <= 0:
        raise ValueError("failures are cached for a positive time")
    place = lambda at, seq: F.struct(at.cast("long").alias("t"), seq.cast("long").alias("seq"))
    block = F.floor(F.col("place.t") / (block_seconds * 1_000_000))
    made = F.coalesce("failed", F.lit(False))
    rows = calls.withColumn("place", place(F.unix_micros(F.col("at").cast("timestamp")), F.col("seq")))
    kept = rows.where(made & F.coalesce("cacheable", F.lit(False)))
    # Of failures at one instant only the first can be cached.
    points = kept.groupBy("key", F.col("place.t").alias("t")).agg(F.min_by(F.struct("place", "message"), F.col("place.seq")).alias("hit")).select("key", F.col("hit.place").alias("place"), "hit")
    asking = points.select("key", place(F.col("place.t") + ttl, F.lit(-(2**63))).alias("place"), F.col("place").alias("own"))
    followed = nearest(asking, points, ["key"], "place", block, "hit")
    links = followed.where("hit is not null").select(F.struct("key", F.col("own").alias("place")).alias("id"), F.struct("key", F.col("hit.place").alias("place")).alias("next"))
    first = points.groupBy("key").agg(F.min("place").alias("place"))
    entries = reached(links, first.select(F.struct("key", "place").alias("id"))).select("id.*").join(points, ["key", "place"])
    seen = nearest(rows, entries, ["key"], "place", block, "hit", before=True)
    cached = F.coalesce((F.col("hit.place.t") + ttl > F.col("place.t")) & (F.col("hit.place") != F.col("place")), F.lit(False))
    outcome = F.when(cached, "cached").when(made, "failed").otherwise("passed")
    message = F.when(cached, F.col("hit.message")).when(made, F.col("message"))
    return seen.withColumns({"outcome": outcome, "message": message}).drop("hit", "place")
