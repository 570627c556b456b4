"""Queues of runs and jobs as snapshots: metrics, order, leases and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import duration_millis
from tracewright.operators.dedupe import keep_one

# Terminal states of runs and of jobs, and failures that are never retried.
TERMINAL_RUNS = ["pass", "fail", "best_effort"]
TERMINAL_JOBS = ["completed", "completed_best_effort", "failed", "cancelled"]
PERMANENT = ["invalid_input", "policy_denied", "sandbox_denied"]


def metrics(runs: DataFrame, now: Column) -> DataFrame:
    """One row of counts, ages, latency, mean duration, retry rate, recoveries and expired leases; ages are in milliseconds.

    An empty next_run_at counts as missing; durations need both times; the mean is cut to whole milliseconds.
    """
    queued, running = F.col("status") == "queued", F.col("status") == "running"
    due = F.coalesce(F.col("next_run_at"), F.col("created_at"))
    took = F.when(F.col("status").isin(TERMINAL_RUNS), duration_millis(F.col("started_at"), F.col("finished_at")))
    attempts = F.count_if(F.col("attempt") > 0)
    return runs.agg(
        F.count_if(queued).alias("queued"),
        F.count_if(running).alias("running"),
        F.count_if(F.col("status").isin(TERMINAL_RUNS)).alias("terminal"),
        F.max(F.when(queued, duration_millis(F.col("created_at"), now))).alias("oldest_queued_ms"),
        F.max(F.when(queued, duration_millis(due, now))).alias("claim_latency_ms"),
        F.floor(F.avg(took)).cast("long").alias("mean_run_ms"),
        F.coalesce(F.try_divide(F.count_if(F.col("attempt") > 1).cast("double"), attempts), F.lit(0.0)).alias("retry_rate"),
        F.count_if(F.col("lease_recovered")).alias("recovered"),
        F.count_if(running & (F.col("lease_expires_at") <= now)).alias("expired_running"),
    )


def due(runs: DataFrame, now: Column, exclude: DataFrame | None = None) -> DataFrame:
    """Queued runs that may start now, in order: next_run_at with nulls first, then created_at, then id."""
    found = runs.where((F.col("status") == "queued") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))
    if exclude is not None:
        found = found.join(exclude.select("id"), "id", "left_anti")
    return found.orderBy(F.col("next_run_at").asc_nulls_first(), F.col("created_at").asc_nulls_first(), F.col("id").asc())


def claim(runs: DataFrame, now: Column, owner: str, lease_seconds: int, slots: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """The next ``slots`` due runs as they stand after a claim: running, one attempt more, leased to ``owner``."""
    until = now + F.expr(f"INTERVAL {lease_seconds} SECONDS")
    return due(runs, now, exclude).limit(slots).withColumns({"status": F.lit("running"), "attempt": F.col("attempt") + 1, "lease_owner": F.lit(owner), "lease_expires_at": until, "started_at": now})


def recover_expired(runs: DataFrame, now: Column) -> DataFrame:
    """All runs; those whose lease ran out are queued again at once, or end in best effort after their last attempt."""
    expired = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") <= now), F.lit(False))
    over = expired & (F.col("attempt") >= F.col("max_attempts"))
    again = expired & ~over
    return runs.withColumns(
        {
            "status": F.when(over, "best_effort").when(again, "queued").otherwise(F.col("status")),
            "error": F.when(over, "timeout").otherwise(F.col("error")),
            "next_run_at": F.when(again, now).otherwise(F.col("next_run_at")),
            "finished_at": F.when(over, now).otherwise(F.col("finished_at")),
            "lease_owner": F.when(~expired, F.col("lease_owner")),
            "lease_expires_at": F.when(~expired, F.col("lease_expires_at")),
            "lease_recovered": F.col("lease_recovered") | again,
        }
    )


def finish(outcomes: DataFrame, now: Column, backoff_seconds: int) -> DataFrame:
    """Outcomes of runs (status, failure_class, attempt, max_attempts): failures that may pass later are queued again after a backoff."""
    failed = F.col("status") == "fail"
    again = failed & (F.col("attempt") < F.col("max_attempts")) & ~F.coalesce(F.col("failure_class").isin(PERMANENT), F.lit(False))
    later = now + F.expr(f"INTERVAL {backoff_seconds} SECONDS")
    return outcomes.withColumns({"next_run_at": F.when(again, later), "status": F.when(again, "queued").when(failed, "best_effort").otherwise(F.col("status"))})


def leasable(jobs: DataFrame, max_attempts: int) -> DataFrame:
    """Jobs that may be leased, oldest first: queued or in intake, with input and an attempt left.

    A job that runs is in intake too and stays eligible; whether it holds a lease is not asked, as in the service itself.
    """
    found = jobs.where(F.col("status").isin("queued", "intake") & F.col("input_artifact_id").isNotNull() & (F.col("run_attempt") < max_attempts))
    return found.orderBy("created_at", "id")


def requeue_jobs(jobs: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """All jobs; leased ones whose lease has run out are queued, or failed by timeout after their last attempt."""
    expired = F.coalesce((F.col("status") == "leased") & (F.col("worker_lease.expires_at") <= now), F.lit(False))
    over = expired & (F.col("run_attempt") >= max_attempts)
    return jobs.withColumns({"status": F.when(over, "failed").when(expired, "queued").otherwise(F.col("status")), "failure_class": F.when(over, "timeout").otherwise(F.col("failure_class")), "worker_lease": F.when(~expired, F.col("worker_lease"))})


def replay(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job_id, seq, status, worker, expected_worker): a terminal state absorbs all later ones, and
    an event of a worker that does not hold the lease is ignored."""
    good = events.where(F.col("expected_worker").isNull() | F.col("expected_worker").eqNullSafe(F.col("worker")))
    done = F.col("status").isin(TERMINAL_JOBS)
    first_end = good.where(done).groupBy("job_id").agg(F.min("seq").alias("end"))
    left = good.join(first_end, "job_id", "left").where(F.col("end").isNull() | (F.col("seq") <= F.col("end"))).drop("end")
    return keep_one(left, ["job_id"], [F.col("seq").desc()])


def throughput(runs: Column, duration_ms: Column) -> Column:
    """Runs a second to three digits, halves to even; without a duration the number of runs."""
    return F.when(duration_ms <= 0, runs.cast("double")).otherwise(F.bround(runs / (duration_ms / 1000), 3))


def queue_alerts(metrics: DataFrame, keys: list[str], workers: int, queue_age_ms: int, claim_latency_ms: int, expired: int, retry_rate: float) -> DataFrame:
    """(keys, position, code, severity, field, value, threshold) of the limits that a queue's metrics exceed, in fixed order; null metrics exceed none.

    ``metrics`` has backend_status, queued_count, oldest_queued_age_ms, claim_latency_ms, expired_running_count and retry_rate.
    """

    def over(code: str, severity: str, field: str, limit, also: Column | None = None) -> Column:
        alert = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.col(field).cast("string").alias("value"), F.lit(str(limit)).alias("threshold"))
        rule = F.col(field) > limit
        return F.when(rule if also is None else rule & also, alert)

    unhealthy = F.struct(F.lit("backend_unhealthy").alias("code"), F.lit("critical").alias("severity"), F.lit("backend_status").alias("field"), F.col("backend_status").alias("value"), F.lit("ok").alias("threshold"))
    found = [
        F.when(~F.col("backend_status").eqNullSafe("ok"), unhealthy),
        over("queue_backlog", "warning", "queued_count", workers, F.coalesce("claim_latency_ms", F.lit(0)) > 0),
        over("queue_age_high", "warning", "oldest_queued_age_ms", queue_age_ms),
        over("claim_latency_high", "warning", "claim_latency_ms", claim_latency_ms),
        over("expired_running_leases", "critical", "expired_running_count", expired),
        over("retry_rate_high", "warning", "retry_rate", retry_rate),
    ]
    return metrics.select(*keys, F.posexplode(F.array_compact(F.array(*found))).alias("position", "alert")).select(*keys, "position", "alert.*")
