"""The work queue as tables: claims, leases, retries and health, all relative to an explicit instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["pending", "claimed", "succeeded", "failed", "dead"]
#: The stages of a document and what each may become.
STAGES = ["received", "classified", "digitized", "extracted", "normalized", "validated", "indexed", "ready"]
TRANSITIONS = {a: {b, "failed", "quarantined"} for a, b in zip(STAGES, STAGES[1:], strict=False)} | {"ready": {"received", "extracted"}, "failed": set(STAGES), "quarantined": {"received"}}


def legal(before: str, after: str) -> bool:
    return before == after or after in TRANSITIONS.get(before, set())


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose key is not known yet, finished ones included; one of each key, that of the least id."""
    first = new.groupBy("idempotency_key").agg(F.min_by(F.struct(*[c for c in new.columns if c != "idempotency_key"]), "job_id").alias("_j"))
    return first.select("_j.*", "idempotency_key").select(*new.columns).join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")


def claimable(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """What a worker would take: due pending jobs by priority, then age; attempts count when claimed."""
    due = jobs.where((F.col("state") == "pending") & (F.col("available_at") <= F.lit(now).cast("timestamp")))
    return due.orderBy(F.desc("priority"), "available_at", "job_id").limit(limit).withColumn("attempts", F.col("attempts") + 1)


def finish(jobs: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """``outcomes``: job_id, worker, ok, permanent. Only the lease holder's word counts; failures retry with back-off or die."""
    rows = jobs.join(outcomes, "job_id", "left")
    held = F.col("ok").isNotNull() & (F.col("state") == "claimed") & (F.col("claimed_by") == F.col("worker"))
    over = F.col("permanent") | (F.col("attempts") >= F.col("max_attempts"))
    state = F.when(held & F.col("ok"), "succeeded").when(held & over, "dead").when(held, "pending").otherwise(F.col("state"))
    again = held & ~F.col("ok") & ~over
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(F.col("attempts")))
    return rows.withColumn("available_at", F.when(again, F.lit(now).cast("timestamp") + wait).otherwise(F.col("available_at"))).withColumn("state", state).drop("worker", "ok", "permanent")


def reclaim(jobs: DataFrame, now: str) -> DataFrame:
    """Claims whose lease ran out: dead if their attempts are used up, else pending again."""
    late = (F.col("state") == "claimed") & (F.col("lease_expires_at") < F.lit(now).cast("timestamp"))
    return jobs.withColumn("state", F.when(late & (F.col("attempts") >= F.col("max_attempts")), "dead").when(late, "pending").otherwise(F.col("state")))


def prune(jobs: DataFrame, now: str, days: int = 30) -> DataFrame:
    old = (F.col("state") == "succeeded") & (F.col("available_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def backoff(attempts: Column, jitter: Column | float = 1.0) -> Column:
    """Seconds: 5, 10, 20 ... up to 600, times the jitter (0.75 to 1.25), 1 at least."""
    base = F.least(F.lit(600.0), 5.0 * F.pow(F.lit(2.0), attempts - 1))
    return F.greatest(F.lit(1.0), base * (F.lit(jitter) if isinstance(jitter, float) else jitter))


def bucket_key(name: str, at: Column, seconds: int) -> Column:
    return F.concat(F.lit(name + "@"), F.floor(F.unix_timestamp(at) / seconds).cast("string"))


def stats(jobs: DataFrame, now: str) -> DataFrame:
    """One row: counts, the oldest waiting job's age (0 at least), the next lease to run out."""
    instant = F.unix_timestamp(F.lit(now).cast("timestamp"))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    oldest = F.min(F.when(F.col("state") == "pending", F.unix_timestamp("available_at")))
    return jobs.agg(*counts, F.greatest(F.lit(0), instant - oldest).alias("oldest_wait"), F.min(F.when(F.col("state") == "claimed", F.col("lease_expires_at"))).alias("next_lease"))


def failed_documents(jobs: DataFrame) -> DataFrame:
    """Documents that a dead job leaves failed, with the stage."""
    return jobs.where("state = 'dead' and document_id is not null").groupBy("document_id").agg(F.min("queue").alias("failed_stage"))
