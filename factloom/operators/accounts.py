"""Accounts as data: who sees what, login locks, grants. Each is a projection of tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVERYTHING = "*"
#: Failures in a row that lock an account, and minutes that it stays locked.
MOST_FAILURES, LOCKED_MINUTES = 5, 15


def users_with(users: DataFrame, scopes: DataFrame, entity: str | None = None) -> DataFrame:
    """Active users that may see an entity, or each entity: entity_id, user_id, username; a grant of everything counts for all."""
    active = users.where("is_active").select("user_id", "username")
    if entity is not None:
        able = scopes.where(F.col("entity_id").isin(entity, EVERYTHING)).select("user_id").distinct()
        return active.join(able, "user_id", "left_semi").select(F.lit(entity).alias("entity_id"), "user_id", "username")
    named = scopes.where(F.col("entity_id") != EVERYTHING)
    all_ = scopes.where(F.col("entity_id") == EVERYTHING).select("user_id").distinct()
    entities = named.select("entity_id").distinct().withColumn("_one", F.lit(1)).join(all_.withColumn("_one", F.lit(1)), "_one")
    return named.select("entity_id", "user_id").union(entities.select("entity_id", "user_id")).distinct().join(active, "user_id")


def logins(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users after ``events``: user_id, seq, at, kind (success, failure, unlock). A success or unlock clears failures and lock;
    MOST_FAILURES since then lock from the last one on."""
    clears = F.col("kind").isin("success", "unlock").cast("int")
    order = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.sum(clears).over(order)).groupBy("user_id", "run").agg(
        F.count_if(F.col("kind") == "failure").alias("n"), F.max(F.when(F.col("kind") == "failure", F.col("at"))).alias("last")
    )
    now = runs.groupBy("user_id").agg(F.max_by(F.struct("n", "last", "run"), "run").alias("_r"))
    seen = events.where("kind = 'success'").groupBy("user_id").agg(F.max("at").alias("_seen"))
    rows = users.join(now, "user_id", "left").join(seen, "user_id", "left")
    fresh = F.coalesce(F.col("_r.run"), F.lit(0)) > 0
    failed = F.when(fresh, F.lit(0)).otherwise(F.col("failed_login_count")) + F.coalesce(F.col("_r.n"), F.lit(0))
    lock = F.when((failed >= MOST_FAILURES) & F.col("_r.last").isNotNull(), F.col("_r.last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(LOCKED_MINUTES)))
    until = F.coalesce(lock, F.when(~fresh, F.col("locked_until")))
    return rows.withColumns({"failed_login_count": failed.cast("int"), "locked_until": until, "last_login_at": F.coalesce("_seen", "last_login_at")}).drop("_r", "_seen")


def regrant(scopes: DataFrame, changes: DataFrame) -> DataFrame:
    """Grants (user_id, entity_id) after ``changes``: user_id, entity_id, seq, kind (grant, revoke, replace). A replace sets exactly
    the entities of its seq, none for a null one; granting twice changes nothing."""
    last = changes.where("kind = 'replace'").groupBy("user_id").agg(F.max("seq").alias("_from"))
    log = scopes.select("user_id", "entity_id", F.lit(None).cast("long").alias("seq"), F.lit("grant").alias("kind"))
    log = log.unionByName(changes.select("user_id", "entity_id", F.col("seq").cast("long").alias("seq"), "kind")).join(last, "user_id", "left")
    held = log.where(F.col("_from").isNull() | (F.coalesce("seq", F.lit(-1)) >= F.col("_from"))).where("entity_id is not null")
    now = held.groupBy("user_id", "entity_id").agg(F.max_by("kind", F.coalesce("seq", F.lit(-1))).alias("kind"))
    return now.where("kind <> 'revoke'").drop("kind")


def active_admins(users: DataFrame) -> DataFrame:
    return users.where("is_active and role = 'admin'").agg(F.count("*").alias("admins"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count("*").alias("n"))
