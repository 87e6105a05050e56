"""Aggregations and scans over facts: one plan each, at most one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scope import Scope, scoped

INACTIVE = ("rejected", "superseded")
#: Days between the ends of a period from which it counts as a full year.
YEAR_DAYS = 350
#: Default share of the larger value from which a difference is a conflict.
MATERIAL_SPREAD = 0.005


def active() -> Column:
    return ~F.col("status").isin(*INACTIVE)


def least_confidence() -> Column:
    """The weakest stage; nulls are ignored, all null gives null."""
    return F.least("conf_ocr", "conf_parse", "conf_answer")


def limiting_stage() -> Column:
    low = least_confidence()
    return F.when(F.col("conf_ocr") == low, "ocr").when(F.col("conf_parse") == low, "parse").when(F.col("conf_answer") == low, "answer")


def series(facts: DataFrame, metric: str, scope: Scope, unit: str | None = None) -> DataFrame:
    """A validated full-year value for each entity, year and unit: a representative pick, never a sum."""
    rows = scoped(facts, scope).where((F.col("metric") == metric) & (F.col("status") == "validated") & F.col("fiscal_year").isNotNull() & (F.datediff("period_end", "period_start") >= YEAR_DAYS))
    if unit is not None:
        rows = rows.where(F.col("unit") == unit)
    return rows.groupBy("entity_id", "fiscal_year", "unit").agg(F.max("value").alias("value"), F.count("*").alias("fact_count"))


def radar(facts: DataFrame, scope: Scope, spread: float = MATERIAL_SPREAD) -> DataFrame:
    """Groups of active facts that disagree by ``spread`` of the larger magnitude or more."""
    low, high = F.col("value_low"), F.col("value_high")
    groups = scoped(facts, scope).where(active()).groupBy("entity_id", "metric", "unit", "period_label").agg(
        F.min("value").alias("value_low"), F.max("value").alias("value_high"), F.array_sort(F.collect_list(F.struct("value", "fact_id"))).alias("_m")
    )
    relative = (high - low) / F.nullif(F.greatest(F.abs(high), F.abs(low)), F.lit(0.0))
    return groups.where((low < high) & (relative >= spread)).select("entity_id", "metric", "unit", "period_label", "value_low", "value_high", relative.alias("spread"), F.transform("_m", lambda x: x.fact_id).alias("fact_ids"))


def tallies(facts: DataFrame, scope: Scope) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return scoped(facts, scope).where(active()).agg(
        F.count("*").alias("total"), count("validated").alias("validated"), count("needs_review").alias("needs_review"), count("conflicted").alias("conflicted"),
        F.countDistinct("entity_id").alias("entities"), F.countDistinct("metric").alias("metrics"),
    )


def answerable(facts: DataFrame, scope: Scope, limit: int = 12) -> DataFrame:
    rows = scoped(facts, scope).where(F.col("status") == "validated").groupBy("entity_id", "metric", "period_label", "fiscal_year").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "entity_id", "metric", "period_label").limit(limit)


def comparable_metrics(facts: DataFrame, scope: Scope, minimum: int = 2) -> DataFrame:
    rows = scoped(facts, scope).where(active() & F.col("fiscal_year").isNotNull()).groupBy("metric").agg(F.countDistinct("entity_id").alias("entities"))
    return rows.where(F.col("entities") >= minimum)


def facets(facts: DataFrame) -> DataFrame:
    """Distinct entities, metrics and years of each document's active facts."""
    lists = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(n) for c, n in (("entity_id", "entities"), ("metric", "metrics"), ("fiscal_year", "fiscal_years"))]
    return facts.where(active()).groupBy("document_id").agg(*lists)


def bounded(limit: int, least: int = 1, most: int = 2000) -> int:
    """A limit that a caller may ask for."""
    if not least <= limit <= most:
        raise ValueError(f"limit {limit} is not between {least} and {most}")
    return limit


def point(rows: DataFrame, key: str, value: str, scope: Scope | None = None, owner: str = "entity_id") -> DataFrame:
    """The row of a key, if the scope may see it."""
    found = rows.where(F.col(key) == value)
    return found if scope is None else scoped(found, scope, owner)


def query(facts: DataFrame, scope: Scope, entity: str | None = None, metric: str | None = None, fiscal_year: str | None = None, document: str | None = None, status: str | None = None, include_inactive: bool = False, limit: int | None = 200) -> DataFrame:
    rows = scoped(facts, scope)
    for column, value in (("entity_id", entity), ("metric", metric), ("fiscal_year", fiscal_year), ("document_id", document), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if not (include_inactive or status in INACTIVE):
        rows = rows.where(active())
    rows = rows.orderBy("entity_id", "metric", "period_start", "fact_id")
    return rows if limit is None else rows.limit(limit)


def by_ids(facts: DataFrame, ids: list[str], scope: Scope) -> DataFrame:
    return scoped(facts, scope).where(F.col("fact_id").isin(ids))


def document_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


def zero_filled(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """A count for each of the known states, absent ones as 0."""
    known = rows.sparkSession.createDataFrame([(s,) for s in states], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def review_queue(facts: DataFrame, scope: Scope, limit: int = 200) -> DataFrame:
    return query(facts, scope, status="needs_review", limit=limit)


def conflict_members(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each member of each conflict with its value, lowest first: one join instead of a read for each conflict."""
    keys = ["entity_id", "metric", "unit", "period_label"]
    members = groups.select(*keys, "spread", F.posexplode("fact_ids").alias("position", "fact_id"))
    return members.join(facts.select("fact_id", "value", "document_id", "status"), "fact_id")


def open_conflicts(conflicts: DataFrame, facts: DataFrame, scope: Scope) -> DataFrame:
    """Conflicts in scope that nobody has resolved, with the width they are ranked by (of the high end's size; null for 0) and
    their members by value. The first ones are ``orderBy(desc("width"), desc("detected_at"))`` under a limit."""
    mine = scoped(conflicts, scope).where("resolved_fact_id is null")
    width = (F.col("value_high") - F.col("value_low")) / F.nullif(F.abs("value_high"), F.lit(0.0))
    members = mine.select("conflict_id", F.explode("fact_ids").alias("fact_id")).join(scoped(facts, scope).select("fact_id", "value", "status", "document_id"), "fact_id")
    listed = members.groupBy("conflict_id").agg(F.array_sort(F.collect_list(F.struct("value", "fact_id", "status", "document_id"))).alias("members"))
    return mine.withColumn("width", width).join(listed, "conflict_id", "left")


def years(points: DataFrame, year: str | None = None) -> DataFrame:
    """What a chart of a series shows: the points of one year, the latest by default, each with its rank by value."""
    latest = points.agg(F.max("fiscal_year").alias("_latest"))  # one row
    shown = points.join(F.broadcast(latest), F.col("fiscal_year") == (F.col("_latest") if year is None else F.lit(year))).drop("_latest")
    return shown.withColumn("position", F.row_number().over(Window.partitionBy("fiscal_year").orderBy("value", "entity_id", "unit")))


def dumbbell(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Where a member stands between the conflict's ends, from 6 to 94."""
    keys = ["entity_id", "metric", "unit", "period_label"]
    rows = conflict_members(groups, facts).join(groups.select(*keys, "value_low", "value_high"), keys)
    width = F.when(F.col("value_high") == F.col("value_low"), 1.0).otherwise(F.col("value_high") - F.col("value_low"))
    return rows.select("fact_id", F.round(6 + (F.col("value") - F.col("value_low")) / width * 88, 6).alias("position"))
