"""Validation rules: each returns fact_id, rule, detail (a ratio or value); within one document except the yearly swing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import active

# Metrics that cannot be negative, and the rules' limits.
NON_NEGATIVE = ("coal_production", "coal_offtake", "washed_coal_production", "overburden_removal", "coal_stock", "rated_capacity", "geological_reserves", "extractable_reserves", "manpower", "land_acquired", "gcv")
MOST_TONNES, CAPACITY, OFFTAKE, SWING = 2e9, 1.30, 1.20, 0.5


def negative(facts: DataFrame, metrics: tuple[str, ...] = NON_NEGATIVE) -> DataFrame:
    return facts.where(active() & F.col("metric").isin(*metrics) & (F.col("value") < 0)).select("fact_id", F.lit("negative_value").alias("rule"), F.col("value").alias("detail"))


def implausible(facts: DataFrame, metrics: tuple[str, ...] = ("coal_production", "coal_offtake"), limit: float = MOST_TONNES) -> DataFrame:
    rows = facts.where(active() & F.col("metric").isin(*metrics) & (F.col("unit") == "t") & (F.col("value") > limit))
    return rows.select("fact_id", F.lit("implausible_magnitude").alias("rule"), F.col("value").alias("detail"))


def _against_largest(facts: DataFrame, metric: str, of: str, keys: list[str], factor: float, rule: str) -> DataFrame:
    rows = facts.where(active() & (F.col("unit") == "t"))
    # the larger of nothing and the values: a largest one of 0 or less has no say
    most = rows.where(F.col("metric") == of).groupBy(*keys).agg(F.max("value").alias("_most")).where("_most > 0")
    return rows.where(F.col("metric") == metric).join(most, keys).where(F.col("value") > F.col("_most") * factor).select("fact_id", F.lit(rule).alias("rule"), (F.col("value") / F.col("_most")).alias("detail"))


def above_capacity(facts: DataFrame, production: str = "coal_production", capacity: str = "rated_capacity") -> DataFrame:
    return _against_largest(facts, production, capacity, ["document_id", "entity_id"], CAPACITY, "production_above_capacity")


def offtake_exceeds(facts: DataFrame, offtake: str = "coal_offtake", production: str = "coal_production") -> DataFrame:
    return _against_largest(facts, offtake, production, ["document_id", "entity_id", "period_label"], OFFTAKE, "offtake_exceeds_production")


def fiscal_start(column: str = "fiscal_year"):
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(column, r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(-1))


def yearly_swing(facts: DataFrame, history: DataFrame, metrics: tuple[str, ...] = ("coal_production", "coal_offtake"), limit: float = SWING) -> DataFrame:
    """Change against the validated value of the nearest other year; ties go to the first by (entity, metric, start, id)."""
    rows = facts.where(active() & F.col("metric").isin(*metrics) & F.col("fiscal_year").isNotNull()).withColumn("_y", fiscal_start())
    past = history.where((F.col("status") == "validated") & F.col("fiscal_year").isNotNull() & F.col("metric").isin(*metrics))
    # one candidate for each year: the nearest year is chosen first, so the join has a row a year and not a row a fact
    first = past.withColumn("_hy", fiscal_start()).groupBy("entity_id", "metric", "unit", F.col("fiscal_year").alias("_hf"), "_hy").agg(F.min_by("value", F.struct("period_start", "fact_id")).alias("_hv"), F.min(F.struct("period_start", "fact_id")).alias("_ho"))
    near = rows.join(first, ["entity_id", "metric", "unit"]).where(F.col("_hf") != F.col("fiscal_year"))
    best = near.groupBy("fact_id", "value").agg(F.min_by("_hv", F.struct(F.abs(F.col("_hy") - F.col("_y")), "_ho")).alias("_previous"))
    change = (F.col("value") - F.col("_previous")) / F.nullif(F.col("_previous"), F.lit(0.0))
    return best.where((F.col("_previous") > 0) & (F.abs(change) > limit)).select("fact_id", F.lit("year_on_year_swing").alias("rule"), change.alias("detail"))


def run(facts: DataFrame, history: DataFrame) -> DataFrame:
    out = negative(facts)
    for rows in (implausible(facts), above_capacity(facts), offtake_exceeds(facts), yearly_swing(facts, history)):
        out = out.unionByName(rows)
    return out


def growth_check(rows: DataFrame) -> DataFrame:
    """this, last, printed: whether a printed growth agrees with its two values within what their rounding allows (null: cannot tell)."""
    last = F.nullif(F.col("last"), F.lit(0.0))
    expected = (F.col("this") - F.col("last")) / last * 100
    tolerance = 100 * (0.05 / F.abs(last) + 0.05 * F.abs(F.col("this")) / (last * last)) + 0.6
    agrees = F.when(tolerance <= 12, F.abs(F.col("printed") - expected) <= tolerance)
    return rows.withColumn("expected", expected).withColumn("tolerance", tolerance).withColumn("agrees", agrees)


def block_agreement(rows: DataFrame, block: list[str]) -> DataFrame:
    """Of each block's printed growths: how many could be checked, how many agree, and their share."""
    checked = growth_check(rows).groupBy(*block).agg(F.count("agrees").alias("checked"), F.count_if("agrees").alias("agreed"))
    return checked.withColumn("share", F.col("agreed") / F.nullif(F.col("checked"), F.lit(0)))


def assertions(facts: DataFrame) -> DataFrame:
    """Rows that break the model's constraints, one for each: an empty result is a clean table."""
    unit = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    checks = F.array_compact(F.array(
        F.when(F.col("period_end") < F.col("period_start"), F.lit("period_order")),
        F.when(unit("conf_ocr") | unit("conf_parse") | unit("conf_answer"), F.lit("confidence_range")),
        F.when(F.col("fact_id").isNull(), F.lit("fact_id_null")),
    ))
    return facts.select("fact_id", F.explode(checks).alias("broken"))
