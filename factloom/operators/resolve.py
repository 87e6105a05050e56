"""Exact figures, set-based: all requests at once against grouped facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import locator
from ..scope import Scope, scoped
from .facts import MATERIAL_SPREAD, active


def resolve(requests: DataFrame, facts: DataFrame, scope: Scope, open_conflicts: DataFrame | None = None) -> DataFrame:
    """``requests``: entity_id, metric, period_label. Adds reason (null if answered), fact_id, value, unit, document_id.

    The order of refusals: nothing of the kind at all, nothing active or validated, an open conflict (its unit
    is not compared), several units or an ambiguous one, nothing validated, several values.
    """
    keys = ["entity_id", "metric", "period_label"]
    rows = scoped(facts, scope).join(requests.select(*keys).distinct(), keys, "left_semi")
    live, sure = active(), F.col("status") == "validated"
    pick = F.when(sure, F.struct("period_start", "fact_id"))
    of = lambda test, c: F.when(test, c)
    # by unit first, as conflicts are: what a request needs follows from its few units
    units = rows.groupBy(*keys, "unit").agg(
        F.count("*").alias("any"), F.count_if(live).alias("live"), F.bool_or(of(live, F.col("unit_ambiguous"))).alias("ambiguous"), F.min(of(live, F.col("value"))).alias("low"), F.max(of(live, F.col("value"))).alias("high"),
        F.count_if(sure).alias("validated"), F.min(of(sure, F.round("value", 6))).alias("least"), F.max(of(sure, F.round("value", 6))).alias("most"),
        F.min(pick).alias("pick"), F.min_by(F.struct("fact_id", "value", "unit", "document_id"), pick).alias("f"),
    )
    wide = (F.col("high") - F.col("low")) / F.nullif(F.greatest(F.abs("high"), F.abs("low")), F.lit(0.0))
    groups = units.groupBy(*keys).agg(
        F.sum("any").alias("any"), F.sum("live").alias("live"), F.count_if(F.col("live") > 0).alias("units"), F.bool_or("ambiguous").alias("ambiguous"), F.sum("validated").alias("validated"),
        (F.min("least") < F.max("most")).alias("several"), F.coalesce(F.bool_or((F.col("low") < F.col("high")) & (wide >= MATERIAL_SPREAD)), F.lit(False)).alias("disputed"), F.min_by("f", "pick").alias("f"),
    )
    out = requests.join(groups if open_conflicts is None else groups.drop("disputed"), keys, "left")
    if open_conflicts is not None:
        out = out.join(scoped(open_conflicts, scope).select(*keys).distinct().withColumn("disputed", F.lit(True)), keys, "left")
    reason = (
        F.when(F.coalesce("any", F.lit(0)) == 0, "out_of_corpus").when(F.col("live") == 0, "no_validated_fact").when(F.col("disputed"), "open_conflict")
        .when((F.col("units") > 1) | F.col("ambiguous"), "ambiguous_unit").when(F.col("validated") == 0, "no_validated_fact").when(F.col("several"), "open_conflict")
    )
    out = out.withColumn("reason", reason)
    found = lambda c: F.when(F.col("reason").isNull(), F.col(f"f.{c}")).alias(c)
    return out.select(*requests.columns, "reason", found("fact_id"), found("value"), found("unit"), found("document_id"))


def pin(fields: DataFrame, facts: DataFrame, scope: Scope) -> DataFrame:
    """A report's manifest: each template field resolved once, with a position; unresolved ones carry their reason."""
    return resolve(fields, facts, scope).withColumn("state", F.when(F.col("reason").isNull(), "pinned").otherwise("missing"))


def diff(manifest: DataFrame, facts: DataFrame, scope: Scope) -> DataFrame:
    """Pinned figures against today's answers: same or changed (value to six digits, document, or no answer any more)."""
    keys = ["entity_id", "metric", "period_label"]
    pinned = manifest.where("state = 'pinned'").select(*keys, F.col("value").alias("was"), F.col("document_id").alias("was_document"))
    now = resolve(pinned, facts, scope)
    same = F.col("reason").isNull() & (F.round("was", 6) == F.round("value", 6)) & F.col("was_document").eqNullSafe(F.col("document_id"))
    return now.select(*keys, "was", F.col("value").alias("now"), "reason", F.when(same, "same").otherwise("changed").alias("change"))


def sources(manifest: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Distinct source documents of a manifest, with how many figures each has; with ``facts`` (that have page, table and cell),
    also where each figure stands."""
    pinned = manifest.where("state = 'pinned'")
    counted = [F.count("*").alias("figures"), F.min("fact_id").alias("first_fact")]
    if facts is None:
        return pinned.groupBy("document_id").agg(*counted)
    place = locator(F.col("document_id"), F.col("document_version"), F.col("page"), F.col("table_id"), F.col("cell_ref"))
    told = pinned.join(facts.select("fact_id", place.alias("locator")), "fact_id", "left")
    return told.groupBy("document_id").agg(*counted, F.array_join(F.sort_array(F.collect_set("locator")), "; ").alias("locators"))


def dangling(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """Pinned facts that are gone."""
    return manifest.where("fact_id is not null").select("fact_id").distinct().join(facts.select("fact_id"), "fact_id", "left_anti")


def complete(manifest: DataFrame, required: str = "required") -> bool:
    return not manifest.where(F.col(required) & F.col("reason").isNotNull()).limit(1).count()
