"""Fact and document states without updates: each write is a projection of rows, or of a decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import new_id
from ..scope import Scope
from . import facts as fact_ops

REVIEW_CONFIDENCE = 0.80


def _with_status(facts: DataFrame, test, status: str) -> DataFrame:
    return facts.withColumn("status", F.when(test, status).otherwise(F.col("status")))


def flag_low(facts: DataFrame, threshold: float = REVIEW_CONFIDENCE, document: str | None = None) -> DataFrame:
    test = (F.col("status") == "extracted") & (fact_ops.least_confidence() < threshold)
    return _with_status(facts, test if document is None else test & (F.col("document_id") == document), "needs_review")


def promote_high(facts: DataFrame, threshold: float = REVIEW_CONFIDENCE, document: str | None = None) -> DataFrame:
    test = (F.col("status") == "extracted") & (fact_ops.least_confidence() >= threshold) & ~F.col("unit_ambiguous")
    return _with_status(facts, test if document is None else test & (F.col("document_id") == document), "validated")


def flag_for_review(facts: DataFrame, flagged: DataFrame) -> DataFrame:
    """``flagged``: fact_id, note. Notes are appended with a bar."""
    one = flagged.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("note")), " | ").alias("_note"))
    rows = facts.join(one, "fact_id", "left")
    hit = F.col("_note").isNotNull() & F.col("status").isin("extracted", "needs_review")
    return rows.withColumn("notes", F.when(hit, F.concat_ws(" | ", "notes", "_note")).otherwise(F.col("notes"))).withColumn("status", F.when(hit, "needs_review").otherwise(F.col("status"))).drop("_note")


def supersede(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """``revisions``: document_id, supersedes. Active facts of replaced documents are superseded."""
    old = revisions.where("supersedes is not null").select(F.col("supersedes").alias("document_id")).distinct().withColumn("_old", F.lit(True))
    return _with_status(facts.join(old, "document_id", "left"), F.col("_old") & fact_ops.active(), "superseded").drop("_old")


def set_status(facts: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return _with_status(facts.join(ids.select("fact_id").distinct().withColumn("_hit", F.lit(True)), "fact_id", "left"), F.coalesce("_hit", F.lit(False)), status).drop("_hit")


def _held(facts: DataFrame, column: str, default: str | None = None):
    """A column that older tables may lack."""
    return F.coalesce(column, F.lit(default)) if column in facts.columns else F.lit(default).cast("string")


def apply_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions``: fact_id, seq, decision (validate, correct, reject), corrected_value, maybe note. The latest one of a
    reviewable fact holds; raw values stay, and so does the review state of facts without a new decision."""
    said = F.struct("decision", "corrected_value", _held(decisions, "note").alias("note"))
    last = decisions.groupBy("fact_id").agg(F.max_by(said, F.struct(F.col("seq"), said)).alias("_d"))
    rows = facts.join(last, "fact_id", "left")
    what = F.col("_d.decision")
    open_ = what.isNotNull() & F.col("status").isin("needs_review", "extracted")
    status = F.when(open_ & what.isin("validate", "correct"), "validated").when(open_ & (what == "reject"), "rejected").otherwise(F.col("status"))
    value = F.when(open_ & (what == "correct"), F.coalesce("_d.corrected_value", "value")).otherwise(F.col("value"))
    names = F.create_map(*map(F.lit, ("validate", "approved", "correct", "corrected", "reject", "rejected")))
    review = F.when(open_, F.element_at(names, what)).otherwise(_held(facts, "review_state", "unreviewed"))
    note = F.when(open_ & F.col("_d.note").isNotNull(), F.concat_ws(" | ", "notes", "_d.note")).otherwise(F.col("notes"))
    return rows.withColumns({"value": value, "review_state": review, "notes": note, "status": status}).drop("_d")


def upsert_conflicts(groups: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """New groups keep the id and detection time of the open conflict with their key; open ones that no longer hold are gone."""
    keys = ["entity_id", "metric", "unit", "period_label"]
    old = open_conflicts.select(*keys, "conflict_id", "detected_at")
    minted = F.concat(F.lit("cfl_"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16))
    return groups.join(old, keys, "left").withColumn("is_new", F.col("conflict_id").isNull()).withColumn("conflict_id", F.coalesce("conflict_id", minted))


def reconcile(facts: DataFrame, groups: DataFrame, scope: Scope) -> DataFrame:
    """Active members become conflicted; conflicted ones in scope that are members no more fall to extracted."""
    members = groups.select(F.explode("fact_ids").alias("fact_id")).distinct().withColumn("_member", F.lit(True))
    rows = facts.join(members, "fact_id", "left")
    member = F.coalesce("_member", F.lit(False))
    status = F.when(member & fact_ops.active(), "conflicted").when(~member & (F.col("status") == "conflicted") & scope.clause("entity_id"), "extracted").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_member")


def stale_conflicts(open_conflicts: DataFrame, groups: DataFrame, scope: Scope) -> DataFrame:
    """Open conflicts in scope that no group has any more: to be dropped."""
    keys = ["entity_id", "metric", "unit", "period_label"]
    return open_conflicts.where(scope.clause("entity_id")).join(groups.select(*keys), keys, "left_anti")


def resolve_conflicts(facts: DataFrame, conflicts: DataFrame, choices: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Facts and conflicts after ``choices``: conflict_id, winner, note, actor, seq. A choice counts if its conflict is open and in
    scope and has the winner as a member; the first that counts stands. The winner is validated, the others are rejected."""
    open_ = conflicts.where(F.col("resolved_fact_id").isNull() & scope.clause("entity_id")).select("conflict_id", "fact_ids")
    counts = choices.join(open_, "conflict_id").where(F.array_contains("fact_ids", F.col("winner")))
    first = counts.groupBy("conflict_id").agg(F.min_by(F.struct("winner", "note", "actor", "fact_ids", "seq"), F.struct("seq", "winner")).alias("_c"))
    told = first.select("_c.seq", "_c.winner", F.explode("_c.fact_ids").alias("fact_id"))
    won = told.groupBy("fact_id").agg(F.max_by(F.col("fact_id") == F.col("winner"), "seq").alias("_won"))
    rows = facts.join(won, "fact_id", "left")
    pick = lambda yes, no, old: F.when(F.col("_won"), yes).when(~F.col("_won"), no).otherwise(old)
    review = pick("approved", "rejected", _held(facts, "review_state", "unreviewed"))
    rows = rows.withColumns({"review_state": review, "status": pick("validated", "rejected", F.col("status"))}).drop("_won")
    stamped = conflicts.join(first, "conflict_id", "left")
    new = {"resolved_fact_id": "winner", "resolution_note": "note", "resolved_by": "actor"}
    return rows, stamped.withColumns({c: F.coalesce(F.col(f"_c.{n}"), _held(conflicts, c)) for c, n in new.items()}).drop("_c")


def delete_documents(facts: DataFrame, conflicts: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and conflicts without the ``versions`` (document_id, document_version) that are extracted anew: conflicts that one of
    their facts is a member of, or has won, go as a whole."""
    keys = ["document_id", "document_version"]
    gone = versions.select(*keys).distinct()
    doomed = facts.join(gone, keys, "left_semi").select("fact_id")
    named = F.array_compact(F.array_append("fact_ids", F.col("resolved_fact_id")))
    torn = conflicts.select("conflict_id", F.explode(named).alias("fact_id")).join(doomed, "fact_id", "left_semi").select("conflict_id").distinct()
    return facts.join(gone, keys, "left_anti"), conflicts.join(torn, "conflict_id", "left_anti")


def check_tighter(requested: float, configured: float = fact_ops.MATERIAL_SPREAD) -> float:
    """A looser spread than the configured one would empty the radar: refused."""
    if requested > configured:
        raise ValueError(f"spread {requested} is looser than {configured}")
    return requested


def replace_stage(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the stages that ``rows`` brings anew are replaced, others stay. On files: dynamic partition overwrite by ``keys``."""
    return existing.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def write_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def register(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose hash (any case) the registry lacks; one of each hash, the smallest id."""
    fresh = documents.withColumn("_h", F.lower("content_hash")).join(registry.select(F.lower("content_hash").alias("_h")).distinct(), "_h", "left_anti")
    return fresh.groupBy("_h").agg(F.min_by(F.struct(*documents.columns), "document_id").alias("_d")).select("_d.*").withColumn("owner_entity_id", F.col("publisher_entity_id"))


def set_state(documents: DataFrame, events: DataFrame) -> DataFrame:
    """``events``: document_id, seq, state, stage, reason, progress (map). The last state holds, failures are cleared unless it failed, progress maps merge in order."""
    last = events.groupBy("document_id").agg(
        F.max_by(F.struct("state", "stage", "reason"), "seq").alias("_e"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "progress")), lambda a, b: F.sign(a.seq - b.seq).cast("int")), lambda x: x.progress).alias("_p")
    )
    merged = F.aggregate("_p", F.coalesce("stage_progress", F.create_map().cast("map<string,string>")), lambda a, b: F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e.key)), F.map_entries(b))))
    failed = F.col("_e.state") == "failed"
    rows = documents.join(last, "document_id", "left")
    return rows.withColumn("state", F.coalesce("_e.state", "state")).withColumn("failed_stage", F.when(failed, F.col("_e.stage"))).withColumn("failed_reason", F.when(failed, F.col("_e.reason"))).withColumn("stage_progress", F.when(F.col("_p").isNotNull(), merged).otherwise(F.col("stage_progress"))).drop("_e", "_p")


def set_progress(documents: DataFrame, counters: DataFrame) -> DataFrame:
    """``counters``: document_id, stage, done, total, at. The latest of each stage enters the document's map; other stages stay."""
    kind = "map<string,struct<done:bigint,total:bigint,at:timestamp>>"
    last = counters.groupBy("document_id", "stage").agg(F.max_by(F.struct(F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), "at"), F.struct("at", "done")).alias("c"))
    new = last.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "c"))).alias("_new"))
    rows = documents.join(new, "document_id", "left")
    old = F.coalesce("progress", F.create_map().cast(kind)) if "progress" in documents.columns else F.create_map().cast(kind)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.coalesce("_new", F.create_map().cast(kind)), k)), F.coalesce("_new", F.create_map().cast(kind)))
    return rows.withColumn("progress", merged).drop("_new")


def set_fields(documents: DataFrame, values: DataFrame) -> DataFrame:
    """``values``: document_id, and any of doc_class, fiscal_year, publisher_entity_id; nulls change nothing. A publisher becomes
    the owner too where there is none."""
    given = [c for c in ("doc_class", "fiscal_year", "publisher_entity_id") if c in values.columns]
    rows = documents.join(values.select("document_id", *[F.col(c).alias(f"_{c}") for c in given]), "document_id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in given}
    if "publisher_entity_id" in given:
        new["owner_entity_id"] = F.coalesce("owner_entity_id", "_publisher_entity_id")
    return rows.withColumns(new).drop(*[f"_{c}" for c in given])


def inferred_years(facts: DataFrame) -> DataFrame:
    """document_id, fiscal_year of the documents whose active facts agree on one."""
    found = facts.where(fact_ops.active() & F.col("fiscal_year").isNotNull()).groupBy("document_id").agg(F.min("fiscal_year").alias("fiscal_year"), F.max("fiscal_year").alias("_last"))
    return found.where("fiscal_year = _last").drop("_last")


def insert(table: DataFrame, rows: DataFrame, key: str | None = None, prefix: str = "ev_") -> DataFrame:
    """``table`` and ``rows``; columns that the table lacks are refused, missing ones are null, missing keys are made from the row."""
    unknown = sorted(set(rows.columns) - set(table.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if key is not None:
        made = new_id(prefix, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns) if c != key])
        rows = rows.withColumn(key, F.coalesce(key, made) if key in rows.columns else made)
    return table.unionByName(rows, allowMissingColumns=True)


def append_audit(path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)
