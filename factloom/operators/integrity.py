"""Set differences between what is recorded and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    return documents.select(F.lower("content_hash").alias("content_hash")).distinct().join(blobs.select(F.lower("content_hash").alias("content_hash")), "content_hash", "left_anti")


def orphan_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    return missing_blobs(blobs, documents)


def altered_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs (content_hash, content) whose bytes no longer give their name."""
    return blobs.where(F.sha2("content", 256) != F.lower("content_hash")).select("content_hash")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``manifest`` and ``files``: path, sha256. ok, missing or changed for each entry."""
    there = files.select("path", F.lower("sha256").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.lower("sha256"), "ok").otherwise("changed")
    return manifest.join(there, "path", "left").select("path", state.alias("state"))


def corpus_summary(entries: DataFrame) -> DataFrame:
    """``entries``: company, path, bytes. Documents, bytes and a count for each file suffix, by company."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    each = entries.groupBy("company", suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return each.groupBy("company").agg(F.sum("n").alias("documents"), F.sum("b").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("suffix", "n")))).alias("suffixes"))


def pipeline_health(documents: DataFrame, queue: DataFrame, states: list[str]) -> DataFrame:
    """One row: documents by state, the queue's reading (one row, see ``jobs.stats``), and what needs someone's attention."""
    counts = [F.count_if(F.col("state") == s).alias(f"documents_{s}") for s in states]
    both = documents.agg(*counts).crossJoin(queue)  # rows of one
    needs = sum((F.col(f"documents_{s}") for s in ("failed", "quarantined") if s in states), F.lit(0)) + F.col("dead") + F.col("failed")
    return both.withColumn("needs_attention", needs)


def skip_report(skips: DataFrame, actionable: list[str], samples: int = 5) -> DataFrame:
    """``skips``: reason, sample. Counts, a few samples of 120 characters, and whether someone can act on it."""
    # the least sample of each of a few hash classes: a bounded list, whatever a reason's count
    part = skips.withColumn("sample", F.substring("sample", 1, 120)).groupBy("reason", F.pmod(F.xxhash64("sample"), F.lit(samples)).alias("_c")).agg(F.count("*").alias("n"), F.min("sample").alias("s"))
    out = part.groupBy("reason").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("s")).alias("samples"))
    return out.withColumn("actionable", F.col("reason").isin(*actionable))
