"""A corpus of fetched files: the company a document is about, where it came from, what to read next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

# Organisations whose papers are not filed.
ELSEWHERE = ("sccl", "nlcil")


def file_name(url: Column) -> Column:
    """The decoded last part of a link's path, with spaces for underscores and hyphens."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.translate(decoded, "_-", "  ")


def company(url: Column, title: Column, default: Column) -> Column:
    """The organisation that a file's name names, else its name and title together, by the longest spelling found; else ``default``."""
    spelt = [(form.lower(), e.entity_id) for e in names.ENTITIES if e.entity_id not in ELSEWHERE for form in (e.name, *e.aliases)]
    tests = [(len(form), re.escape(form), i) for form, i in spelt] + [(len(e.code), rf"\b{e.code.lower()}\b", e.entity_id) for e in names.ENTITIES if e.entity_id not in ELSEWHERE]
    ordered = sorted(tests, key=lambda t: -t[0])
    found = lambda text: F.coalesce(*[F.when(text.rlike(pattern), i) for _, pattern, i in ordered])
    name = F.lower(file_name(url))
    return F.coalesce(found(name), found(F.concat_ws(" ", name, F.lower(title))), default)


def organisation(company_id: Column, default: Column) -> Column:
    """The name to record for a company's papers."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for e in names.ENTITIES for x in (e.entity_id, e.name)]), company_id), default)


def with_origin(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (company, filename) with the url that the manifest has for them."""
    return files.join(manifest.groupBy("company", "filename").agg(F.min("url").alias("source_url")), ["company", "filename"], "left")


def to_ingest(files: DataFrame, manifest: DataFrame, known: DataFrame, limit: int | None = 250) -> DataFrame:
    """The smallest files first: company, filename, length, source_url, action. ``known``: filename, state, content_hash. A known file
    is left alone if it is ready, else run again; a file whose content is known under another name, or stands twice, is a duplicate."""
    states = known.groupBy("filename").agg(F.max_by("state", F.col("state") == "ready").alias("_state"))
    stored = known.select(F.lower("content_hash").alias("_h")).distinct().withColumn("_stored", F.lit(True))
    rows = with_origin(files, manifest).orderBy("length", "company", "filename")
    rows = (rows if limit is None else rows.limit(limit)).withColumn("_h", F.lower("content_hash"))
    first = rows.groupBy("_h").agg(F.min(F.struct("length", "company", "filename")).alias("_first"))
    rows = rows.join(states, "filename", "left").join(stored, "_h", "left").join(first, "_h")
    again = (F.col("_first.company") != F.col("company")) | (F.col("_first.filename") != F.col("filename"))
    action = F.when(F.col("_state") == "ready", "already_ready").when(F.col("_state").isNotNull(), "run_again").when(F.col("_stored") | again, "duplicate").otherwise("register")
    return rows.select("company", "filename", "length", "source_url", action.alias("action"))


def run_summary(outcomes: DataFrame, skips: DataFrame, best: int = 10, most: int = 12) -> DataFrame:
    """section, name, n: totals, documents by class and by state, the most frequent reasons of skips, the most productive documents."""
    totals = outcomes.agg(F.count("*").alias("documents"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if(F.col("facts") > 0).alias("with_facts"))
    out = totals.select(F.lit("total").alias("section"), F.expr("stack(4, 'documents', documents, 'facts', facts, 'pages', pages, 'with_facts', with_facts) as (name, n)"))
    for section, column in (("class", "doc_class"), ("state", "state")):
        out = out.unionByName(outcomes.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n"))
    reasons = skips.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    top = outcomes.select(F.col("document_id").alias("name"), F.col("facts").cast("long").alias("n")).orderBy(F.desc("n"), "name").limit(best)
    return out.unionByName(reasons.select(F.lit("skip").alias("section"), "name", "n")).unionByName(top.select(F.lit("best").alias("section"), "name", "n"))
