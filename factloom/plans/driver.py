"""The model's tables as projections of a generic star schema: facts from orders, jobs from events, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import fiscal_label_of, fiscal_start_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each order: its nation as entity, priority as metric; one in twelve covers a whole fiscal year."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    start = fiscal_start_of(day)
    whole = k % 12 == 0
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(
        F.concat(F.lit("fact_"), k).alias("fact_id"), F.col("n_name").alias("entity_id"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), F.lit("t").alias("unit"),
        F.when(whole, F.make_date(start, F.lit(4), F.lit(1))).otherwise(F.trunc(day, "month")).alias("period_start"), F.when(whole, F.make_date(start + 1, F.lit(3), F.lit(31))).otherwise(F.last_day(day)).alias("period_end"),
        F.when(whole, fiscal_label_of(start)).otherwise(F.date_format(day, "yyyy-MM")).alias("period_label"), fiscal_label_of(start).alias("fiscal_year"),
        F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "extracted").otherwise("rejected").alias("status"),
        F.concat(F.lit("doc_"), k % 97).alias("document_id"), ((k % 100) / 100.0).alias("conf_parse"), F.when(k % 3 != 0, ((k * 7) % 100) / 100.0).alias("conf_ocr"), F.lit(None).cast("double").alias("conf_answer"),
        (k % 19 == 0).alias("unit_ambiguous"), F.lit(None).cast("string").alias("notes"),
    )


FACTS = """facts AS (
  SELECT 'fact_' || k AS fact_id, n_name AS entity_id, o_orderpriority AS metric, o_totalprice AS value, 't' AS unit,
    CASE WHEN k % 12 = 0 THEN make_date(fy, 4, 1) ELSE CAST(date_trunc('month', d) AS DATE) END AS period_start,
    CASE WHEN k % 12 = 0 THEN make_date(fy + 1, 3, 31) ELSE last_day(d) END AS period_end,
    CASE WHEN k % 12 = 0 THEN 'FY' || fy || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') ELSE strftime(d, '%Y-%m') END AS period_label,
    'FY' || fy || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
    CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'extracted' ELSE 'rejected' END AS status,
    'doc_' || (k % 97) AS document_id, (k % 100) / 100.0::DOUBLE AS conf_parse, CASE WHEN k % 3 <> 0 THEN ((k * 7) % 100) / 100.0::DOUBLE END AS conf_ocr, CAST(NULL AS DOUBLE) AS conf_answer,
    k % 19 = 0 AS unit_ambiguous
  FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS BIGINT) AS fy FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event: its type as state, its user as worker."""
    e = table(spark, sf_dir, "events")
    states = {"view": "pending", "signup": "claimed", "click": "succeeded", "error": "dead", "purchase": "failed"}
    state = F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.concat(F.lit("job_"), "event_id").alias("job_id"), (F.concat(F.lit("q"), F.col("event_id") % 3)).alias("queue"), state.alias("state"), F.floor("value").cast("int").alias("priority"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.col("ts").alias("available_at"), F.concat(F.lit("w"), "user_id").alias("claimed_by"), (F.col("ts") + F.expr("interval 10 minutes")).alias("lease_expires_at"), F.concat(F.lit("key_"), F.col("event_id") % 5000).alias("idempotency_key"), F.concat(F.lit("doc_"), F.col("event_id") % 97).alias("document_id"),
    )


JOBS = """jobs AS (
  SELECT 'job_' || event_id AS job_id, 'q' || (event_id % 3) AS queue, CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'dead' WHEN 'purchase' THEN 'failed' END AS state,
    CAST(floor(value) AS INTEGER) AS priority, CAST(event_id % 4 AS INTEGER) AS attempts, 3 AS max_attempts, ts AS available_at, 'w' || user_id AS claimed_by, ts + INTERVAL 10 MINUTE AS lease_expires_at,
    'key_' || (event_id % 5000) AS idempotency_key, 'doc_' || (event_id % 97) AS document_id FROM events)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of evidence for each line of a document: doc_id, line_no, page (of ten lines), text."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.select("doc_id", "line_no", (F.floor(F.col("line_no") / 10) + 1).cast("int").alias("page"), "text")


EVIDENCE = """lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents),
evidence AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(line_no // 10 + 1 AS INTEGER) AS page, text FROM lines)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered document for each document, with its label as review state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("content_hash"))
    labels = table(spark, sf_dir, "labels")
    state = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("received")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "content_hash", state.alias("state"), (F.col("n_chars") % 40 + 1).cast("int").alias("page_count"))


REGISTRY = """registry AS (
  SELECT d.doc_id, lang, source, n_chars, sha256(text) AS content_hash, CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'failed' ELSE 'received' END AS state, CAST(n_chars % 40 + 1 AS INTEGER) AS page_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts in every state, with review states, notes and versions."""
    k = F.substring("fact_id", 6, 20).cast("long")
    status = F.when((F.col("status") != "rejected") & (k % 11 == 0), "conflicted").when((F.col("status") == "extracted") & (k % 5 == 2), "needs_review").otherwise(F.col("status"))
    review = F.when(k % 6 == 0, "approved").when(k % 6 == 1, "rejected").otherwise("unreviewed")
    return facts(spark, sf_dir).withColumns({"status": status, "review_state": review, "notes": F.when(k % 4 == 1, "old note"), "document_version": (k % 3 + 1).cast("int")})


STATED = """stated AS (SELECT fact_id, entity_id, metric, value, unit, period_start, period_end, period_label, fiscal_year, document_id, conf_parse, conf_ocr, conf_answer, unit_ambiguous, k,
  CASE WHEN status <> 'rejected' AND k % 11 = 0 THEN 'conflicted' WHEN status = 'extracted' AND k % 5 = 2 THEN 'needs_review' ELSE status END AS status,
  CASE k % 6 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'unreviewed' END AS review_state, CASE WHEN k % 4 = 1 THEN 'old note' END AS notes, CAST(k % 3 + 1 AS INTEGER) AS document_version
  FROM (SELECT *, CAST(fact_id[6:] AS BIGINT) AS k FROM facts))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its place: every seventh span has no box, some documents have no pages, every fourth line is a table's cell."""
    rows = evidence(spark, sf_dir)
    n, d = F.col("line_no"), F.col("doc_id")
    cell = n % 4 == 3
    return rows.select(
        F.concat(F.lit("ev_"), d, F.lit("_"), F.lpad(n.cast("string"), 6, "0")).alias("evidence_id"), F.concat(F.lit("doc_"), d).alias("document_id"), (d % 3 + 1).cast("int").alias("document_version"),
        F.when(d % 13 != 0, F.col("page")).alias("page"), F.when(cell, "table_cell").otherwise("line").alias("kind"), F.when(cell, F.concat(F.lit("t"), n % 2)).alias("table_id"), F.when(cell, n % 5).alias("row_idx"), F.when(cell, n % 3).alias("col_idx"),
        F.when((d + n) % 7 != 0, (n * 37 % 10) * 12.5).alias("bbox_y0"), F.when((d + n) % 5 != 0, (n * 11 % 6) * 20.0).alias("bbox_x0"), "text",
    )


SPANS = """spans AS (SELECT 'ev_' || doc_id || '_' || lpad(CAST(line_no AS VARCHAR), 6, '0') AS evidence_id, 'doc_' || doc_id AS document_id, CAST(doc_id % 3 + 1 AS INTEGER) AS document_version, CASE WHEN doc_id % 13 <> 0 THEN page END AS page,
  CASE WHEN line_no % 4 = 3 THEN 'table_cell' ELSE 'line' END AS kind, CASE WHEN line_no % 4 = 3 THEN 't' || (line_no % 2) END AS table_id, CASE WHEN line_no % 4 = 3 THEN line_no % 5 END AS row_idx, CASE WHEN line_no % 4 = 3 THEN line_no % 3 END AS col_idx,
  CASE WHEN (doc_id + line_no) % 7 <> 0 THEN (line_no * 37 % 10) * 12.5::DOUBLE END AS bbox_y0, CASE WHEN (doc_id + line_no) % 5 <> 0 THEN (line_no * 11 % 6) * 20.0::DOUBLE END AS bbox_x0, text FROM evidence)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as documents with owner and fiscal year; one in ten has no year."""
    k = F.col("doc_id")
    start = 2012 + k % 9
    return registry(spark, sf_dir).select("doc_id", F.concat(F.lit("doc_"), k).alias("document_id"), F.col("source").alias("owner_entity_id"), "lang", "source", "content_hash", "state", "page_count", F.when(k % 10 != 0, fiscal_label_of(start)).alias("fiscal_year"))


PAPERS = """papers AS (SELECT doc_id, 'doc_' || doc_id AS document_id, source AS owner_entity_id, lang, source, content_hash, state, page_count,
  CASE WHEN doc_id % 10 <> 0 THEN 'FY' || (2012 + doc_id % 9) || '-' || lpad(CAST((2013 + doc_id % 9) % 100 AS VARCHAR), 2, '0') END AS fiscal_year FROM registry)"""


def conflicts(groups: DataFrame) -> DataFrame:
    """Stored conflicts of a radar's groups: those of one priority were resolved before."""
    keys = ["entity_id", "metric", "unit", "period_label"]
    name = F.concat(F.lit("cfl_"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16))
    done = F.col("metric") == "5-LOW"
    return groups.select(name.alias("conflict_id"), *keys, "value_low", "value_high", "fact_ids", F.when(done, F.get("fact_ids", F.lit(0))).alias("resolved_fact_id"), F.when(done, "before").alias("resolution_note"), F.lit(None).cast("string").alias("resolved_by"))


CONFLICTS = """conflicts AS (SELECT 'cfl_' || substr(sha256(concat_ws('|', entity_id, metric, unit, period_label)), 1, 16) AS conflict_id, entity_id, metric, unit, period_label, value_low, value_high, fact_ids,
  CASE WHEN metric = '5-LOW' THEN fact_ids[1] END AS resolved_fact_id, CASE WHEN metric = '5-LOW' THEN 'before' END AS resolution_note, CAST(NULL AS VARCHAR) AS resolved_by FROM radar)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer, in every state."""
    k = F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity_id"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey")
    state = F.element_at(F.array(*map(F.lit, ("draft", "in_review", "approved", "published", "in_review"))), (k % 5 + 1).cast("int"))
    approved = F.col("state").isin("approved", "published")
    rows = rows.select(F.concat(F.lit("rep_"), k).alias("report_id"), "entity_id", state.alias("state"), F.concat(F.lit("u"), k % 7).alias("author"), (F.col("c_acctbal") > 0).alias("complete"), F.timestamp_add("MINUTE", k.cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("generated_at"))
    return rows.withColumns({"approved_by": F.when(approved, "u9"), "approved_at": F.when(approved, F.col("generated_at")), "published_at": F.when(F.col("state") == "published", F.col("generated_at"))})


REPORTS = """reports AS (SELECT *, CASE WHEN state IN ('approved', 'published') THEN 'u9' END AS approved_by FROM (SELECT 'rep_' || c_custkey AS report_id, n_name AS entity_id, ['draft', 'in_review', 'approved', 'published', 'in_review'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS state,
  'u' || (c_custkey % 7) AS author, c_acctbal > 0 AS complete, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS generated_at FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wish to move a report for each order."""
    k = F.col("o_orderkey")
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("rep_"), "o_custkey").alias("report_id"), k.alias("seq"), pick(("in_review", "approved", "draft", "published"), k).alias("target"), pick(("viewer", "officer", "reviewer", "approver", "admin", "approver"), F.floor(k / 4)).alias("role"), F.concat(F.lit("u"), k % 7).alias("actor"), F.col("o_orderdate").cast("timestamp").alias("at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user for each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("user"), k).alias("username"), (k % 8 != 0).alias("is_active"), F.when(k % 50 == 0, "officer").when(k % 25 == 1, "admin").otherwise("viewer").alias("role"), (k % 4).cast("int").alias("failed_login_count"), F.when(k % 9 == 0, F.lit("2023-12-31").cast("timestamp")).alias("locked_until"), F.lit(None).cast("timestamp").alias("last_login_at"))


USERS = """users AS (SELECT c_custkey AS user_id, 'user' || c_custkey AS username, c_custkey % 8 <> 0 AS is_active, CASE WHEN c_custkey % 50 = 0 THEN 'officer' WHEN c_custkey % 25 = 1 THEN 'admin' ELSE 'viewer' END AS role,
  CAST(c_custkey % 4 AS INTEGER) AS failed_login_count, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2023-12-31' END AS locked_until FROM customer)"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user sees a nation; one in thirty sees everything."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey")
    return rows.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 30 == 0, "*").otherwise(F.col("n_name")).alias("entity_id"))


GRANTS = "grants AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 30 = 0 THEN '*' ELSE n_name END AS entity_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"
