"""The staged pipeline as a stream: evidence arrives, facts follow, and a batch run again replaces its own rows.

Each micro-batch goes through the same operators as a batch job and overwrites the partitions of its documents,
so a retry changes nothing. Corpus-wide steps (radar, topics) read the stored facts, not the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts as fact_ops
from ..operators import grid, rules, state, statement
from ..scope import Scope
from ..shared import saved


def read_tables(evidence: DataFrame) -> DataFrame:
    """Facts as read off the tables: by the statement reader those that it takes, by the general one the others."""
    facts, _ = grid.extract(evidence, refused=statement.statements(evidence))
    stated = statement.facts(statement.read(evidence), evidence)
    return facts.unionByName(stated).withColumn("conf_answer", F.lit(None).cast("double")).withColumn("notes", F.lit(None).cast("string"))


def judge(facts: DataFrame, history: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """States set by confidence and rules; with the bucket of the document. ``history``: stored facts, which the yearly swing also
    looks at. Keep ``facts`` before: each rule reads them."""
    columns = ["fact_id", "entity_id", "metric", "unit", "value", "status", "fiscal_year", "period_start"]
    past = facts.select(*columns) if history is None else facts.select(*columns).unionByName(history.select(*columns))
    found = saved(rules.run(facts, past).select("fact_id", F.col("rule").alias("note")), "ingest-findings")
    out = state.promote_high(state.flag_for_review(state.flag_low(facts), found))
    return out.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)))


def stored(spark: SparkSession, out: str, without: DataFrame) -> DataFrame | None:
    """Validated facts of other documents than those of ``without``, if any are stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(out).where("status = 'validated'").join(without.select("document_id").distinct(), "document_id", "left_anti")


def ingest(spark: SparkSession, source: str, schema, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read evidence files as they arrive and keep the facts of each document at ``out``."""

    def batch(evidence: DataFrame, number: int) -> None:
        kept = evidence.persist()
        facts = read_tables(kept).persist()
        judged = saved(judge(facts, stored(spark, out, kept)), "ingest-facts")
        state.write_partitions(judged, out, ["bucket", "document_id"])
        facts.unpersist()
        kept.unpersist()

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def settle(facts: DataFrame, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """The corpus-wide step: the radar's groups, and the facts with their members flagged."""
    scope = scope or Scope.everything()
    groups = fact_ops.radar(facts, scope)
    return groups, state.reconcile(facts, groups, scope)


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Jobs by tumbling window and state, late ones up to the watermark: works on a stream and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("starts"), "event_type", "n")
