"""A benchmark table of facts by mixed-radix arithmetic: entities x metrics x years x spans, repeated to any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import fiscal_label_of

ENTITIES, METRICS, YEARS, SPANS = 29, 20, 6, 12


def facts(spark: SparkSession, rows: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Each row's number gives its digits; one span in twelve is a whole fiscal year, one row in 19 needs a review."""
    n = F.col("id")
    digit = lambda below, radix: F.pmod(F.floor(n / below), F.lit(radix)).cast("int")
    entity, metric, year, span = digit(1, ENTITIES), digit(ENTITIES, METRICS), digit(ENTITIES * METRICS, YEARS), digit(ENTITIES * METRICS * YEARS, SPANS)
    begin = F.make_date(2019 + year, F.lit(4), F.lit(1))
    month = F.add_months(begin, span)
    whole = span == 0
    label = fiscal_label_of(2019 + year)
    return spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(
        F.concat(F.lit("fact_"), n).alias("fact_id"), F.concat(F.lit("entity_"), entity).alias("entity_id"), F.concat(F.lit("metric_"), metric).alias("metric"),
        (1000.0 + F.pmod(n * 7919, F.lit(100_000)) / 7.0).alias("value"), F.lit("t").alias("unit"), begin.alias("_b"), F.when(whole, begin).otherwise(month).alias("period_start"),
        F.when(whole, F.make_date(2020 + year, F.lit(3), F.lit(31))).otherwise(F.last_day(month)).alias("period_end"), F.when(whole, label).otherwise(F.date_format(month, "MMM yyyy")).alias("period_label"), label.alias("fiscal_year"),
        F.when(n % 19 == 0, "needs_review").otherwise("validated").alias("status"), F.concat(F.lit("doc_"), n % 3404).alias("document_id"), F.lit(0.95).alias("conf_parse"), F.lit(None).cast("double").alias("conf_ocr"), F.lit(None).cast("double").alias("conf_answer"), F.lit(False).alias("unit_ambiguous"),
    ).drop("_b")


# The demonstration tables, in million tonnes.
PRODUCTION = [("SECL", 167.00, 193.00), ("MCL", 193.00, 210.50), ("WCL", 62.00, 68.50), ("NCL", 131.00, 139.00), ("Total", 553.00, 611.00)]
YEARS_SHOWN = ("FY2023-24", "FY2024-25")


def demo_evidence(spark: SparkSession, document: str = "doc_demo", metric: str = "Coal production", rows: list | None = None) -> DataFrame:
    """The demonstration table as cells: caption, header, a row for each company."""
    cells = [(0, 0, f"{metric} by subsidiary"), (1, 0, "(Figures in Million Tonnes)"), (2, 0, "Subsidiary"), *((2, i, y) for i, y in enumerate(YEARS_SHOWN, 1))]
    for r, (name, *values) in enumerate(rows or PRODUCTION, 3):
        cells += [(r, 0, name), *((r, c, f"{v:.2f}") for c, v in enumerate(values, 1))]
    schema = "document_id string, table_id string, page int, row_idx int, col_idx int, text string, extraction_method string, text_layer_recognised boolean, fiscal_year string, publisher_entity_id string"
    return spark.createDataFrame([(document, "t1", 1, r, c, t, "table_lattice", False, None, "cil") for r, c, t in cells], schema)
