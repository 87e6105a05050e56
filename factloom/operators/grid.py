"""Tables of text cells to facts, set-based: every table of every document at once.

Cells: document_id, table_id, page, row_idx, col_idx, text, extraction_method, text_layer_recognised, and the
document's fiscal_year and publisher_entity_id. Header row, label column and captions are aggregates of cells;
labels, headers and units are read once for each distinct string; a cell's facts or its reason for none come
from joins with its row, its column and its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, periods, units
from ..functions.text import is_null_token, new_id, parse_number, unit_in
from ..shared import saved

TABLE = ["document_id", "table_id"]
# Labels of rows that repeat others, parse confidence by method, and reasons someone can act on.
TOTALS = ("total", "grand total", "sub total", "sub-total", "subtotal", "all india", "cil total", "total cil", "overall")
CONFIDENCE = {"table_lattice": 0.95, "table_stream": 0.78, "spreadsheet_cell": 0.99, "pdf_text_layer": 0.70, "ocr": 0.60}
ACTIONABLE = ["no_unit", "ambiguous_unit", "wrong_dimension", "fails_self_check", "layout_unverified", "unverifiable_ocr_layer"]
CAPTION_UNIT = r"(?i)\b(?:in|are\s+in)\s+([A-Za-z.\s/']{2,30})\b"


def cells(evidence: DataFrame) -> DataFrame:
    """Evidence rows that have a place in a table."""
    return evidence.where(F.col("row_idx").isNotNull() & F.col("col_idx").isNotNull()).withColumn("table_id", F.coalesce("table_id", F.lit("t?"))).withColumn("text", F.trim(F.coalesce("text", F.lit("")))).withColumn("number", parse_number(F.col("text")))


def parse_confidence(method: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), method), F.lit(0.5))


def _mostly_words(filled, numeric):
    return numeric <= F.floor(filled / 2)


def layout(grid: DataFrame) -> DataFrame:
    """document_id, table_id, header (row), label (column) of tables with two rows and columns at least."""
    filled = F.count_if(F.col("text") != "")
    numeric = F.count_if(F.col("number").isNotNull())
    rows = grid.groupBy(*TABLE, "row_idx").agg(filled.alias("f"), numeric.alias("n"), F.max("col_idx").alias("hi"), F.min("col_idx").alias("lo"))
    head = rows.groupBy(*TABLE).agg(
        F.coalesce(F.min(F.when((F.col("f") >= 2) & _mostly_words(F.col("f"), F.col("n")), F.col("row_idx"))), F.min("row_idx")).alias("header"),
        F.count("*").alias("rows"), (F.max("hi") > F.min("lo")).alias("wide"), F.min("lo").alias("first"),
    ).where((F.col("rows") >= 2) & F.col("wide"))
    columns = grid.join(head, TABLE).where(F.col("row_idx") > F.col("header")).groupBy(*TABLE, "col_idx").agg(filled.alias("f"), numeric.alias("n"))
    label = columns.where((F.col("f") > 0) & _mostly_words(F.col("f"), F.col("n"))).groupBy(*TABLE).agg(F.min("col_idx").alias("label"))
    return head.join(label, TABLE, "left").select(*TABLE, "header", F.coalesce("label", "first").alias("label"))


def captions(grid: DataFrame, shape: DataFrame, page_lines: DataFrame | None = None) -> DataFrame:
    """document_id, table_id, place, caption: number-free rows above the header as one line each, and lines of the table's page."""
    above = grid.join(shape, TABLE).where((F.col("row_idx") < F.col("header")) & (F.col("text") != ""))
    rows = above.groupBy(*TABLE, "row_idx").agg(F.count("number").alias("n"), F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("c")).where("n = 0")
    out = rows.select(*TABLE, F.col("row_idx").cast("long").alias("place"), F.array_join(F.transform("c", lambda x: x.text), " ").alias("caption"))
    if page_lines is not None:
        of = grid.join(shape, TABLE).groupBy(*TABLE).agg(F.min("page").alias("page"))
        same = (of.document_id == page_lines.document_id) & of.page.eqNullSafe(page_lines.page)
        out = out.unionByName(of.join(page_lines, same).select(of.document_id, of.table_id, (F.col("line_no") - (1 << 40)).alias("place"), F.col("text").alias("caption")))
    return out


def extract(evidence: DataFrame, page_lines: DataFrame | None = None, refused: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts, and skipped cells with their reason. ``refused``: tables that another reader has taken."""
    grid = cells(evidence)
    if refused is not None:
        grid = grid.join(refused.select(*TABLE).distinct(), TABLE, "left_anti")
    # cells are read by six branches, and what is below is joined again and again: both end their plans here
    grid = saved(grid, "grid-cells")
    shape = saved(layout(grid), "grid-layout")
    said = saved(captions(grid, shape, page_lines), "grid-captions")
    inside = grid.join(shape, TABLE)
    header = inside.where((F.col("row_idx") == F.col("header")) & (F.col("text") != "")).select(*TABLE, "col_idx", F.col("text").alias("raw"))
    labels = inside.where((F.col("row_idx") > F.col("header")) & (F.col("col_idx") == F.col("label")) & (F.col("text") != "")).select(*TABLE, "row_idx", F.col("text").alias("raw"))
    strings = header.select("raw").union(labels.select("raw")).union(said.select(F.col("caption").alias("raw"))).union(grid.select(F.col("fiscal_year").alias("raw"))).distinct()
    metric = saved(names.lookup(strings, "raw", "metric").select("raw", F.col("id").alias("metric")), "grid-metrics")
    entity = saved(names.lookup(labels, "raw").select("raw", F.col("id").alias("entity_id"), "score"), "grid-entities")
    period = saved(periods.lookup(strings, "raw").where("kind is not null").select("raw", F.struct("kind", "start", "end", "label", "fiscal_year").alias("period")), "grid-periods")

    column = header.join(metric, "raw", "left").join(period, "raw", "left").select(*TABLE, "col_idx", F.col("metric").alias("c_metric"), F.col("period").alias("c_period"), unit_in(F.col("raw")).alias("c_unit"))
    row = labels.join(metric, "raw", "left").join(entity, "raw", "left").join(period, "raw", "left")
    row = row.select(*TABLE, "row_idx", F.col("raw").alias("row_label"), F.col("metric").alias("r_metric"), "entity_id", "score", F.col("period").alias("r_period"), unit_in(F.col("raw")).alias("r_unit"))
    unit = F.trim(F.regexp_replace(F.regexp_extract("caption", CAPTION_UNIT, 1), r"^[ .]+|[ .]+$", ""))
    told = said.join(metric, said.caption == metric.raw, "left").withColumn("u", F.when((unit != "") & (F.size(F.split(unit, r"\s+")) <= 4), unit))
    table = told.groupBy(*TABLE).agg(F.when(F.countDistinct("metric") == 1, F.min("metric")).alias("t_metric"), F.min_by("u", F.when(F.col("u").isNotNull(), F.col("place"))).alias("t_unit"))

    body = inside.where((F.col("row_idx") > F.col("header")) & (F.col("col_idx") != F.col("label")) & (F.col("text") != ""))
    rows = body.join(row, [*TABLE, "row_idx"]).join(column, [*TABLE, "col_idx"], "left").join(table, TABLE, "left").join(period.select(F.col("raw").alias("fiscal_year"), F.col("period").alias("d_period")), "fiscal_year", "left")
    rows = rows.withColumn("metric", F.coalesce("r_metric", "c_metric", "t_metric")).withColumn("period", F.coalesce("c_period", "r_period", "d_period"))
    rows = rows.withColumn("entity", F.coalesce("entity_id", F.when(F.col("r_metric").isNotNull(), F.col("publisher_entity_id")))).withColumn("raw_unit", F.coalesce("c_unit", "r_unit", "t_unit"))
    rows = saved(rows, "grid-joined")
    read = units.lookup(rows, "raw_unit").select(F.col("raw").alias("raw_unit"), "unit", "dimension", "factor", "ambiguous")
    rows = rows.join(read, "raw_unit", "left")
    total = F.lower(F.trim("row_label")).isin(*TOTALS)
    reason = (
        F.when(total, "total_row").when(F.col("number").isNull() & is_null_token(F.col("text")), "null_cell").when(F.col("number").isNull(), "not_a_number")
        .when(F.coalesce("text_layer_recognised", F.lit(False)), "unverifiable_ocr_layer").when(F.col("metric").isNull(), "no_metric").when(F.col("period").isNull(), "no_period")
        .when(F.col("entity").isNull(), "no_entity").when(F.col("raw_unit").isNull(), "no_unit").when(F.col("unit").isNull(), "ambiguous_unit").when(names.dimension(F.col("metric")) != F.col("dimension"), "wrong_dimension")
    )
    rows = saved(rows.withColumn("reason", reason), "grid-judged")
    # a total row is skipped once, not once a cell
    first = F.row_number().over(Window.partitionBy(*TABLE, "row_idx", "reason").orderBy("col_idx"))
    skips = rows.where("reason is not null").withColumn("_n", F.when(F.col("reason") == "total_row", first).otherwise(1)).where("_n = 1")
    skips = skips.select(*TABLE, "row_idx", "col_idx", "reason", F.when(F.col("reason") == "total_row", F.col("row_label")).otherwise(F.concat_ws(" | ", "row_label", "text")).alias("sample"))
    review = (F.coalesce("score", F.lit(1.0)) < 1) | F.col("ambiguous")
    facts = rows.where("reason is null").select(
        new_id("fact_", "document_id", "table_id", F.col("row_idx").cast("string"), F.col("col_idx").cast("string")).alias("fact_id"), F.col("entity").alias("entity_id"), "metric",
        (F.col("number") * F.col("factor")).alias("value"), "unit", "dimension", F.col("number").alias("raw_value"), "raw_unit",
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), F.col("period.label").alias("period_label"), F.col("period.fiscal_year").alias("fiscal_year"),
        "document_id", "table_id", "page", F.concat(F.lit("r"), "row_idx", F.lit("c"), "col_idx").alias("cell_ref"), F.substring(F.concat_ws(" | ", "row_label", "text"), 1, 1000).alias("snippet"), "extraction_method",
        parse_confidence(F.col("extraction_method")).alias("conf_parse"), F.lit(None).cast("double").alias("conf_ocr"),
        F.col("ambiguous").alias("unit_ambiguous"), F.when(review, "needs_review").otherwise("extracted").alias("status"),
    )
    return facts, skips
