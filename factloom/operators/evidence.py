"""Evidence as it stands on the page: spans in layout order, scoped through their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scope import Scope, scoped

PLACE = ("bbox_y0", "bbox_x0")
TABLE = ("page", "table_id", "row_idx", "col_idx")


def visible(evidence: DataFrame, documents: DataFrame, scope: Scope) -> DataFrame:
    """Spans whose document the scope may see."""
    mine = scoped(documents, scope, "owner_entity_id").select("document_id").distinct()
    return evidence.join(mine, "document_id", "left_semi")


def _placed(rows: DataFrame, within: list[str], order: tuple[str, ...]) -> DataFrame:
    """Adds position, from 1, by ``order`` and id: what has no place comes last."""
    by = [F.asc_nulls_last(c) for c in order]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*by, "evidence_id")))


def by_page(evidence: DataFrame, documents: DataFrame, scope: Scope, page: int | None = None) -> DataFrame:
    """The spans of each page, or of one page of each document, from top to bottom and left to right."""
    rows = evidence if page is None else evidence.where(F.col("page") == page)
    return _placed(visible(rows, documents, scope), ["document_id", "page"], PLACE)


def by_document(evidence: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The spans of each document version in the order that rebuilds its tables."""
    rows = evidence if kinds is None else evidence.where(F.col("kind").isin(*kinds))
    return _placed(rows, ["document_id", "document_version"], (*TABLE, *PLACE))


def page_lines(evidence: DataFrame) -> DataFrame:
    """document_id, document_version, page, lines from top to bottom; no page is a page of its own."""
    lines = evidence.where((F.col("kind") == "line") & F.col("text").isNotNull())
    row = F.struct(F.col("bbox_y0").isNull().alias("last"), "bbox_y0", "evidence_id", "text")
    return lines.groupBy("document_id", "document_version", "page").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.text).alias("lines"))


def count(evidence: DataFrame, documents: DataFrame, scope: Scope) -> DataFrame:
    return visible(evidence, documents, scope).agg(F.count("*").alias("evidence"))
