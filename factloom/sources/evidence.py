"""Evidence from files, as plain DataFrames: spreadsheets, word files, text, blobs, manifests, and PDF where a parser is there.

Office files are ZIP archives of XML, read with the standard library inside mapInPandas; each file is one row
of ``binaryFile`` and yields its cells or lines.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import new_id, sniff

SCHEMA = "document_id string, page int, kind string, table_id string, cell_ref string, row_idx int, col_idx int, text string, extraction_method string"
# Limits of what is let in.
MOST_BYTES, MOST_RATIO, MOST_ENTRIES = 512 << 20, 100, 2000


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, content_hash, document_id, kind of every file below a path; Spark's reader leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.select("path", "length", "content", "content_hash", new_id("doc_", "content_hash").alias("document_id"), F.coalesce(sniff(F.col("content")), F.lit("unknown")).alias("kind"))


def inspect(files: DataFrame) -> DataFrame:
    """Files with a reason (null if let in): empty, too_large, unsupported, or what is wrong with the archive."""
    import pandas as pd

    @F.pandas_udf("string")
    def archive(content, kind):
        return pd.Series([archive_fault(c) if k == "zip" else None for c, k in zip(content, kind, strict=True)], dtype=object)

    base = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large").when(F.col("kind").isin("unknown", "ole"), "unsupported")
    return files.withColumn("reason", F.coalesce(base, archive("content", "kind")))


def archive_fault(content: bytes) -> str | None:
    """What is wrong with a ZIP archive, if anything."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
    except zipfile.BadZipFile:
        return "unreadable"
    if len(entries) > MOST_ENTRIES:
        return "too_many_entries"
    if any(e.filename.startswith("/") or ".." in e.filename.split("/") for e in entries):
        return "traversal"
    if any(e.flag_bits & 1 for e in entries):
        return "encrypted"
    if sum(e.file_size for e in entries) > MOST_RATIO * max(1, len(content)):
        return "ratio"
    return None


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out


def sheet_cells(content: bytes) -> list[tuple]:
    """(page, table, reference, row, column, text) of a workbook's cells, counted from 1; blank ones are left out."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t")
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        for number, title in enumerate(titles, 1):
            if (part := f"xl/worksheets/sheet{number}.xml") not in names:
                continue
            for c in (e for e in ElementTree.fromstring(z.read(part)).iter() if local(e) == "c"):
                v = next((x.text for x in c if local(x) == "v"), None)
                value = text(c) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v else v
                if value and value.strip():
                    ref = c.get("r")
                    out.append((number, title, ref, int(re.search(r"\d+", ref)[0]), _column(ref), value.strip()))
    return out


def word_rows(content: bytes) -> tuple[list[str], list[tuple[int, int, int, str]]]:
    """Paragraphs, and (table, row, column, text) of the cells of a word file, counted from 0."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t").strip()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if local(e) == "body")
    lines = [t for e in body if local(e) == "p" and (t := text(e))]
    tables = [e for e in body if local(e) == "tbl"]
    rows = lambda t: [r for r in t if local(r) == "tr"]
    return lines, [(n, i, j, v) for n, t in enumerate(tables) for i, r in enumerate(rows(t)) for j, c in enumerate(x for x in r if local(x) == "tc") if (v := text(c))]


def digitize(files: DataFrame) -> DataFrame:
    """Evidence rows of all files that have a reader: workbooks and word files; PDF needs pymupdf and is left out without it."""
    import pandas as pd

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(doc, kind, content):
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                listed = set(z.namelist())
            if "xl/workbook.xml" in listed:
                return [(doc, p, "sheet_cell", t, ref, r, c, v, "spreadsheet_cell") for p, t, ref, r, c, v in sheet_cells(content)]
            if "word/document.xml" in listed:
                lines, grid = word_rows(content)
                return [(doc, None, "line", None, None, None, None, v, "pdf_text_layer") for v in lines] + [(doc, None, "table_cell", f"t{n}", f"r{i}c{j}", i, j, v, "table_lattice") for n, i, j, v in grid]
        if kind == "pdf":
            try:
                import pymupdf
            except ImportError:
                return []
            with pymupdf.open(stream=content, filetype="pdf") as pdf:
                return [(doc, n, "line", None, None, None, None, line.strip(), "pdf_text_layer") for n, page in enumerate(pdf, 1) for line in page.get_text().splitlines() if line.strip()]
        return []

    def run(batches):
        for batch in batches:
            rows = [r for doc, kind, content in zip(batch.document_id, batch.kind, batch.content, strict=True) for r in read(doc, kind, content)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("page", "row_idx", "col_idx")})

    return files.select("document_id", "kind", "content").mapInPandas(run, SCHEMA)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of JSON manifests."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")


def write_manifest(entries: DataFrame, path: str) -> None:
    entries.orderBy("path").write.mode("overwrite").json(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 16, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
