"""The summary and the tracker of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import printable

TRACKER = ("idx", "file_name", "doc_type", "needs_review", "status", "is_duplicate", "duplicate_of", "entity_name", "contract_date", "page_count", "is_scanned")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(c).alias
    s = F.col("status")
    return rows.agg(
        F.count("*").alias("total"), n(s == "retained")("retained"), n(s == "removed")("removed"), n(s == "excluded")("excluded_do_not_retain"), n(F.col("needs_review"))("needs_review"),
        n(F.col("is_scanned"))("scanned"), n(F.col("extraction_method") == "ocr")("ocr_read"), n(F.col("extraction_method") == "failed")("failed_extraction"),
    )


def tracker_rows(rows: DataFrame) -> DataFrame:
    """The columns of the tracker, strings without control characters."""
    return rows.select(*[printable(F.col(c)).alias(c) if rows.schema[c].dataType.simpleString() == "string" else F.col(c) for c in TRACKER])


def column_widths(rows: DataFrame, sample: int = 500) -> DataFrame:
    """(column, width) of the tracker's columns, from its first rows: for the look
    of the sheet only."""
    top = rows.select(*TRACKER).orderBy("idx").limit(sample)
    widest = top.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in TRACKER])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.lit(10), F.greatest(F.lit(len(c)), F.coalesce(c, F.lit(0))) + 2), F.lit(50)).alias("width")) for c in TRACKER])
    return widest.select(F.explode(pairs).alias("p")).select("p.*")
