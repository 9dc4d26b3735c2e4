"""Where each file goes, and under what name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

ROOT, TOGETHER = "01_classified", "Consolidated"
DUPLICATE, EXCLUDED, SKIPPED = "(not copied — duplicate)", "(not copied — DO NOT RETAIN)", "(copy skipped)"


def folder(kind: Column) -> Column:
    return F.when(kind.isin(*C.OTHER_TYPES), "Others").when(kind.isin(*C.EXCLUDED_TYPES), "_DO_NOT_RETAIN").otherwise(kind)


def unique_name(name: Column, idx: Column, nth: Column) -> Column:
    """``name``, or for all but the first in its folder ``stem__idx.suffix``."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    stem = name.substr(F.lit(1), F.length(name) - F.length(suffix))
    return F.when(nth == 1, name).otherwise(F.concat(stem, F.lit("__"), idx.cast("string"), suffix))


def layout_plan(rows: DataFrame, root: str = ROOT, together: str = TOGETHER) -> DataFrame:
    """``rows`` with ``target_folder`` and ``consolidated_path``.

    Excluded files go to a folder of their own, duplicates nowhere, the rest to
    the folder of their type, below ``_REVIEW`` if the type is in doubt.  Within
    a folder and name the first by idx keeps the name.  The windows are by folder
    and name, so no partition is larger than the number of equal names."""
    kind = F.coalesce("doc_type", F.lit(C.FALLBACK))
    review = (F.col("confidence") == "LOW") | (kind == C.FALLBACK)
    gone, dup = F.col("status") == "excluded", F.col("is_duplicate") & (F.col("status") != "excluded")
    d = rows.withColumn("_dir", F.when(gone, F.concat(F.lit(f"{root}/_DO_NOT_RETAIN/"), kind)).when(~dup, F.concat(F.lit(f"{root}/"), folder(kind), F.when(review, "/_REVIEW").otherwise(""))))
    d = d.withColumn("_kept", ~gone & ~dup)
    n = F.when(F.col("_dir").isNotNull(), F.row_number().over(Window.partitionBy("_dir", "file_name").orderBy("idx")))
    m = F.sum(F.col("_kept").cast("int")).over(Window.partitionBy("file_name").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"_n": n, "_m": m})
    target = F.when(F.col("_dir").isNull(), DUPLICATE).otherwise(F.concat(F.col("_dir"), F.lit("/"), unique_name(F.col("file_name"), F.col("idx"), F.col("_n"))))
    all_in = F.when(gone, EXCLUDED).when(dup, DUPLICATE).otherwise(F.concat(F.lit(f"{together}/"), unique_name(F.col("file_name"), F.col("idx"), F.col("_m"))))
    return d.withColumns({"target_folder": target, "consolidated_path": all_in}).drop("_dir", "_kept", "_n", "_m")
