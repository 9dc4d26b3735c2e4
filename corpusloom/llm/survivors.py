"""Best representative of each duplicate group: field-by-field survivorship.

One aggregation takes, for each attribute, the maximum of a composite struct
(usable?, source priority, timestamp, value).  Maxima combine on the map side,
so a group with a third of all rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust in an extraction method; null or unknown is 0.
METHODS = ("failed", "ocr", "pdfplumber", "native_fitz")


def method_rank(c: Column) -> Column:
    m = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.coalesce(*[F.when(m == F.lit(name), F.lit(k + 1)) for k, name in enumerate(METHODS)], F.lit(0))


def usable(c: Column) -> Column:
    """A size or length as a rank: null or negative is worst."""
    return F.when(c >= 0, c.cast("long")).otherwise(F.lit(-1).cast("long"))


def survive(rows: DataFrame, key: str, fields: Sequence[tuple[str, Column, Column]], *more: Column) -> DataFrame:
    """One row for each ``key``: the surviving value of each field.

    ``fields``: (name, whether the value can be used, what makes it better), the
    latter a struct or number compared upwards.  Of equally good values the
    largest is taken, so the result doesn't depend on row order.  A field no
    member can use is null.  Rows with a null key have no group and drop out.
    """
    best = [
        F.max(F.when(good, F.struct(rank.alias("rank"), F.col(name).alias("value")))).getField("value").alias(name)
        for name, good, rank in fields
    ]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*best, *more)


def _recency() -> Column:
    return F.struct(F.col("mtime").isNotNull(), F.col("mtime"), -F.col("idx"))


def golden_records(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One built record for each group of ``groups`` (idx, group_idx), taking
    ``extraction_method``, ``text_len``, ``size_bytes``, ``entity_name``,
    ``contract_date`` and ``doc_type`` field by field; ``keeper_idx`` is the member
    that is best by (method, text_len, size_bytes, mtime, smaller idx), and
    ``dominant`` whether no member beats it in any of the three.

    Repeated rows change no maximum.  Null, blank or negative values never
    survive a usable one.  A group in which a field is unusable throughout has
    null there.
    """
    own = ("idx", "extraction_method", "text_len", "size_bytes", "entity_name", "contract_date", "doc_type", "mtime")
    r = records.select(*own).join(groups.select("idx", "group_idx"), "idx")
    m, t, s = method_rank(F.col("extraction_method")), usable(F.col("text_len")), usable(F.col("size_bytes"))
    r = r.withColumns({"m": m, "t": t, "s": s, "method": F.element_at(F.array(*[F.lit(x) for x in METHODS]), F.greatest(m, F.lit(1)))})
    trust = lambda name: (name, F.length(F.trim(F.col(name))) > 0, F.struct(F.col("m"), F.col("mtime"), -F.col("idx")))
    fields = [
        ("method", F.col("m") > 0, F.struct(F.col("m"))),
        ("text_len", F.col("t") >= 0, F.struct(F.col("t"))),
        ("size_bytes", F.col("s") >= 0, F.struct(F.col("s"))),
        trust("entity_name"),
        trust("contract_date"),
        trust("doc_type"),
    ]
    whole = F.max(F.struct("m", "t", "s", _recency().alias("recency"), "idx"))
    out = survive(r, "group_idx", fields, whole.alias("w"), F.max("m").alias("bm"), F.max("t").alias("bt"), F.max("s").alias("bs"), F.countDistinct("idx").alias("members"))
    # The lexicographic best equals the maximum of each field exactly when some
    # member is at least as good as every other in all of them.
    return out.select(
        "group_idx", F.col("method").alias("extraction_method"), "text_len", "size_bytes", "entity_name", "contract_date", "doc_type",
        F.col("w.idx").alias("keeper_idx"), ((F.col("w.m") == F.col("bm")) & (F.col("w.t") == F.col("bt")) & (F.col("w.s") == F.col("bs"))).alias("dominant"), "members",
    )
