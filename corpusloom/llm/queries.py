"""Queries over the tables of a folder, one or more for each problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import bounded, cut
from ..sources.tables import table
from .components import connected_groups, record_groups
from .names import name_pairs, nicknames, same_names
from .nearsets import alike_pairs, alike_sets
from .packing import CAPACITY, fill_report, packed, token_items
from .pii import personal_items, redacted
from .residue import residue
from .scans import scan_noise
from .survivors import golden_records
from .tokens import token_ids

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "dedup_record")
    return golden_records(r, record_groups(r)).where("dominant").select("group_idx", F.col("keeper_idx").alias("idx"))


def p1_golden(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "dedup_record")
    return golden_records(r, record_groups(r))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return record_groups(table(spark, folder, "dedup_record"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "dedup_record", "entity_name").unionByName(table(spark, folder, "doc_metadata", "entity_name"))
    return same_names(names.withColumnRenamed("entity_name", "name"), nicknames(table(spark, folder, "name_alias")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise(table(spark, folder, "extracted_doc", "idx", "text"), "idx", "text", _words(spark, folder)[0]).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise(table(spark, folder, "extracted_doc", "idx", "text").distinct(), "idx", "text", _words(spark, folder)[0], repair=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return name_pairs(_entities(spark, folder))


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with one spelling that stands for its entity."""
    e = _entities(spark, folder)
    return e.join(e.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("spellings")), "entity").select("name", "entity_name", "spellings")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_pairs(*alike_sets(table(spark, folder, "dedup_record"), "idx", "doc_type", "text_norm"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: its class of copies, its group and the number of
    other classes it is alike to."""
    members, pairs = alike_sets(table(spark, folder, "dedup_record"), "idx", "doc_type", "text_norm")
    pairs = cut(pairs, "pairs")
    groups = connected_groups(pairs.select(F.col("ha").alias("u"), F.col("hb").alias("v")))
    n = pairs.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    out = members.join(groups.withColumnRenamed("id", "h"), "h", "left").join(n, "h", "left")
    return out.select("idx", F.col("h").alias("class_id"), F.coalesce("group", "h").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "extracted_doc", "idx", "text"), "idx", "text").select("idx")


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "extracted_doc", "idx", "text"), "idx", "text")


def _words(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Two small fixed tables: ordinary words, and given names in all forms; larger
    ones are an error."""
    common = [r["word"] for r in bounded(table(spark, folder, "lexicon", "word")) if r["word"]]
    given = [x for r in bounded(table(spark, folder, "name_alias", "given_name", "short_form")) for x in r if x]
    return common, given


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packed(token_items(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", CAPACITY))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_containers(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_items(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", *_words(spark, folder)).select("doc_id", "line_no", "kind").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redacted(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", *_words(spark, folder))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
