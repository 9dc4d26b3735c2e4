"""Files as a source: scan, extraction in steps, and the state of earlier runs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Ingest
from ..functions.text import normalise, text_hash
from ..plans.ranks import global_rank

@dataclass(frozen=True)
class Source:
    """What a parser is told of a file: where it is, and the settings of the run, such as
    how many pages to read, at what resolution and in what language."""

    path: str
    settings: Ingest


#: One step of extraction: the bytes of a file and its source to its text and number of pages.
Parser = Callable[[bytes, Source], tuple[str, int]]
_OUT = "path string, page_count int, text string, extraction_method string, is_scanned boolean, error string"


#: Times as JSON, to the microsecond.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """(path, modificationTime, length, content) of the files below ``folder``.
    An absent folder, or one without such a file, is an error.  A file that can't
    be read has no row here, but one in the listing that ``extract`` makes of it."""
    if not exists(spark, folder):
        raise ValueError(f"the source folder doesn't exist: {folder}")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    if not df.inputFiles():
        raise ValueError(f"no matching file below {folder}")
    return df


def file_system(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else "file://" + os.path.abspath(path))


def listing(files: DataFrame) -> DataFrame:
    """(path, length, modificationTime) of all files the scan was planned with, the last
    two null for one that has gone since; no content is read.  Empty files, which
    the scan leaves out, are looked up one by one, on the executors."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path in pdf["path"]:
                system, at = file_system(path)
                info = system.get_file_info(at)
                rows.append((path, info.size, info.mtime_ns // 1000 if info.mtime_ns is not None else None) if info.is_file else (path, None, None))
            yield pd.DataFrame({"path": [r[0] for r in rows], "length": pd.array([r[1] for r in rows], "Int64"), "us": pd.array([r[2] for r in rows], "Int64")})

    planned = [(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    seen = files.select("path", "length", "modificationTime")
    rest = files.sparkSession.createDataFrame(planned, "path string").join(seen, "path", "left_anti")
    return seen.unionByName(rest.mapInPandas(look, "path string, length long, us long").select("path", "length", F.timestamp_micros("us").alias("modificationTime")))


def with_empty(files: DataFrame, listed: DataFrame) -> DataFrame:
    """``files`` of ``scan`` and the empty ones of its ``listing``."""
    return files.select("path", "modificationTime", "length", "content").unionByName(listed.where("length = 0").select("path", "modificationTime", "length", F.lit(bytearray()).alias("content")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def numbered(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``idx``, the place in the order of paths, part by part."""
    keyed = files.withColumn("_parts", F.split(path, "/"))
    return global_rank(keyed.withColumn("_order", F.array_join("_parts", "\x01")).drop("_parts"), ["_order"], "idx").drop("_order").withColumn("idx", F.col("idx").cast("int"))


def ladder(native: Column, second: Column, ocr: Column, cfg: Ingest | None = None) -> Column:
    """(text, extraction_method, is_scanned) of texts that are already there: the
    first step is kept unless it is too short and a later one is longer."""
    cfg = cfg or Ingest()
    size = lambda c: F.length(F.regexp_replace(c, r"^\s+|\s+$", ""))
    n, s, o = (F.coalesce(c, F.lit("")) for c in (native, second, ocr))
    two = (size(n) < cfg.min_native_chars) & (size(s) > size(n))
    text2, how2 = F.when(two, s).otherwise(n), F.when(two, "pdfplumber").otherwise("native_fitz")
    short = size(text2) < cfg.min_native_chars
    three = short & (size(o) > size(text2)) & F.lit(cfg.enable_ocr)
    return F.struct(F.when(three, o).otherwise(text2).alias("text"), F.when(three, "ocr").otherwise(how2).alias("extraction_method"), short.alias("is_scanned"))


def extract(files: DataFrame, steps: list[tuple[str, Parser]], cfg: Ingest | None = None) -> DataFrame:
    """The text of each file by the first step that gives enough of it.

    ``steps``: (method, parser) in order, such as native text, a second parser
    and OCR; a later step is tried only while the text is too short, and taken
    only if it gives more.  A step that fails adds to ``error`` and the next one
    is tried; a file on which all fail is ``failed`` with an empty text.  The
    parsers are given the settings of the run; they run on the executors and must
    be importable there.
    """
    cfg = cfg or Ingest()
    least = cfg.min_native_chars

    def one(path: str, data: bytes) -> tuple:
        text, pages, how, scanned, errors = "", 0, "failed", False, []
        for k, (method, parse) in enumerate(steps):
            if k and len(text.strip()) >= least:
                break
            if method == "ocr":
                scanned = True
                if not cfg.enable_ocr:
                    continue
            try:
                got, n = parse(bytes(data), Source(path, cfg))
            except Exception as e:
                errors.append(f"{method}: {e}")
                continue
            pages = pages or n
            if how == "failed" or len(got.strip()) > len(text.strip()):
                text, how = got, method
        return path, pages, text, how, scanned or len(text.strip()) < least, " | ".join(errors) or None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in _OUT.split(",")]
        for pdf in parts:
            yield pd.DataFrame([one(*r) for r in pdf.itertuples(index=False)], columns=names)

    facts = files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_sha256"), F.col("modificationTime").alias("mtime"))
    text = files.select("path", "content").mapInPandas(run, _OUT)
    return _finished(text.join(facts, "path"))


def unreadable(missing: DataFrame) -> DataFrame:
    """Rows, as of ``extract``, of files (path, length, modificationTime) that couldn't be
    read: failed, each with a hash of its own."""
    lit = lambda v, t: F.lit(v).cast(t)
    return _finished(missing.select(
        "path", lit(0, "int").alias("page_count"), lit("", "string").alias("text"), lit("failed", "string").alias("extraction_method"), lit(False, "boolean").alias("is_scanned"), lit("unreadable", "string").alias("error"),
        F.coalesce("length", lit(0, "long")).alias("size_bytes"), F.concat(F.lit("__unreadable__:"), "path").alias("file_sha256"), F.col("modificationTime").alias("mtime"),
    ))


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_name", file_name(F.col("path"))).withColumn("text_sha256", text_hash(normalise(F.col("text"))))


def latest(state: DataFrame, key: str = "path", order: str = "run_at") -> DataFrame:
    """The last row of each key; of rows of the same time any one of those that
    compare largest.  An aggregation, so a key with many rows is no hot spot."""
    rest = [c for c in state.columns if c not in (key, order)]
    best = state.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in (order, *rest)]).select(*state.columns)


def unchanged(files: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("path", "size_bytes", "mtime")) -> DataFrame:
    """The rows of ``state`` that still hold for ``files``."""
    return state.join(files.select(*keys).distinct(), list(keys), "left_semi")


def changed(files: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("path", "size_bytes", "mtime")) -> DataFrame:
    """The rows of ``files`` that ``state`` doesn't have, or not like this."""
    return files.join(state.select(*keys).distinct(), list(keys), "left_anti")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State of earlier runs: a table, or, of a name that ends in ``.jsonl``, lines of
    JSON, of which broken ones are left out."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").options(**MICROS).json(path)
    return spark.read.schema(schema).parquet(path)
