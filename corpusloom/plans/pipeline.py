"""All stages of a run, over a table of texts or a folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.progress import Listener, Progress, spell
from ..functions.text import normalised
from ..operators.classify import classify, initial_status, size_kb
from ..operators.dedupe import deduplicate
from ..operators.layout import SKIPPED, TOGETHER, layout_plan
from ..operators.metadata import extract_metadata
from ..operators.report import run_summary
from ..sources import files as S
from ..sources.sinks import append_state, clear_folders, copy_files, write_csv, write_tracker
from .cut import cut

def enrich(docs: DataFrame, cfg: C.Config | None = None) -> DataFrame:
    """``docs`` (idx, file_name, text, size_bytes, error, ...) with type, fields,
    initial status and derived columns; the text is left out."""
    cfg = cfg or C.Config()
    d = classify(docs, cfg=cfg.classify)
    d = extract_metadata(d, default=cfg.default_date)
    d = normalised(d, "text")
    return d.withColumns({
        "size_kb": size_kb(F.col("size_bytes")), "text_len": F.length(F.coalesce("text", F.lit(""))), "extract_error": F.coalesce("error", F.lit("")), "status": initial_status(F.col("doc_type")),
    }).drop("text", "error")


def analyse(docs: DataFrame, cfg: C.Config | None = None) -> DataFrame:
    """Enriched, deduplicated and laid out; one row for each document."""
    cfg = cfg or C.Config()
    rows = cut(enrich(docs, cfg), "rows")
    return layout_plan(deduplicate(rows, cfg.dedupe, last=True)).drop("text_norm")


_STATE = "path string, file_name string, size_bytes long, page_count int, text string, extraction_method string, file_sha256 string, is_scanned boolean, error string, mtime timestamp, text_sha256 string"
_NAMES = [x.strip().split(" ")[0] for x in _STATE.split(",")]


def ingest(spark: SparkSession, cfg: C.Config, steps: list[tuple[str, S.Parser]], state: str | None = None) -> DataFrame:
    """The documents of a folder; files that haven't changed since an earlier run
    (same path, size, time and settings) aren't read again, and files that can't
    be read are failed ones.  A state that is there but can't be read is an error."""
    found = S.scan(spark, cfg.source)
    i = cfg.ingest
    mark = f"{i.min_native_chars}-{i.ocr_max_pages}-{i.ocr_dpi}-{i.ocr_lang}-{i.enable_ocr}"
    listed = cut(S.listing(found), "listing")
    keyed = listed.withColumns({"size_bytes": F.col("length"), "mtime": F.col("modificationTime")})
    old = None
    if state and S.exists(spark, state):
        old = S.latest(S.read_state(spark, state, f"{_STATE}, settings string, run_at timestamp").where(F.col("settings") == mark).select(*_NAMES, "run_at"))
    new = keyed if old is None else S.changed(keyed, old)
    read = S.extract(S.with_empty(found, listed).join(new.select("path"), "path", "left_semi"), steps, i)
    got = cut(read.select(*_NAMES), "extracted")
    missing = S.unreadable(new.join(got.select("path"), "path", "left_anti")).select(*_NAMES)
    if state:
        append_state(got.withColumns({"settings": F.lit(mark), "run_at": F.current_timestamp()}), state)
    docs = got.unionByName(missing)
    return S.numbered(docs if old is None else docs.unionByName(S.unchanged(keyed, old).select(*_NAMES)))


def run(spark: SparkSession, cfg: C.Config, steps: list[tuple[str, S.Parser]], copy: bool = True, log: Callable[[str], None] = print, progress: Listener | None = None, state: str | None = None) -> dict:
    """Read, analyse, lay out and report; the summary as a dict.  If a later stage
    fails, what is known of the documents by then is written to
    ``EMERGENCY_BACKUP.csv`` before the error goes on."""
    p = Progress(progress)
    rows: DataFrame | None = None
    try:
        with p.watching(spark, "extract"):
            docs = cut(ingest(spark, cfg, steps, state or f"{cfg.output}/state"), "documents")
        log("documents read")
        with p.watching(spark, "enrich"):
            rows = cut(enrich(docs, cfg), "rows")
        with p.watching(spark, "dedupe"):
            rows = cut(layout_plan(deduplicate(rows, cfg.dedupe)).drop("text_norm"), "report")
        log("documents classified and deduplicated")
        if copy:
            clear_folders(spark, cfg.output)
            with p.watching(spark, "organise"):
                rows = cut(copy_files(rows, cfg.output), "copied")
        else:
            rows = rows.withColumns({"target_folder": F.lit(SKIPPED), "consolidated_path": F.lit(SKIPPED)})
            p.at("organise", 1, 1, SKIPPED)
        counts = run_summary(rows).first().asDict()
        note = "enabled" if cfg.ingest.enable_ocr else "disabled"
        tracker = write_tracker(rows, [*counts.items(), ("ocr_engine", note)], f"{cfg.output}/migration_tracker.xlsx", log)
        p.at("tracker", 1, 1, tracker)
    except Exception as e:
        log(f"failed after {spell(p.elapsed)}: {e}")
        if rows is not None:
            log(f"what is known so far is in {write_csv(rows.drop('text_norm'), f'{cfg.output}/EMERGENCY_BACKUP.csv')}")
        raise
    p.at("done", 1, 1)
    out = counts | {"ocr_engine": note, "consolidated_dir": f"{cfg.output}/{TOGETHER}", "tracker": tracker, "output_dir": cfg.output, "elapsed_sec": round(p.elapsed, 1)}
    for k, v in out.items():
        log(f"  {k:24}: {v}")
    return out
