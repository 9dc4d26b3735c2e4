"""``python -m corpusloom.cli --source DIR --output DIR --parser MODULE:FUNCTION ...``"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from .config import Config
from .plans.pipeline import run
from .session import session


def _parser(spec: str):
    """``method=module:function``, a function from bytes and their source to (text, pages)."""
    method, _, target = spec.partition("=")
    module, _, name = target.partition(":")
    return method, getattr(importlib.import_module(module), name)


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("--source", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--parser", action="append", default=[], help="method=module:function, in the order they are tried")
    p.add_argument("--similarity", type=float)
    p.add_argument("--threads", type=int, help="tasks at once of a local session; a cluster has its own executors")
    p.add_argument("--state", help="where the state of runs is kept: a table, or lines of JSON (.jsonl)")
    p.add_argument("--no-ocr", action="store_true")
    p.add_argument("--no-copy", action="store_true")
    a = p.parse_args(args)
    cfg = Config(source=a.source, output=a.output)
    if a.similarity is not None:
        cfg = replace(cfg, dedupe=replace(cfg.dedupe, similarity=a.similarity))
    if a.no_ocr:
        cfg = replace(cfg, ingest=replace(cfg.ingest, enable_ocr=False))
    if a.threads is not None and a.threads < 1:
        p.error("--threads must be 1 or more")
    local = {"spark.master": f"local[{a.threads}]"} if a.threads else {}
    return run(session(**local), cfg, [_parser(s) for s in a.parser], copy=not a.no_copy, state=a.state)


if __name__ == "__main__":
    main()
