"""Where results go: CSV, a spreadsheet, the state of a run, copied files."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import ROOT, TOGETHER
from ..operators.report import TRACKER, tracker_rows
from .files import MICROS, file_system

# Fills of the tracker's rows.
FILLS = {"header": "1F4E78", "review": "FFF2CC", "removed": "F2F2F2", "excluded": "F8CBAD"}
#: Rows a sheet can hold; a larger table is written as CSV.
SHEET_ROWS = 1_048_575
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def flat(rows: DataFrame) -> DataFrame:
    """Arrays joined by ``, ``, the rest as it is."""
    return rows.select(*[F.array_join(f.name, ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str) -> str:
    flat(rows).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return path


def append_state(rows: DataFrame, path: str) -> None:
    """Add to the state of a run; as lines of JSON if the name ends in ``.jsonl``."""
    w = rows.write.mode("append")
    w.options(**MICROS).json(path) if path.endswith(".jsonl") else w.parquet(path)


def _cell(ref: str, value, style: int) -> str:
    if value is None or value == "":
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


def _sheet(rows: Iterable[tuple[list, int]], widths: list[int], frozen: bool, ref: str = "") -> str:
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    body = "".join(f'<row r="{n}">' + "".join(_cell(f"{chr(65 + i)}{n}", v, style) for i, v in enumerate(values)) + "</row>" for n, (values, style) in enumerate(rows, 1))
    table = '<tableParts count="1"><tablePart r:id="rId1"/></tableParts>' if ref else ""
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{pane}<cols>{cols}</cols><sheetData>{body}</sheetData>{table}</worksheet>'


def write_xlsx(rows: list[Row], summary: list[tuple[str, object]], path: str) -> str:
    """A workbook of the tracker and the summary, without a library."""
    fill = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    styles = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="3"><font/><font><b/><color rgb="FFFFFFFF"/></font><font><b/></font></fonts>'
        f'<fills count="6"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="6"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/><xf fillId="4" applyFill="1"/><xf fillId="5" applyFill="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>'
    )
    style = lambda r: 4 if r["status"] == "excluded" else 3 if r["status"] == "removed" else 2 if r["needs_review"] else 0
    widths = [min(50, max(10, 2 + max([len(c), *(len(str("" if r[c] is None else r[c])) for r in rows[:500])]))) for c in TRACKER]
    ref = f"A1:{chr(64 + len(TRACKER))}{len(rows) + 1}" if rows else ""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + (f'<Override PartName="/xl/tables/table1.xml" ContentType="{kind}.table+xml"/>' if ref else "") + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="Tracker" sheetId="1" r:id="rId1"/><sheet name="Summary" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": styles,
        "xl/worksheets/sheet1.xml": _sheet([(list(TRACKER), 1), *(([r[c] for c in TRACKER], style(r)) for r in rows)], widths, True, ref),
        "xl/worksheets/sheet2.xml": _sheet([(["Document migration — summary"], 5), ([], 0), *(([k, v], 0) for k, v in summary)], [34, 60], False),
    }
    if ref:
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/table" Target="../tables/table1.xml"/></Relationships>'
        cols = "".join(f'<tableColumn id="{i}" name="{c}"/>' for i, c in enumerate(TRACKER, 1))
        parts["xl/tables/table1.xml"] = f'{head}<table xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" id="1" name="TrackerTable" displayName="TrackerTable" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(TRACKER)}">{cols}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>'
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return path


def write_tracker(rows: DataFrame, summary: list[tuple[str, object]], path: str, log: Callable[[str], None] = print) -> str:
    """The tracker as a workbook, if a sheet can hold it, else (or if that fails)
    as CSV.  Only a table that fits a sheet comes to the driver."""
    t = tracker_rows(rows)
    try:
        n = t.limit(SHEET_ROWS + 1).count()
        if n > SHEET_ROWS:
            raise ValueError("too many rows for a sheet")
        return write_xlsx(t.orderBy("idx").collect(), summary, path)
    except Exception as e:
        log(f"no workbook: {e}; the tracker is written as CSV")
        return write_csv(t, re.sub(r"\.xlsx$", "", path) + ".csv")


def clear_folders(spark: SparkSession, output: str, names: tuple[str, ...] = (ROOT, TOGETHER)) -> None:
    """Remove what earlier runs copied."""
    sc = spark.sparkContext
    for name in names:
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{output}/{name}")
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def put_files(texts: DataFrame, folder: str) -> int:
    """Write each (name, text) as a file of ``folder``, on the executors; their number."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, at = file_system(folder)
        to.create_dir(at, recursive=True)
        for pdf in parts:
            for name, text in zip(pdf["name"], pdf["text"]):
                with to.open_output_stream(f"{at}/{name}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return texts.select("name", "text").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def copy_files(rows: DataFrame, output: str) -> DataFrame:
    """Copy each file of ``rows`` to its places below ``output``, on the executors and
    on whatever file system the paths name, and return ``rows`` with the places;
    of a copy that fails ``(copy failed: ...)`` takes the place.  Use ``cut`` on the
    result: each evaluation copies."""

    def copy(path: str, dest: str | None) -> str | None:
        from pyarrow import fs

        if not dest or dest.startswith("("):
            return dest
        try:
            target = f"{output.rstrip('/')}/{dest}"
            (a, x), (b, y) = file_system(path), file_system(target)
            b.create_dir(os.path.dirname(y), recursive=True)
            fs.copy_files(x, y, source_filesystem=a, destination_filesystem=b)
            return target
        except Exception as e:
            return f"(copy failed: {e})"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for c in ("target_folder", "consolidated_path"):
                pdf[c] = [copy(p, d) for p, d in zip(pdf["path"], pdf[c])]
            yield pdf

    places = rows.select("path", "target_folder", "consolidated_path").mapInPandas(run, "path string, target_folder string, consolidated_path string")
    return rows.drop("target_folder", "consolidated_path").join(places, "path")
