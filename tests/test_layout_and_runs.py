import re
import time
import zipfile
from datetime import datetime
from xml.dom.minidom import parseString

import pytest
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.operators.layout import layout_plan
from corpusloom.operators.report import TRACKER, column_widths, run_summary
from corpusloom.plans.cut import cut
from corpusloom.plans.pipeline import ingest, run
from corpusloom.sources import files as S
from corpusloom.sources.sinks import copy_files, write_csv, write_tracker, write_xlsx
from corpusloom.streaming.incremental import arrivals, documents, enrich_to, first_deliveries


def test_layout(spark):
    rows = [(0, "a.pdf", "Contracts", "HIGH", "retained", False), (1, "a.pdf", "Contracts", "HIGH", "retained", False), (2, "a.pdf", "PO", "LOW", "retained", False), (3, "b.tar.gz", "Invoice", "HIGH", "excluded", False), (4, "c", None, None, "removed", True), (5, ".x", None, "LOW", "retained", False), (6, "b.tar.gz", "Invoice", "HIGH", "excluded", False)]
    got = {r["idx"]: (r["target_folder"], r["consolidated_path"]) for r in layout_plan(spark.createDataFrame(rows, "idx int, file_name string, doc_type string, confidence string, status string, is_duplicate boolean")).collect()}
    assert got[0] == ("01_classified/Contracts/a.pdf", "Consolidated/a.pdf")
    assert got[1] == ("01_classified/Contracts/a__1.pdf", "Consolidated/a__1.pdf")
    assert got[2] == ("01_classified/Others/_REVIEW/a.pdf", "Consolidated/a__2.pdf")
    assert got[3][0] == "01_classified/_DO_NOT_RETAIN/Invoice/b.tar.gz" and got[6][0].endswith("b.tar__6.gz")
    assert got[4] == ("(not copied — duplicate)", "(not copied — duplicate)")
    assert got[5] == ("01_classified/Unclassified/_REVIEW/.x", "Consolidated/.x")


def test_scan_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        S.scan(spark, str(tmp_path / "absent"))
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(ValueError):
        S.scan(spark, str(tmp_path))


def test_run(spark, tmp_path):
    def parse(data: bytes, source):
        if data.startswith(b"broken") or not data:
            raise ValueError("not a document")
        return data.decode(), 1

    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    body = "SERVICES AGREEMENT\nThis agreement is made between Acme Holdings LLC and Ardent Advisory Ltd.\nDated: 12 January 2024\n" + "The adviser shall deliver the services described in the schedule to this agreement. " * 5
    (src / "a.pdf").write_text(body)
    (src / "sub" / "a.pdf").write_text(body)
    (src / "b.PDF").write_text(body + " One further clause.")
    (src / "c.pdf").write_text("broken")
    (src / "d.pdf").write_text("Hi")
    (src / "f.pdf").write_text("")
    (src / "g.pdf").write_text("")
    (src / "e.pdf").write_text("TAX INVOICE\nNo 7\n" + "Goods and freight. " * 10)
    cfg = C.Config(source=str(src), output=str(out))
    seen = []
    steps = [("native_fitz", parse), ("pdfplumber", parse)]
    got = run(spark, cfg, steps, log=seen.append)
    assert {k: got[k] for k in ("total", "retained", "removed", "excluded_do_not_retain", "failed_extraction", "scanned")} == {"total": 8, "retained": 4, "removed": 3, "excluded_do_not_retain": 1, "failed_extraction": 3, "scanned": 4}
    assert (out / "Consolidated" / "a.pdf").exists() and (out / "01_classified" / "_DO_NOT_RETAIN" / "Invoice" / "e.pdf").exists()
    with zipfile.ZipFile(got["tracker"]) as z:
        for n in z.namelist():
            parseString(z.read(n))
        assert b"Contracts" in z.read("xl/worksheets/sheet1.xml")
    # a second run reads nothing again and says the same
    (out / "Consolidated" / "stale.pdf").write_text("old")
    again = run(spark, cfg, steps, log=seen.append)
    assert {k: again[k] for k in ("total", "retained", "removed")} == {k: got[k] for k in ("total", "retained", "removed")}
    assert spark.read.parquet(f"{out}/state").count() == 8
    # the folders are built anew, and a damaged state is an error
    assert not (out / "Consolidated" / "stale.pdf").exists() and (out / "Consolidated" / "a.pdf").exists()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no table")
    with pytest.raises(Exception):
        ingest(spark, cfg, steps, str(tmp_path / "bad")).count()


def test_settings_reach_the_parsers(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("p1|p2|p3|p4")

    def ocr(data: bytes, source):
        pages = data.decode().split("|")[: source.settings.ocr_max_pages]
        return f"{source.settings.ocr_lang} {source.settings.ocr_dpi} {source.path[-5:]} " + " ".join(pages), 4

    for most, want in ((2, "deu 200 a.pdf p1 p2"), (None, "deu 200 a.pdf p1 p2 p3 p4")):
        cfg = C.Ingest(ocr_max_pages=most, ocr_dpi=200, ocr_lang="deu")
        got = S.extract(S.scan(spark, str(tmp_path)), [("ocr", ocr)], cfg).first()
        assert (got["text"], got["extraction_method"], got["is_scanned"]) == (want, "ocr", True)
    off = S.extract(S.scan(spark, str(tmp_path)), [("ocr", ocr)], C.Ingest(enable_ocr=False)).first()
    assert (off["text"], off["extraction_method"]) == ("", "failed")


def test_files_that_cannot_be_read_or_copied(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("a", "b", "c", "d e"):
        (src / f"{n}.pdf").write_text(n * 200)
    files = S.scan(spark, str(src))
    (src / "b.pdf").unlink()
    listed = S.listing(files)
    assert listed.count() == 4 and listed.where("length is null").count() == 1
    read = S.extract(files, [("native_fitz", lambda data, source: (data.decode(), 1))])
    lost = S.unreadable(listed.join(read, "path", "left_anti")).collect()
    assert [(r["file_name"], r["extraction_method"], r["error"]) for r in lost] == [("b.pdf", "failed", "unreadable")] and lost[0]["file_sha256"].startswith("__unreadable__:")
    rows = listed.withColumns({"target_folder": F.concat(F.lit("x/"), F.right("path", F.lit(5))), "consolidated_path": F.lit("(not copied — duplicate)")})
    got = {r["path"][-5:]: r["target_folder"] for r in cut(copy_files(rows, str(tmp_path / "out")), "c").collect()}
    assert got["a.pdf"].endswith("/out/x/a.pdf") and (tmp_path / "out" / "x" / "c.pdf").exists() and got["b.pdf"].startswith("(copy failed: ")


def test_backup_after_a_failure(spark, tmp_path, monkeypatch):
    import corpusloom.plans.pipeline as pl

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("TASK ORDER\n" + "goods " * 40)
    monkeypatch.setattr(pl, "copy_files", lambda *a: 1 / 0)
    said = []
    with pytest.raises(ZeroDivisionError):
        run(spark, C.Config(source=str(tmp_path / "in"), output=str(tmp_path / "out")), [("native_fitz", lambda data, source: (data.decode(), 1))], log=said.append)
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "EMERGENCY_BACKUP.csv")).first()["file_name"] == "a.pdf"


def test_state_as_lines(spark, tmp_path):
    state = str(tmp_path / "s.jsonl")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("x" * 200)
    cfg = C.Config(source=str(tmp_path / "in"), output=str(tmp_path / "out"))
    reads = spark.sparkContext.accumulator(0)

    def parse(data, source):
        reads.add(1)
        return data.decode(), 1

    for n in (1, 2):
        assert [r["text"] for r in ingest(spark, cfg, [("native_fitz", parse)], state).collect()] == ["x" * 200]
    assert reads.value == 1
    (tmp_path / "s.jsonl" / "more.json").write_text("{broken\n")
    assert ingest(spark, cfg, [("native_fitz", parse)], state).count() == 1


def test_ladder(spark):
    long, longer = "x" * 200, "y" * 300
    rows = [(long, longer, longer), ("short", long, longer), ("short", "", longer), ("short", "s", None), (None, None, None)]
    df = spark.createDataFrame(rows, "n string, s string, o string")
    got = [r["r"] for r in df.select(S.ladder(F.col("n"), F.col("s"), F.col("o")).alias("r")).collect()]
    assert [(r["extraction_method"], r["is_scanned"]) for r in got] == [("native_fitz", False), ("pdfplumber", False), ("ocr", True), ("native_fitz", True), ("native_fitz", True)]


def test_state(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("b", 2, 2)], "path string, v int, run_at int")
    assert sorted(tuple(r) for r in S.latest(old).collect()) == [("a", 1, 1), ("b", 2, 2)]
    files = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "path string, v int")
    cur = S.latest(old)
    assert [r["path"] for r in S.unchanged(files, cur, ("path", "v")).collect()] == ["a"]
    assert sorted(r["path"] for r in S.changed(files, cur, ("path", "v")).collect()) == ["b", "c"]


def test_numbered(spark):
    paths = ["/x/a-b/1", "/x/a/b", "/x/a/a", "/x/b"]
    got = {r["path"]: r["idx"] for r in S.numbered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths, key=lambda p: p.split("/")))}


ROW = {"idx": 1, "file_name": "a\x01.pdf", "doc_type": "PO", "needs_review": True, "status": "retained", "is_duplicate": False, "duplicate_of": "", "entity_name": "A & <B>", "contract_date": None, "page_count": 2, "is_scanned": False}


def test_sinks(spark, tmp_path):
    schema = "idx int, file_name string, doc_type string, needs_review boolean, status string, is_duplicate boolean, duplicate_of string, entity_name string, contract_date string, page_count int, is_scanned boolean"
    df = spark.createDataFrame([tuple(ROW[c] for c in TRACKER)], schema)
    path = write_tracker(df, [("total", 1)], str(tmp_path / "t.xlsx"))
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        parseString(sheet)
        assert "A &amp; &lt;B&gt;" in sheet and "\x01" not in sheet
    assert write_xlsx([], [], str(tmp_path / "e.xlsx")).endswith("e.xlsx")
    widths = {r["column"]: r["width"] for r in column_widths(df).collect()}
    assert widths["needs_review"] == 14 and widths["idx"] == 10
    csv = write_csv(df.withColumn("terms", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(csv).first()["terms"] == "x, y"
    s = run_summary(df.withColumn("extraction_method", F.lit("ocr"))).first()
    assert (s["total"], s["retained"], s["needs_review"], s["ocr_read"]) == (1, 1, 1, 1)


def test_stream(spark, tmp_path):
    schema = "idx int, file_name string, text string, size_bytes long, error string, run_at timestamp"
    src, out = tmp_path / "s", tmp_path / "o"
    rows = [(1, "po.pdf", "PURCHASE ORDER\na\nb", 10, None, datetime(2024, 1, 1)), (2, "m.pdf", "memo", 10, None, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = documents(spark, str(src), schema, per_trigger=1)
    enrich_to(first_deliveries(stream, "idx", "run_at"), str(out), str(tmp_path / "cp")).awaitTermination()
    got = {r["idx"]: r["doc_type"] for r in spark.read.parquet(f"{out}/batch=*").collect()}
    assert got[1] == "PO" and len(got) == 2
    assert arrivals(stream, "run_at", "1 hour", "1 day").isStreaming


def test_shuffle_files_go_when_a_table_is_cut(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllFiles().mkString("\n")))
    held = files()
    out = cut(spark.range(1000).repartition(4, "id").groupBy("id").count(), "c")
    for _ in range(50):  # they are removed at once, but not waited for
        if not (left := files() - held):
            break
        time.sleep(0.2)
    assert not left and out.count() == 1000 and spark.conf.get(name, None) == before
