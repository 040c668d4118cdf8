"""Writers, reports and round trips, and every registered query against its SQL at the smallest scale."""

import csv
import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.plans import catalogue
from concordia.sources import files, report_files, writers

SF = "/root/testdata/sf0.001"
AUDITS = [("A & co", "FAIL", 7), ("B", "PASS", 0), ("C", "PASS_WITH_WARNINGS", 2), ("D", "NOT_IN_DOC", 9)]


@pytest.fixture(scope="module")
def audits(spark):
    return spark.createDataFrame(AUDITS, "extractor string, status string, n_missing long")


def test_docx():
    assert files.docx_blocks(writers.docx_bytes([" a <b>  & c", "", "d"])) == [("a <b> & c", ""), ("d", "")]


def test_xlsx_update_keeps_the_rest():
    book = writers.xlsx_bytes([["a", "b"], ["c", "<d>"]])
    new = writers.xlsx_update(book, [(2, 1, "new & old"), (2, 3, "far"), (4, 0, "row")])
    assert files.xlsx_rows(new) == [["a", "b"], ["c", "new & old", "", "far"], ["row"]]
    assert files.xlsx_rows(writers.xlsx_update(book, [])) == files.xlsx_rows(book)


def test_one_step_in_python_for_each_stage(spark):
    """Three in a stage are three workers for each core; and no book's changes pass through the driver."""
    plan = catalogue.queries()["q44_xlsx_roundtrip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert re.findall("MapInArrow|Exchange", plan)[:6] == ["MapInArrow", "Exchange"] * 3


def test_book_with_gaps(spark, tmp_path):
    """Keys that are missing from a book leave no rows; a name and a type stay with their key."""
    keys = [7, 3, 98, 205, 201]
    spark.createDataFrame([(k, f"name {k}", f"type {k}") for k in keys], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.queries()["q44_xlsx_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k // 100, n, k, f"name {k}", f"type {k}") for n, k in [(1, 3), (2, 7), (3, 98), (1, 201), (2, 205)]]


@pytest.mark.parametrize(("at", "name"), [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_column_name(at, name):
    assert writers.column_name(at) == name


def test_reports(spark, audits, tmp_path):
    writers.write_json(audits, f"{tmp_path}/report.json")
    assert sorted(x["extractor"] for x in json.loads((tmp_path / "report.json").read_text())) == ["A & co", "B", "C", "D"]
    writers.write_json(audits.where("false"), f"{tmp_path}/report.json")
    assert json.loads((tmp_path / "report.json").read_text()) == []
    lines = writers.markdown(audits)
    assert lines[-2:] == ["| 1 | A & co | FAIL | 7 |", "| 2 | C | PASS_WITH_WARNINGS | 2 |"]
    assert "- FAIL: **1** | PASS_WITH_WARNINGS: **1** | PASS: **1**" in lines


def test_dashboard(spark, audits, tmp_path):
    more = audits.unionByName(spark.createDataFrame([("e", "FAIL", 9), ("f <x>", "NOT_IN_DOC", 0)], audits.schema))
    rows = spark.createDataFrame([("A & co", "ds <2>", 1, "<tr>x</tr>"), ("A & co", "ds <2>", 0, "<tr>w</tr>"), ("A & co", None, 5, "<tr>n</tr>"), ("B", "d", 0, "<tr>pass</tr>")], "extractor string, dataset string, ord int, row string")
    rejected = spark.createDataFrame([("A & co", "old.xdmz", ["TEST", "BKP"]), ("A & co", "new.xdmz", [])], "extractor string, file_name string, reasons array<string>")
    writers.write_dashboard(more, rows, f"{tmp_path}/page.html", rejected=rejected)
    page = (tmp_path / "page.html").read_text().splitlines()
    at = page.index
    assert at("<li>D</li>") < at("<li>f &lt;x&gt;</li>") < at("<tr>n</tr>") < at("<tr><th colspan='5'>ds &lt;2&gt;</th></tr>") < at("<tr>w</tr>") < at("<tr>x</tr>") < at("<tr><td>new.xdmz</td><td>lower_score</td></tr>") < at("<tr><td>old.xdmz</td><td>TEST,BKP</td></tr>")
    cards = [x for x in page if "class='card'" in x]
    assert [c.partition("<summary>")[2].partition("<")[0] for c in cards] == ["e FAIL", "A &amp; co FAIL", "C PASS_WITH_WARNINGS"] and page.count("<tr><td colspan='5'>Nenhum</td></tr>") == 2
    assert "<tr>pass</tr>" not in page and any("data-status" in x or "dataset.status" in x for x in page)
    writers.write_dashboard(more, rows, f"{tmp_path}/page.html", include_pass=True)
    assert "B PASS" in (tmp_path / "page.html").read_text().splitlines()[-3] + (tmp_path / "page.html").read_text()
    assert sorted(x.name for x in tmp_path.iterdir()) == ["page.html"]


def test_csv_files(spark, audits, tmp_path):
    missing = spark.createDataFrame([("A & co", 2, "d", "T2", 'a "b", c', None, "x\ny"), ("A & co", 1, "d", "T1", "é", "", "t"), ("D", 1, "d", "T", "", "", "")], "extractor string, ord int, dataset string, xml_tag_name string, column_name string, column_characteristic string, associated_table_to_each_column string")
    sources = spark.createDataFrame([("B", 1, "d", "T", "AP_INVOICES", "", None, None, None, None), ("B", 2, "d", "U", "SELECT", "C", "DIRECT", "HIGH", "why", "a,b")], "extractor string, ord int, dataset string, xml_tag_name string, source_table string, source_column string, source_mode string, source_confidence string, source_validation_reason string, source_sql_snippet string")
    (tmp_path / "by_extractor/B_table_diagnostics.csv").mkdir(parents=True)  # a name that cannot be replaced
    writers.write_csvs(audits, missing, sources, str(tmp_path))
    raw = (tmp_path / "by_extractor/A_co.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfdataset,")
    with (tmp_path / "by_extractor/A_co.csv").open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [writers.MISSING_COLUMNS, ["d", "T1", "é", "", "t"], ["d", "T2", 'a "b", c', "", "x\ny"]]
    with (tmp_path / "by_extractor/B_table_diagnostics_new.csv").open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f))[1:] == [["d", "T", "AP_INVOICES", "UNKNOWN_SOURCE_COLUMN", "UNKNOWN", "LOW", "true", "", ""], ["d", "U", "SELECT", "C", "DIRECT", "HIGH", "false", "why", "a,b"]]
    assert sorted(x.name for x in (tmp_path / "by_extractor").iterdir()) == ["A_co.csv", "B_table_diagnostics.csv", "B_table_diagnostics_new.csv"]
    rest = spark.createDataFrame([], ", ".join(f"{c} string" for c in ["ord", *writers.REMAINING_COLUMNS]))
    writers.write_remaining(rest, f"{tmp_path}/rest.csv")
    assert (tmp_path / "rest.csv").read_bytes() == (",".join(writers.REMAINING_COLUMNS) + "\r\n").encode()


def test_large_file_over_many_tasks(spark, tmp_path):
    lines = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "small.txt").otherwise("large.txt").alias("file"), "id", F.col("id").cast("string").alias("line"))
    report_files.write_files(lines.repartition(7), str(tmp_path), [F.col("id")], "<", ",", ">")
    assert (tmp_path / "large.txt").read_text() == "<" + ",".join(str(i) for i in range(20_000) if i % 3) + ">"
    assert (tmp_path / "small.txt").read_text() == "<" + ",".join(str(i) for i in range(20_000) if i % 3 == 0) + ">"


def test_lost_task_and_abort(tmp_path):
    """A task that is lost after it wrote, and its second attempt; then a job that is given up."""
    writer = report_files.ReportWriter({"path": str(tmp_path), "joiner": ",", "always": "none.txt"})
    writer.write(iter([("a.txt", "1"), ("a.txt", "2")]))  # its message never arrives
    again = writer.write(iter([("a.txt", "1"), ("a.txt", "2"), ("b.txt", None)]))
    rest = report_files.Pieces(1, writer.write(iter([("b.txt", "3")])).written)
    writer.commit([rest, None, again])
    assert {x.name: x.read_text() for x in tmp_path.iterdir()} == {"a.txt": "1,2", "b.txt": ",3", "none.txt": ""}
    other = report_files.ReportWriter({"path": str(tmp_path)})
    done = other.write(iter([("a.txt", "new")]))
    assert len(list(tmp_path.iterdir())) == 4
    other.abort([done, None])
    assert {x.name: x.read_text() for x in tmp_path.iterdir()} == {"a.txt": "1,2", "b.txt": ",3", "none.txt": ""}


def test_aborted_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old")
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="lost"):
        report_files.write_files(spark.range(1000).select(F.lit("a.txt").alias("file"), "id", bad.alias("line")), str(tmp_path), [F.col("id")])
    assert [(x.name, x.read_text()) for x in tmp_path.iterdir()] == [("a.txt", "old")]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for at in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {at.stem} AS FROM '{at}'")
    ours, theirs = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    mine = sorted([plain(r[c]) for c in columns] for r in ours.collect())
    assert mine == sorted([plain(x) for x in row] for row in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
