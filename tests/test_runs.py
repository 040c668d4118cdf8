"""Whole runs over small packages, a document and pages."""

import csv
import json
import os
import zipfile

import pytest

from concordia import __main__ as cli
from concordia.operators import cache
from concordia.runs import compare
from concordia.sources import files, writers


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("inputs")
    sql = "select i.invoice_id, i.amount total, v.vendor_name from ap_invoices i, po_vendors v where v.id = i.id"
    main = writers.package_bytes("Invoices", sql, [("INVOICE_ID", "xsd:string", "7"), ("TOTAL", "xsd:decimal", "1.5"), ("VENDOR_NAME", "", "x"), ("GHOST", "", "")])
    with zipfile.ZipFile(at / "all.xdrz", "w") as z:
        for name, content in (("in/Invoices.xdmz", main), ("in/Invoices_v2.xdmz", main), ("in/Payments.xdmz", writers.package_bytes("Payments", "select p.x from ap_pay p", [("X", "", "")])), ("in/broken.xdmz", b"no")):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), content)
    (at / "doc.docx").write_bytes(writers.docx_bytes(["Contents", "Invoices", "The invoice id of an invoice: INVOICE_ID", "Other", "end"]))
    row = "<table><tr><td>{}</td><td>T</td><td>1</td><td>N</td><td>P</td><td>{}</td></tr></table>"
    head = "<table><tr><th>Name</th><th>Datatype</th><th>Comments</th></tr><tr><td>VENDOR_NAME</td><td>VARCHAR2</td><td>Name of the vendor</td></tr></table>"
    pages = [("http://d/po_vendors/oedmf", head), ("http://d/ap_invoices", row.format("AMOUNT", "Amount of the invoice"))]
    spark.createDataFrame(pages, "url string, html string").write.parquet(f"{at}/pages")
    spark.createDataFrame([("po_vendors", ["http://d/none", "http://d/po_vendors/oedmf"])], "table string, links array<string>").write.parquet(f"{at}/links")
    (at / "mapping.txt").write_text("# tables\nAP_INVOICES=http://d/ap_invoices\nPO_VENDORS=http://d/gone\nNO_ROWS=http://d/ap_invoices\n")
    return at


def options(at, out, **more):
    return compare.Options(f"{at}/all.xdrz", f"{at}/doc.docx", str(out), **{"pages": f"{at}/pages", "links": f"{at}/links", "scope_debug": True, **more})


def test_compare_then_again(spark, inputs, tmp_path):
    verdict, stages = compare.run(spark, options(inputs, tmp_path))
    assert stages.done == ["candidates", "blocks", "fields", "audits", "missing"]
    report = {r["extractor"]: r for r in json.loads((tmp_path / "comparison_report.json").read_text())}
    assert sorted(report) == ["Invoices", "Payments", "broken"] and verdict == "FAIL" and report["broken"]["field_count"] == 0
    assert (tmp_path / "broken_files.csv").read_text().splitlines() == ["path,error", "in/broken.xdmz,BadZipFile: File is not a zip file"]
    r = report["Invoices"]
    assert r["missing_fields_in_doc"] == ["TOTAL", "VENDOR_NAME", "GHOST"] and r["status"] == "FAIL" and r["field_count"] == 4 and report["Payments"]["status"] == "NOT_IN_DOC"
    assert [x["file_name"] for x in r["rejected_candidates"]] == ["Invoices_v2.xdmz"] and r["scope_debug"]["field_presence"]["INVOICE_ID"] == "present"
    assert {f["field"]: (f["source_table"], f["source_column"]) for f in r["datasets"][0]["fields"]} == {"INVOICE_ID": ("AP_INVOICES", "INVOICE_ID"), "TOTAL": ("AP_INVOICES", "AMOUNT"), "VENDOR_NAME": ("PO_VENDORS", "VENDOR_NAME"), "GHOST": ("AP_INVOICES", "GHOST")}
    page = (tmp_path / "comparison_dashboard.html").read_text()
    assert "Name of the vendor" in page and 'href="http://d/po_vendors/oedmf"' in page and "<li>Payments</li>" in page and "Invoices_v2.xdmz" in page
    assert json.loads((tmp_path / "comparison_scope_debug.json").read_text())[0]["missing_fields_sample"] == ["TOTAL", "VENDOR_NAME", "GHOST"]
    with (tmp_path / "by_extractor/Invoices.csv").open(encoding="utf-8-sig", newline="") as f:
        assert [x["xml_tag_name"] for x in csv.DictReader(f)] == ["TOTAL", "VENDOR_NAME", "GHOST"]
    assert "| 1 | Invoices | FAIL | 3 |" in (tmp_path / "comparison_report.md").read_text()
    assert cache.EnrichmentCache(spark, f"{tmp_path}/cache").load().count() == 4
    before = {x: (tmp_path / x).read_bytes() for x in ("comparison_report.json", "comparison_dashboard.html", "by_extractor/Invoices.csv")}
    os.remove(next(tmp_path.glob("_stages/audits-*")) / "_SUCCESS")  # a run that was killed there
    again, stages = compare.run(spark, options(inputs, tmp_path))
    assert again == verdict and stages.done == ["audits"]
    assert {x: (tmp_path / x).read_bytes() for x in before} == before
    assert cache.EnrichmentCache(spark, f"{tmp_path}/cache").snapshots() == [1]  # nothing was asked again


def test_requested_models_and_bad_options(spark, inputs, tmp_path):
    verdict, _ = compare.run(spark, options(inputs, tmp_path, extractor=" páy , ", pages="", links=""))
    assert verdict == "PASS" and [r["extractor"] for r in json.loads((tmp_path / "comparison_report.json").read_text())] == ["Payments"]
    with pytest.raises(ValueError, match="called like"):
        compare.run(spark, options(inputs, tmp_path, extractor="nothing"))
    with pytest.raises(ValueError, match="docx"):
        compare.run(spark, compare.Options("x.xdrz", "y.pdf", str(tmp_path)))


def test_command_line_compares_and_fills(spark, inputs, tmp_path):
    (tmp_path / "books").mkdir()
    head = ["Column description", "Associated table to each column", "Column Name"]
    (tmp_path / "books/b.xlsx").write_bytes(writers.xlsx_bytes([head, ["A preencher pela documentação funcional 1", "AP_INVOICES", "amount"]]))
    out = tmp_path / "out"
    said = cli.main(["pipeline", "--packages", f"{inputs}/all.xdrz", "--document", f"{inputs}/doc.docx", "--out", str(out), "--pages", f"{inputs}/pages", "--links", f"{inputs}/links", "--mapping", f"{inputs}/mapping.txt", "--books", f"{tmp_path}/books", "--include-pass"], spark)
    assert said == "FAIL rows=4 remaining=2 candidates=1 updated=1"
    assert files.xlsx_rows((tmp_path / "books/b.xlsx").read_bytes())[1][0] == "Amount of the invoice"
    with (out / "remaining.csv").open(newline="") as f:
        assert sorted(r["xml_tag_name"] for r in csv.DictReader(f)) == ["GHOST", "X"]
    with (out / "table_diagnostics.csv").open(newline="") as f:
        assert {r["table"]: (r["status"], r["pre_candidates"], r["updated"]) for r in csv.DictReader(f)} == {"AP_INVOICES": ("OK_PARTIAL", "2", "1"), "PO_VENDORS": ("SKIP_NO_CANDIDATES", "0", "0"), "NO_ROWS": ("SKIP_NO_CANDIDATES", "0", "0")}
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["compare", "--out", "x"])
