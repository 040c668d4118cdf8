"""Cache of answers, search and try, ladder of states, and what is written back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from concordia.operators import cache, enrich, ladder, search
from concordia.sources import files, write_back, writers

ANSWER = [("ap", "id", "old", "N", "", True, "http", 5), ("AP", "ID", "new", "N", "u", True, "http", 9), ("AP", "X", None, "N/A", "", False, "not_found", None)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_cache_of_two_runs(spark, tmp_path):
    store = cache.EnrichmentCache(spark, f"{tmp_path}/cache")
    keys = spark.createDataFrame([("ap", "id"), ("Ap", "x"), ("AP", "ID")], "table string, column string")
    assert store.load().count() == 0 and rows(cache.to_ask(keys, store.load())) == [("AP", "ID"), ("AP", "X")]
    store.flush(cache.merge(store.load(), spark.createDataFrame(ANSWER, cache.SCHEMA)))
    again = cache.EnrichmentCache(spark, f"{tmp_path}/cache").load()
    assert rows(again.select("table", "column", "description")) == [("AP", "ID", "new"), ("AP", "X", None)]
    assert cache.to_ask(keys, again).count() == 0
    late = spark.createDataFrame([("AP", "id", "late", "N", "", True, "http", 9), (None, None, "none", "", "", True, "http", 1)], cache.SCHEMA)
    for _ in range(3):
        store.flush(cache.merge(store.load(), late))
    assert store.snapshots() == [3, 4]
    assert rows(store.load().select("table", "column", "description")) == [("", "", "none"), ("AP", "ID", "late"), ("AP", "X", None)]


def test_corrupt_snapshot_is_empty(spark, tmp_path):
    store = cache.EnrichmentCache(spark, f"{tmp_path}/cache")
    store.flush(spark.createDataFrame(ANSWER[:1], cache.SCHEMA))
    (tmp_path / "cache/_writing-lost").mkdir()  # what a killed run leaves
    for part in (tmp_path / "cache/snapshot-1").glob("*.parquet"):
        part.write_bytes(b"PAR1 cut off")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert store.load().count() == 0
    store.flush(cache.merge(store.load(), spark.createDataFrame(ANSWER[1:2], cache.SCHEMA)))
    assert rows(store.load().select("description")) == [("new",)]


def test_search_and_try(spark):
    page = lambda c, d: f"<table><tr><th>Column</th><th>Datatype</th><th>Comments</th></tr><tr><td>{c}</td><td>NUMBER</td><td>{d}</td></tr></table>"
    read = spark.createDataFrame([("u1", page("A", "first")), ("u2", page("QQ", "")), ("docs/ap_all/oedmf", page("A", "best")), ("u9", page("ZZ", "last")), ("u0", None)], "url string, html string")
    asked = [
        (1, "AP_ALL", "A", ["u1", "docs/ap_all/oedmf"]), (2, "AP_ALL", "A", ["u0", "gone", "u1"]), (3, "T", "QQ", ["u1", "u2"]), (4, "T", "A", []), (5, None, "A", None),
        (6, "T", "ZZ", ["a", "b", "c", "d", "e", "f", "u9"]), (7, "T", "ZZ", ["a", "a", None, "", "b", "c", "d", "e", "u9"]),
    ]
    got = {r.key: r for r in search.search_and_try(spark.createDataFrame(asked, "key long, table_name string, column string, links array<string>"), read, "oedmf").collect()}
    told = {k: (r.description, r.characteristic, r.doc_url, r.matched, r.provider, r.tries) for k, r in got.items()}
    assert told[1] == ("best", "NUMBER", "docs/ap_all/oedmf", True, "http", 1)
    assert told[2] == ("first", "NUMBER", "u1", True, "http", 3)
    assert told[3] == (None, "NUMBER", "u2", False, "http", 2)
    assert told[4] == told[5] == (None, "N/A", "", False, "not_found", 0)
    assert told[6] == (None, "N/A", "", False, "not_found", 6) and told[7] == ("last", "NUMBER", "u9", True, "http", 6)


def test_every_state_of_the_ladder(spark):
    # table, url, local, before, fetched, parsed, met, updated, unresolved
    cases = {
        "OK_LOCAL_FULL": (None, True, 3, None, 0, 3, 3, []), "OK_LOCAL_PARTIAL": (None, True, 3, None, 0, 3, 1, ["b", "a", "b"]), "SKIP_NO_CANDIDATES": (None, False, 0, None, 0, 0, 0, None),
        "SKIP_NO_URL": ("", False, 2, None, 0, 0, 0, None), "ERROR_FETCH": ("http://h/search?q", False, 2, False, 0, 0, 0, None), "WARN_NO_CANDIDATES_IN_HTML": ("http://h", False, 2, True, 4, 0, 0, []),
        "WARN_NO_COLUMN_MATCH": ("http://h", False, 2, True, 4, 2, 0, ["a", "b"]), "OK_PARTIAL": ("http://h", False, 2, True, 4, 2, 1, ["a"]), "OK_FULL": ("http://h", False, 2, True, 4, 2, 2, []),
        "WARN_PARSE_EMPTY": ("http://h", False, 2, True, 0, 2, 0, ["a", "b"]), "OK_LINEAGE_FALLBACK": ("http://h", False, 2, True, 0, 2, 1, ["a"]),
    }
    frame = spark.createDataFrame([(k, k, *v) for k, v in cases.items()], "table string, real_table string, url string, local boolean, before long, fetched boolean, parsed long, met long, updated long, unresolved array<string>")
    got = {r.table: r for r in ladder.table_diagnostics(frame).collect()}
    assert {k: r.status for k, r in got.items()} == {k: k for k in cases} and len(set(ladder.TRANSITIONS.values()) - {"LOCAL", "ROWS", "URL", "PAGE", "COLUMNS", "BARE"}) == 11
    assert {k: r.url_type for k, r in got.items()} == {k: "local_xlsx" if "LOCAL" in k else "search" if k == "ERROR_FETCH" else "none" if k.startswith("SKIP") else "direct" for k in cases}
    assert (got["OK_LOCAL_PARTIAL"].unresolved_sample, got["OK_LOCAL_PARTIAL"].unresolved_after, got["ERROR_FETCH"].unresolved_after, got["OK_FULL"].unresolved_after) == ("a, b", 3, 2, 0)
    with pytest.raises(ValueError, match="alias"):
        ladder.work_tables(frame.select(F.col("table").alias("key"), "url"), aliases=["x"])


def book(*sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, cells in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", zipfile.ZipFile(io.BytesIO(writers.xlsx_bytes(cells))).read(writers.SHEET))
        z.writestr("xl/other.bin", b"kept")
    return out.getvalue()


HEAD = ["XML Tag Name", " Column  description", "Associated table to each column", "Column Name"]
TODO = "A preencher pela documentação funcional 2"


def test_workbooks_are_filled_and_written_back(spark, tmp_path):
    one = book([["no", "headers"], [TODO, "AP"]], [HEAD, ["T", TODO, "ap", "id"], ["U", "told", "AP", "ID"], ["V", TODO, "N/A", "ID"], ["W", TODO, "AP", "GONE"]], [HEAD, ["X", TODO.upper(), "AP", "ID"]])
    at = {"one.xlsx": one, "two.xlsx": book([HEAD, ["T", "told", "AP", "ID"]]), "broken.xlsx": one[:200]}
    for name, content in at.items():
        (tmp_path / name).write_bytes(content)
    books = spark.createDataFrame([(f"{tmp_path}/{n}", c) for n, c in at.items()], "path string, content binary")
    changed, counts = write_back.fill_workbooks(books, spark.createDataFrame([("AP", "ID", "invoice")], "table string, column string, description string"))
    assert [(r.path, r.candidates, r.updated, r.unresolved) for r in counts.collect()] == [(f"{tmp_path}/one.xlsx", 3, 2, ["AP.GONE"])]
    write_back.write_binary(changed)
    got = dict(files.sheets((tmp_path / "one.xlsx").read_bytes()))
    assert [r[1].get(1) for r in got["xl/worksheets/sheet2.xml"][1:]] == ["invoice", "told", TODO, TODO] and got["xl/worksheets/sheet3.xml"][1][1][1] == "invoice" and got["xl/worksheets/sheet1.xml"][1][1][0] == TODO
    assert zipfile.ZipFile(tmp_path / "one.xlsx").read("xl/other.bin") == b"kept"
    assert {n: (tmp_path / n).read_bytes() for n in at if n != "one.xlsx"} == {n: c for n, c in at.items() if n != "one.xlsx"}
    assert sorted(x.name for x in tmp_path.iterdir()) == sorted(at)
    assert [(r.path[-11:], r.error[:10]) for r in files.broken(books, files.xlsx_rows).collect()] == [("broken.xlsx", "BadZipFile")]


def test_lost_task_of_a_write_back(tmp_path):
    target = tmp_path / "a.bin"
    target.write_bytes(b"old")
    writer = write_back.BinaryWriter()
    writer.write(iter([(str(target), b"new")]))  # its message never arrives
    assert target.read_bytes() == b"old"
    writer.commit([None, writer.write(iter([(str(target), b"new")]))])
    assert {x.name: x.read_bytes() for x in tmp_path.iterdir()} == {"a.bin": b"new"}
    other = write_back.BinaryWriter()
    other.abort([other.write(iter([(f"file://{target}", b"newer")]))])
    assert {x.name: x.read_bytes() for x in tmp_path.iterdir()} == {"a.bin": b"new"}


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{writers.WORD_NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_tables_in_their_place():
    p = lambda *runs: "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"
    cell = lambda *ps: f"<w:tc>{''.join(ps)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell(p('<w:t>Field</w:t>'))}{cell(p('<w:t>Ledger</w:t>'), p('<w:t>code</w:t>'))}{cell(p())}</w:tr><w:tr>{cell(p())}</w:tr></w:tbl>"
    content = docx(p("<w:t>before</w:t><w:tab/>", "<w:t>it</w:t>") + table + p() + p("<w:t>after</w:t>"))
    assert files.docx_blocks(content) == [("before it", ""), ("Field | Ledger code", "Field | Ledger code"), ("after", "")]


def test_xlsx_shared_strings_and_a_csv_line_in_one_cell():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{writers.SHEET_NS}"><si><t>TAG_1</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr(writers.SHEET, f'<worksheet xmlns="{writers.SHEET_NS}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>7</v></c><c r="E1"><v>4.5</v></c></row><row r="2"/><row r="3"><c r="B3" t="inlineStr"><is><t>a,"b, c",,d</t></is></c></row></sheetData></worksheet>')
    assert files.xlsx_rows(out.getvalue()) == [["TAG_1", "", "two runs", "", "4.5"], ["a", "b, c", "", "d"]]


def test_archives_and_broken_members(spark):
    good = writers.package_bytes("main", "select 1 from t", [("F", "xsd:string", "v")])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in/Good_v2.xdmz", good)
        z.writestr("in/empty.XDMZ", book([["x"]]))  # a package without a model
        z.writestr("in/bad.xdmz", b"no zip")
        z.writestr("readme.txt", b"x")
    bundles = spark.createDataFrame([("all.xdrz", out.getvalue()), ("cut.xdrz", out.getvalue()[:50])], "path string, content binary")
    entries = files.read_archive(bundles)
    assert sorted((r.path, r.ord, r.file_name) for r in entries.collect()) == [("all.xdrz", 0, "Good_v2.xdmz"), ("all.xdrz", 1, "empty.XDMZ"), ("all.xdrz", 2, "bad.xdmz")]
    assert [(r.entry, r.field, r.sample) for r in files.read_packages(entries).collect()] == [("in/Good_v2.xdmz", "F", "v")]
    packages = entries.select(F.col("entry").alias("path"), F.col("package").alias("content"))
    assert [r.path for r in files.broken(packages, files.package_rows).collect()] == ["in/bad.xdmz"]
    assert [r.path for r in files.broken(bundles, lambda c: zipfile.ZipFile(io.BytesIO(c)).infolist()).collect()] == ["cut.xdrz"]
    documents = spark.createDataFrame([("a.docx", docx("")), ("b.docx", out.getvalue())], "path string, content binary")
    assert files.read_docx(documents).count() == 0 and [r.path for r in files.broken(documents, files.docx_blocks).collect()] == ["b.docx"]


def test_search_takes_each_page_apart_once(spark):
    """Hundreds of keys try one page: no key's try parses it again, no side is broadcast by its guessed size, and there are no rounds."""
    read = spark.createDataFrame([("u", "<table><tr><th>Column</th><th>Comments</th></tr><tr><td>A</td><td>told</td></tr></table>")], "url string, html string")
    asked = spark.range(300).selectExpr("id AS key", "'T' AS table_name", "if(id % 3 = 0, 'A', 'QQ') AS column", "array('gone', 'u', concat('x', id)) AS links")
    got = search.search_and_try(asked, read, "oedmf")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("ArrowEvalPython") == 1, plan
    assert {(r.key % 3 == 0, r.description, r.tries, r.provider) for r in got.collect()} == {(True, "told", 2, "http"), (False, None, 3, "not_found")} and got.count() == 300


def test_recursive_lookup_broadcasts_nothing(spark):
    """Sizes guessed from small files of pages had the driver collect whole tables."""
    edges = spark.range(100).selectExpr("id AS key", "0 AS ref_ord", "id div 2 AS ref")
    got = enrich.describe_recursively(spark.range(100).selectExpr("id AS key"), spark.createDataFrame([(3, "three")], "key long, description string"), edges)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {r.key for r in got.collect() if r.description} == {3, 6, 7, *range(12, 16), *range(24, 32), *range(48, 64)}
