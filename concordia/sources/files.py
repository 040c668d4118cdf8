"""Readers of lookup files and of packages: text and CSV natively, ZIP containers from binaryFile in Arrow batches."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators.enrich import last_wins

ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string())}
#: What a file that is cut off, or is something else, raises while it is read.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, EOFError, zlib.error, NotImplementedError)
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def mapping_rows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(key, url, ord) from lines (ord, line) of KEY=VALUE; '#' lines and blank ones are skipped, the last of a key wins.

    Lines without '=' are skipped, or raise an error if strict (which also keeps blank values).
    """
    rows = lines.select("ord", F.btrim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", "=", 2)
    key = F.get(parts, F.lit(0))
    if strict:
        key = F.when(F.size(parts) < 2, F.raise_error(F.concat(F.lit("no '=' in line: "), F.col("line")))).otherwise(key)
    else:
        rows = rows.where("contains(line, '=')")
    rows = rows.select(F.upper(F.btrim(key)).alias("key"), F.btrim(F.get(parts, F.lit(1))).alias("url"), "ord")
    return last_wins(rows if strict else rows.where("key <> '' AND url <> ''"), ["key"], "ord")


def read_mapping(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return mapping_rows(lines, strict).select("key", "url")


def read_column_metadata(spark: SparkSession, path: str) -> DataFrame:
    """table_name, column_name (upper case), column_description, column_characteristic, doc_url; rows with a blank key are skipped."""
    rows = spark.read.csv(path, header=True)
    up = {c: F.upper(F.btrim(c)) for c in ("table_name", "column_name")}
    return rows.withColumns(up).where("coalesce(table_name, '') <> '' AND coalesce(column_name, '') <> ''")


def read_lineage_rules(spark: SparkSession, path: str) -> DataFrame:
    """source_table, source_column -> target_table, target_column; all four are needed, the last rule of a key wins."""
    wanted = ["source_table", "source_column", "target_table", "target_column"]
    rows = spark.read.csv(path, header=True)
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"lineage file lacks {', '.join(missing)}")
    rows = rows.select(*[F.upper(F.btrim(c)).alias(c) for c in wanted], F.monotonically_increasing_id().alias("ord"))
    full = rows.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in wanted))
    return last_wins(full, wanted[:2], "ord").drop("ord")


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """files (path, content) through a function of (path, bytes) that yields rows of the schema.

    A file that cannot be read gives no rows; broken() names it.
    """
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = list(decode(path, content.as_py()))
                except BROKEN:
                    continue
                if rows:
                    yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(arrow.names)}, arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def broken(files: DataFrame, decode: Callable[[bytes], object]) -> DataFrame:
    """(path, error) of files (path, content) that decode, such as docx_blocks, xlsx_rows or package_rows, cannot read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[str]] = {"path": [], "error": []}
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    decode(content.as_py())
                except BROKEN as error:
                    found["path"].append(path)
                    found["error"].append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_pydict(found, pa.schema([("path", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def _clean(text: str) -> str:
    return " ".join(text.split())


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{W}tab": " ", f"{W}br": "\n", f"{W}cr": "\n"}
    return _clean("".join((x.text or "") if x.tag == f"{W}t" else marks.get(x.tag, "") for x in p.iter()))


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(text, table text) of each non-empty body block in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out = []
    for child in body if body is not None else ():
        if child.tag == f"{W}p" and (text := _paragraph(child)):
            out.append((text, ""))
        elif child.tag == f"{W}tbl":
            rows = [" | ".join(filter(None, (_clean(" ".join(_paragraph(p) for p in c.iter(f"{W}p"))) for c in r.findall(f"{W}tc")))) for r in child.iter(f"{W}tr")]
            if text := "\n".join(filter(None, rows)):
                out.append((text, text))
    return out


def read_docx(files: DataFrame) -> DataFrame:
    """(path, page_no, block, table_text), page_no from 1."""
    return _decoded(files, lambda path, c: [(path, i, *b) for i, b in enumerate(docx_blocks(c), 1)], "path string, page_no int, block string, table_text string")


def sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, dict[int, str]]]]]:
    """(name, rows) of each sheet of a workbook, rows as (number from 1, cells by column from 0); an unreadable sheet has none."""
    local = lambda x: x.tag.rpartition("}")[2]
    inner = lambda x: "".join(t.text or "" for t in x.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [inner(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
            out: list[tuple[int, dict[int, str]]] = []
            try:
                found = [x for x in ElementTree.fromstring(z.read(name)).iter() if local(x) == "row"]
            except ElementTree.ParseError:
                found = []
            for row in found:
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for ch in (c.get("r") or "").rstrip("0123456789"):
                        at = at * 26 + ord(ch.upper()) - 64
                    value, kind = next((v.text or "" for v in c if local(v) == "v"), ""), c.get("t")
                    known = kind == "s" and value.strip().isdigit() and int(value) < len(shared)
                    cells[at - 1 if at else len(cells)] = inner(c) if kind == "inlineStr" else shared[int(value)] if known else "" if kind == "s" else value
                out.append((int(row.get("r")) if (row.get("r") or "").isdigit() else len(out) + 1, cells))
            yield name, out


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Cells of the first sheet, gaps filled with ''; rows without cells are skipped. A book without that sheet has no rows."""
    out = []
    for _, cells in next((rows for name, rows in sheets(content) if name == "xl/worksheets/sheet1.xml"), []):
        if cells:
            values = [cells.get(i, "") for i in range(max(cells) + 1)]
            filled = [v for v in values if v]
            # A whole CSV line in a single cell is taken apart.
            out.append(next(csv.reader([filled[0]])) if len(filled) == 1 and "," in filled[0] else values)
    return out


def read_xlsx(files: DataFrame) -> DataFrame:
    """(path, row_no, cells), row_no from 1."""
    return _decoded(files, lambda path, c: [(path, i, r) for i, r in enumerate(xlsx_rows(c), 1)], "path string, row_no int, cells array<string>")


def read_archive(files: DataFrame) -> DataFrame:
    """(path, ord, entry, file_name, modified, package): the .xdmz entries of bundles; a bare package is its own entry."""

    def entries(path: str, content: bytes):
        import datetime

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i, x in enumerate(z.infolist()):
                if x.filename.lower().endswith(".xdmz"):
                    yield path, i, x.filename, x.filename.rpartition("/")[2], datetime.datetime(*x.date_time, tzinfo=datetime.UTC), z.read(x)

    return _decoded(files, entries, "path string, ord int, entry string, file_name string, modified timestamp, package binary")


def package_rows(content: bytes) -> list[tuple[str, str, str, str | None, int, str | None, str | None, str | None]]:
    """(group, source, kind, sql, ord, field, declared type, sample) of a model package.

    Groups whose source is a known dataset count; those on Q_ datasets only, unless there are none.
    """
    local = lambda x: x.tag.rpartition("}")[2].lower()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        at = next((n for n in names if n.lower().endswith(".xdm")), None)
        if at is None:  # a package without a model has no datasets
            return []
        model = ElementTree.fromstring(z.read(at))
        sample_name = next((n for n in names if n.lower().endswith("sample.xml")), None)
        samples: dict[tuple[str, str], str] = {}
        try:
            for node in ElementTree.fromstring(z.read(sample_name)).iter() if sample_name else ():
                for leaf in node:
                    if not len(leaf) and (leaf.text or "").strip():
                        samples.setdefault((local(node).upper(), local(leaf).upper()), leaf.text.strip())
        except ElementTree.ParseError:
            samples = {}
    sql: dict[str, tuple[str, str]] = {}
    for d in model.iter():
        if local(d) in ("dataset", "sqldataset", "xmldataset") and d.get("name"):
            texts = [x.text for x in d.iter() if local(x) in ("sql", "query") and (x.text or "").strip()]
            sql[d.get("name").upper()] = (d.get("name"), texts[-1] if texts else sql.get(d.get("name").upper(), ("", ""))[1])
    groups = [g for g in model.iter() if local(g) == "group" and (g.get("source") or "").upper() in sql]
    strict = [g for g in groups if g.get("source").upper().startswith("Q_")]
    merged: dict[str, tuple[str, str, list[tuple[str, str]]]] = {}
    for g in strict or groups:
        name = g.get("name") or g.get("source")
        kept = merged.setdefault(name.upper(), (name, g.get("source"), []))
        for f in g:
            if local(f) in ("field", "column", "element") and (field := f.get("name") or f.get("columnName") or f.get("fieldName")):
                if field not in (x[0] for x in kept[2]):
                    kept[2].append((field, f.get("dataType") or f.get("type") or ""))
    out = []
    for name, source, fields in merged.values():
        keys = [k for base in (name, source) for k in (base.upper(), base.upper()[2:] if base[:2].upper() in ("G_", "Q_") else base.upper())]
        for i, (field, declared) in enumerate(fields):
            sample = next((samples[k, field.upper()] for k in keys if (k, field.upper()) in samples), None)
            out.append((name, source, "field", sql[source.upper()][1], i, field, declared, sample))
    return out


def read_packages(archive: DataFrame) -> DataFrame:
    """Fields of every package of an archive (entry, package)."""
    files = archive.select(F.col("entry").alias("path"), F.col("package").alias("content"))
    return _decoded(files, lambda path, c: [(path, *r) for r in package_rows(c)], "entry string, dataset string, source string, kind string, sql_text string, ord int, field string, declared string, sample string")
