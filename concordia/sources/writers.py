"""Writers of DOCX, XLSX and package bytes, and of report files.

Office files and packages are made in Arrow batches as (path, content), the shape that the readers take, so a file is
bounded by the rows that share its path. Reports are written by tasks (report_files); only counts and the top 10, whose
size is fixed, are made on the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import audit
from concordia.sources import report_files

WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SHEET = "xl/worksheets/sheet1.xml"


def _zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def column_name(at: int) -> str:
    """Letters of a column from 0: A, B, .., Z, AA."""
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def docx_bytes(blocks: Iterable[str]) -> bytes:
    """A document with one paragraph per block."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(b)}</w:t></w:r></w:p>' for b in blocks)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{WORD_NS}"><w:body>{body}</w:body></w:document>'})


def xlsx_bytes(rows: Iterable[Iterable[str]]) -> bytes:
    """A workbook whose first sheet holds the rows as inline strings."""
    lines = []
    for n, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for i, v in enumerate(row))
        lines.append(f'<row r="{n}">{cells}</row>')
    return _zipped({SHEET: f'<worksheet xmlns="{SHEET_NS}"><sheetData>{"".join(lines)}</sheetData></worksheet>'})


def package_bytes(name: str, sql: str, fields: Iterable[tuple[str, str, str]]) -> bytes:
    """A model package with one dataset Q_name, its group G_name and the sample values of its (field, type, sample)."""
    elements, samples = [], ElementTree.Element("sample")
    group = ElementTree.SubElement(samples, f"G_{name}")
    for field, declared, sample in fields:
        elements.append(f"<element name={quoteattr(field)} dataType={quoteattr(declared)}/>")
        ElementTree.SubElement(group, field).text = sample
    model = f"<dataModel><dataSet name={quoteattr('Q_' + name)}><sql>{escape(sql)}</sql></dataSet><group name={quoteattr('G_' + name)} source={quoteattr('Q_' + name)}>{''.join(elements)}</group></dataModel>"
    return _zipped({f"{name}.xdm": model, "sample.xml": ElementTree.tostring(samples)})


def xlsx_update(content: bytes, changes: Iterable[tuple[int, int, str]], at_sheet: str = SHEET) -> bytes:
    """content with cells of a sheet, the first if none is named, set to inline text: changes (row from 1, column from 0, text).

    A missing row or cell is appended; every other member of the container stays as it was.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        members = {x.filename: z.read(x) for x in z.infolist()}
    ElementTree.register_namespace("", SHEET_NS)
    sheet = ElementTree.fromstring(members[at_sheet])
    ns = sheet.tag.partition("}")[0] + "}" if sheet.tag.startswith("{") else ""
    data = sheet.find(f"{ns}sheetData")
    if data is None:
        data = ElementTree.SubElement(sheet, f"{ns}sheetData")
    rows = {int(r.get("r")): r for r in data.findall(f"{ns}row") if r.get("r")}
    for row_no, at, value in changes:
        row = rows.get(row_no)
        if row is None:
            row = rows[row_no] = ElementTree.SubElement(data, f"{ns}row", r=str(row_no))
        name = f"{column_name(at)}{row_no}"
        cell = next((c for c in row if c.get("r") == name), None)
        if cell is None:
            cell = ElementTree.SubElement(row, f"{ns}c", r=name)
        for child in list(cell):
            cell.remove(child)
        cell.set("t", "inlineStr")
        ElementTree.SubElement(ElementTree.SubElement(cell, f"{ns}is"), f"{ns}t").text = value
    members[at_sheet] = ElementTree.tostring(sheet)
    return _zipped(members)


def encode(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """(path, content) from rows whose first column is the path and whose others are the arguments of make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, *given = (c[i].as_py() for c in b.columns)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "content": pa.array([make(*given)], pa.binary())})

    return rows.mapInArrow(run, "path string, content binary")


def update_xlsx(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, content) with changes (path, row_no, col_no, value) written into them; others pass through.

    The join merges: by a size guessed from a small file, the driver would broadcast the changes, and encoding, update and reading become one stage.
    """
    by_file = changes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row_no", "col_no", "value"))).alias("changes"))
    joined = files.join(by_file.hint("merge"), "path", "left").select("path", "content", "changes")
    return encode(joined, lambda content, found: xlsx_update(content, [(c["row_no"], c["col_no"], c["value"]) for c in found]) if found else content)


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One UTF-8 file through Spark's file system, complete or absent: written beside path, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    try:
        for line in lines:
            stream.write(bytearray(f"{line}\n".encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


def write_json(audits: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """An array with one object per row, in the order of those columns; nulls are kept, nested rows too."""
    folder, name = _split(path)
    lines = audits.select(F.lit(name).alias("file"), *order, F.concat(F.lit("  "), F.to_json(F.struct(*audits.columns), {"ignoreNullFields": "false"})).alias("line"))
    report_files.write_files(lines, folder, [F.col(c) for c in order], "[\n", ",\n", "\n]\n", name)


def markdown(audits: DataFrame, title: str = "Relatório de Comparação", key: str = "extractor") -> list[str]:
    """Counts and the ten models with most missing fields. audits (key, status, n_missing)."""
    n = audit.summary(audits).first()
    # The labels of the report.
    out = [
        f"# {title}", "",
        f"- extractors no escopo da documentação: **{n['n_in_doc']}**", f"- extractors fora do escopo da documentação: **{n['n_not_in_doc']}**",
        f"- FAIL: **{n['n_fail']}** | PASS_WITH_WARNINGS: **{n['n_pass_with_warnings']}** | PASS: **{n['n_pass']}**", "",
        "## Principais prioridades de revisão", "| Prioridade | Extractor | Status | Campos ausentes |", "|---:|---|---|---:|",
    ]
    return out + [f"| {i} | {r[key]} | {r['status']} | {r['n_missing']} |" for i, r in enumerate(audit.top(audits, 10, key).collect(), 1)]


def table_row(tag: Column, description: Column, table: Column, url: Column, column: Column, kind: Column) -> Column:
    """An HTML row of a missing field; the table is a link where a URL is known."""
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    plain = lambda x: cell(text.escape_html(F.coalesce(x, F.lit(""))))
    return F.concat(F.lit("<tr>"), plain(tag), plain(description), cell(text.linked_cell(table, url)), plain(column), plain(kind), F.lit("</tr>"))


#: Own layout of the page: a search box and a status list hide the cards that do not fit.
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:2px 6px;text-align:left}.card{margin:1em 0}"
_SCRIPT = """<script>
const box = document.querySelector('#find'), list = document.querySelector('#status');
const show = () => { for (const c of document.querySelectorAll('.card'))
  c.hidden = (list.value && c.dataset.status !== list.value) || !c.textContent.toLowerCase().includes(box.value.trim().toLowerCase()); };
box.oninput = list.onchange = show;
</script>"""
# Labels of the page.
_NONE, _NO_WORK, _COLUMNS = "Nenhum", "Nenhuma ação necessária.", ["XML Tag Name", "Descrição da coluna", "Tabela associada a cada coluna", "Nome da coluna", "Característica da coluna"]


def dashboard_lines(audits: DataFrame, rows: DataFrame, rejected: DataFrame | None = None, include_pass: bool = False) -> DataFrame:
    """(part, rank, missing, name, dataset, ord, line): the page after its head.

    audits (extractor, status, n_missing); rows (extractor, dataset, ord, row) of missing fields; rejected (extractor, file_name, reasons).
    Models outside the document come first, by name in capitals; then cards with work, FAIL before others, most missing fields first;
    then, if asked for, those without. Lines of a card are rows of their own, so no card is held whole.
    """
    name = text.escape_html(F.col("extractor"))
    rank = F.when(F.col("status") == "FAIL", 0).otherwise(1)
    keys = lambda part, dataset, order: [F.lit(part).alias("part"), rank.alias("rank"), F.when(F.lit(part == 2), -F.col("n_missing")).otherwise(0).cast("long").alias("missing"), F.upper("extractor").alias("name"), F.col("extractor").alias("extractor"), dataset.alias("dataset"), order.cast("long").alias("ord")]
    first, none, last = F.lit(-1), F.lit(""), F.lit("9")
    outside = audits.where("status = 'NOT_IN_DOC'").select(*keys(0, none, first), F.concat(F.lit("<li>"), name, F.lit("</li>")).alias("line"))
    work = audits.where("status NOT IN ('NOT_IN_DOC', 'PASS')")
    head = F.concat(F.lit("<details class='card' data-status='"), F.col("status"), F.lit("' data-missing='"), F.col("n_missing").cast("string"), F.lit("'><summary>"), name, F.lit(" "), F.col("status"), F.lit("</summary><table><tr>" + "".join(f"<th>{c}</th>" for c in _COLUMNS) + "</tr>"))
    heads = work.select(*keys(2, none, first), head.alias("line"))
    found = work.join(rows.withColumn("dataset", F.coalesce("dataset", F.lit(""))), "extractor")
    fields = found.select(*keys(2, F.concat(F.lit("1"), F.col("dataset")), F.col("ord")), F.col("row").alias("line"))
    titles = found.select(*keys(2, F.concat(F.lit("1"), F.col("dataset")), first), F.concat(F.lit("<tr><th colspan='5'>"), text.escape_html(F.col("dataset")), F.lit("</th></tr>")).alias("line")).distinct()
    empty = work.join(rows.select("extractor").distinct(), "extractor", "left_anti").select(*keys(2, F.lit("1"), first), F.lit(f"<tr><td colspan='5'>{_NONE}</td></tr>").alias("line"))
    parts = [outside, heads, fields, titles, empty]
    middle = F.lit("</table><table><tr><th>Arquivo rejeitado</th><th>Motivo</th></tr>")
    parts.append(work.select(*keys(2, F.lit("2"), first), middle.alias("line")))
    if rejected is not None:
        reasons = F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).otherwise("lower_score")
        cells = F.concat(F.lit("<tr><td>"), text.escape_html(F.col("file_name")), F.lit("</td><td>"), text.escape_html(reasons), F.lit("</td></tr>"))
        parts.append(work.join(rejected, "extractor").select(*keys(2, F.concat(F.lit("3"), F.col("file_name")), F.lit(0)), cells.alias("line")))
    parts.append(work.select(*keys(2, last, F.lit(0)), F.lit("</table></details>").alias("line")))
    if include_pass:
        card = F.concat(F.lit("<div class='card' data-status='PASS' data-missing='0'>"), name, F.lit(f" PASS {_NO_WORK}</div>"))
        parts.append(audits.where("status = 'PASS'").select(*keys(3, none, first), card.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    options = "".join(f"<option value='{v}'>{v or 'Todos os status'}</option>" for v in ("", "FAIL", "PASS_WITH_WARNINGS", "PASS"))
    start = audits.sparkSession.createDataFrame([(1, f"</ul><input id='find'><select id='status'>{options}</select>")], "part int, line string")
    return out.unionByName(start, allowMissingColumns=True)


def write_dashboard(audits: DataFrame, rows: DataFrame, path: str, include_pass: bool = False, title: str = "Dashboard", rejected: DataFrame | None = None) -> None:
    """An HTML page: counts, top 10, models outside the document, a filter, then a card for each model; see dashboard_lines()."""
    n, top = audit.summary(audits).first(), audit.top(audits, 10, "extractor").collect()
    counts = "".join(f"<li>{k.removeprefix('n_').upper()}: {v}</li>" for k, v in n.asDict().items())
    best = "".join(f"<li>{escape(r['extractor'])}: {r['n_missing']}</li>" for r in top)
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1><ul>{counts}</ul><ol>{best}</ol><ul>\n"
    folder, name = _split(path)
    order = ["part", "rank", "missing", "name", "extractor", "dataset", "ord"]
    lines = dashboard_lines(audits, rows, rejected, include_pass)
    report_files.write_files(lines.withColumn("file", F.lit(name)), folder, [F.col(c) for c in order], head, "\n", f"\n{_SCRIPT}</body></html>\n")


#: Columns of the CSV files of missing fields, of their sources, and of rows that stay without a description.
MISSING_COLUMNS = ["dataset", "xml_tag_name", "column_name", "column_characteristic", "associated_table_to_each_column"]
SOURCE_COLUMNS = ["dataset", "xml_tag_name", "source_table", "source_column", "source_mode", "source_confidence", "is_valid_source_table", "source_validation_reason", "source_sql_snippet"]
REMAINING_COLUMNS = ["dataset", "xml_tag_name", "description", "associated_table", "column_name", "column_characteristic"]


def write_csvs(audits: DataFrame, missing: DataFrame, sources: DataFrame, path: str) -> None:
    """by_extractor/<safe name>.csv with a model's missing fields, if any, and <safe name>_table_diagnostics.csv with the sources of all.

    audits (extractor, status); missing (extractor, ord and MISSING_COLUMNS); sources (extractor, ord and SOURCE_COLUMNS). Models
    outside the document get neither. Models whose safe names are equal share a file, by name.
    """
    inside = audits.where("status <> 'NOT_IN_DOC'").select("extractor").distinct()
    safe = F.concat(F.lit("by_extractor/"), text.safe_name(F.col("extractor")))
    valid = F.when(text.is_table_name(F.col("source_table")), "true").otherwise("false")
    report_files.write_csv_files(missing.join(inside, "extractor", "left_semi"), path, F.concat(safe, F.lit(".csv")), MISSING_COLUMNS, ["extractor", "ord"])
    told = sources.join(inside, "extractor", "left_semi")
    defaults = {"source_table": "N/A", "source_column": "UNKNOWN_SOURCE_COLUMN", "source_mode": "UNKNOWN", "source_confidence": "LOW", "source_validation_reason": "", "source_sql_snippet": ""}
    told = told.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()}).withColumn("is_valid_source_table", valid)
    report_files.write_csv_files(told, path, F.concat(safe, F.lit("_table_diagnostics.csv")), SOURCE_COLUMNS, ["extractor", "ord"])


def write_remaining(rows: DataFrame, path: str) -> None:
    """One CSV file, without a byte order mark, of rows (ord and REMAINING_COLUMNS) that stay without a description; at least its header."""
    folder, name = _split(path)
    report_files.write_csv_files(rows, folder, F.lit(name), REMAINING_COLUMNS, ["ord"], bom=False, always=name)
