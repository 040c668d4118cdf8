"""Changed files written back to their paths by tasks: beside the target first, moved over it when the whole job has succeeded."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from concordia.functions import text
from concordia.sources import files, writers

FORMAT = "concordia_binary"
#: Headers of a sheet that is filled, the beginning of a cell to fill, and tables that are none.
HEADERS = ("COLUMN DESCRIPTION", "ASSOCIATED TABLE TO EACH COLUMN", "COLUMN NAME")
PLACEHOLDER, NO_TABLES = "A PREENCHER PELA DOCUMENTAÇÃO FUNCIONAL", ("N/A", "MULTI_SOURCE")


@dataclass
class Parts(WriterCommitMessage):
    """(part, target) of what a task wrote."""

    written: list[tuple[str, str]]


class BinaryWriter(DataSourceWriter):
    """Rows (path, content). A part is named after its target and the job, so what lost attempts left is found and removed."""

    def __init__(self) -> None:
        self.job = uuid.uuid4().hex

    @staticmethod
    def place(path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Parts:
        done = Parts([])
        for row in iterator:
            fs, target = self.place(row[0])
            part = f"{target}.part-{self.job}-{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(row[1])
            done.written.append((f"{row[0]}{part[len(target):]}", row[0]))
        return done

    def commit(self, messages: list[Parts | None]) -> None:
        told = [w for m in messages if m is not None for w in m.written]
        for part, target in told:
            fs, at = self.place(part)
            fs.move(at, self.place(target)[1])
        self.sweep(told)

    def abort(self, messages: list[Parts | None]) -> None:
        self.sweep([w for m in messages if m is not None for w in m.written])

    def sweep(self, told: list[tuple[str, str]]) -> None:
        """Removes parts of this job from the folders that were written to."""
        for folder in {posixpath.dirname(target) for _, target in told}:
            fs, at = self.place(folder)
            for found in fs.get_file_info(pafs.FileSelector(at or ".")):
                if f".part-{self.job}-" in found.base_name:
                    fs.delete_file(found.path)


class BinaryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BinaryWriter:
        return BinaryWriter()


def write_binary(rows: DataFrame) -> None:
    """rows (path, content), a row for each path: all files take their new content, or none if the job fails before its commit."""
    rows.sparkSession.dataSource.register(BinaryFiles)
    rows.select("path", "content").write.format(FORMAT).mode("append").save()


def fillable_cells(path: str, content: bytes) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(path, sheet, row_no, col_no, table, column) of cells to fill, on each sheet whose first row has the HEADERS."""
    for sheet, rows in files.sheets(content):
        if not rows:
            continue
        heads = {" ".join(v.split()).upper(): at for at, v in rows[0][1].items() if v}
        if not all(h in heads for h in HEADERS):
            continue
        told, of, named = (heads[h] for h in HEADERS)
        for row_no, cells in rows[1:]:
            if cells.get(told, "").upper().startswith(PLACEHOLDER):
                yield path, sheet, row_no, told, cells.get(of, ""), cells.get(named, "")


def fill_workbooks(books: DataFrame, described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) of workbooks that change, and (path, candidates, updated, unresolved) of all with cells to fill.

    books (path, content); described (table, column, description), a row for each key, in capitals. The cells meet the
    descriptions in a join by key; a workbook is taken apart and put together in the task that holds it.
    """
    cells = files._decoded(books, fillable_cells, "path string, sheet string, row_no int, col_no int, table string, column string")
    name = lambda c: text.table_name(F.col(c))
    cells = cells.withColumns({"table": name("table"), "column": name("column")}).where((F.col("table") != "") & ~F.col("table").isin(*NO_TABLES) & (F.col("column") != ""))
    met = cells.join(described.where("description <> ''").select("table", "column", "description"), ["table", "column"], "left")
    what = F.concat_ws(".", "table", "column")
    counts = met.groupBy("path").agg(F.count(F.lit(1)).alias("candidates"), F.count("description").alias("updated"), F.array_sort(F.collect_set(F.when(F.col("description").isNull(), what))).alias("unresolved"))
    changes = met.where("description IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sheet", "row_no", "col_no", "description"))).alias("changes"))
    return writers.encode(books.join(changes, "path").select("path", "content", "changes"), _filled), counts


def _filled(content: bytes, changes: list[dict]) -> bytes:
    for sheet in sorted({c["sheet"] for c in changes}):
        content = writers.xlsx_update(content, [(c["row_no"], c["col_no"], c["description"]) for c in changes if c["sheet"] == sheet], sheet)
    return content


