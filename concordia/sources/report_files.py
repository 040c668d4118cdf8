"""A Spark data source that writes text files: many files, or one large file, from ordered lines, all or nothing.

Rows (file, order.., line) are dealt to ranges of (file, order), so a file with very many lines is written by several tasks. A task
writes its lines as pieces beside the target; what it wrote is told to the driver only if the task succeeds. The commit joins
the pieces of each file in the order of the ranges, a block at a time, and moves each file to its name; an aborted job, like a
finished one, leaves no piece behind. The folder must be one that all executors reach (any file system of pyarrow).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, BLOCK = "concordia_report", 1 << 20
BOM = "\ufeff"


@dataclass
class Pieces(WriterCommitMessage):
    """What one task wrote: its partition, and (file, name of the piece) in order."""

    partition: int
    written: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    """Options: path; prefix, joiner and suffix, the texts before, between and after a file's lines; always, a file to write even without lines."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.job = options["path"], uuid.uuid4().hex
        self.prefix, self.joiner, self.suffix = (options.get(k, "").encode() for k in ("prefix", "joiner", "suffix"))
        self.always = options.get("always")

    def folder(self) -> tuple[pafs.FileSystem, str, str]:
        """The file system, the target folder and the folder of pieces."""
        fs, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        return fs, root, posixpath.join(root, f"_pieces-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Pieces:
        fs, _, pieces = self.folder()
        fs.create_dir(pieces, recursive=True)
        context = TaskContext.get()
        done, file, out = Pieces(context.partitionId() if context else 0, []), None, None
        try:
            for row in iterator:
                if row[0] != file:
                    if out is not None:
                        out.close()
                    file, name = row[0], uuid.uuid4().hex
                    out = fs.open_output_stream(posixpath.join(pieces, name), buffer_size=BLOCK)
                    done.written.append((file, name))
                else:
                    out.write(self.joiner)
                out.write((row[-1] or "").encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Pieces | None]) -> None:
        fs, root, pieces = self.folder()
        fs.create_dir(pieces, recursive=True)
        files: dict[str, list[str]] = {self.always: []} if self.always else {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for file, name in m.written:
                files.setdefault(file, []).append(name)
        try:
            whole = {}
            for file, names in files.items():
                whole[file] = posixpath.join(pieces, f"whole-{uuid.uuid4().hex}")
                with fs.open_output_stream(whole[file], buffer_size=BLOCK) as out:
                    out.write(self.prefix)
                    for i, name in enumerate(names):
                        out.write(self.joiner if i else b"")
                        with fs.open_input_stream(posixpath.join(pieces, name)) as piece:
                            while block := piece.read(BLOCK):
                                out.write(block)
                    out.write(self.suffix)
            for file, at in whole.items():
                put(fs, at, posixpath.join(root, file))
        finally:
            fs.delete_dir(pieces)

    def abort(self, messages: list[Pieces | None]) -> None:
        fs, _, pieces = self.folder()
        if fs.get_file_info(pieces).type != pafs.FileType.NotFound:
            fs.delete_dir(pieces)


def put(fs: pafs.FileSystem, at: str, to: str) -> None:
    """Moves a file over another; where that may not be replaced, beside it, with _new before the ending."""
    fs.create_dir(posixpath.dirname(to), recursive=True)
    try:
        fs.move(at, to)
    except OSError:
        stem, ending = posixpath.splitext(to)
        fs.move(at, f"{stem}_new{ending}")


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))


def write_files(lines: DataFrame, path: str, order: list[Column] | None = None, prefix: str = "", joiner: str = "\n", suffix: str = "\n", always: str | None = None) -> None:
    """One file under path for each value of lines.file, from lines.line in order. A null line is empty; a null file is not written."""
    spark = lines.sparkSession
    spark.dataSource.register(ReportFiles)
    keys = {f"key{i}": c for i, c in enumerate(order or [])}
    by = [F.col("file"), *[F.col(k) for k in keys]]
    rows = lines.where("file IS NOT NULL").select("file", *[c.alias(k) for k, c in keys.items()], "line")
    # ascending everywhere: callers negate what is to descend
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    placed.write.format(FORMAT).mode("append").options(path=path, prefix=prefix, joiner=joiner, suffix=suffix, **({"always": always} if always else {})).save()


def csv_line(cells: list[Column]) -> Column:
    """A CSV line: cells with a comma, a quote or a line break are quoted; null is empty."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(x.cast("string"), F.lit("")) for x in cells)]
    return F.concat_ws(",", *quoted)


def write_csv_files(rows: DataFrame, path: str, file: Column, columns: list[str], order: list[str], bom: bool = True, always: str | None = None) -> None:
    """A CSV file with a header for each value of file; bom: begun with a byte order mark, as spreadsheets want it."""
    lines = rows.select(file.alias("file"), *order, F.concat(csv_line([F.col(c) for c in columns]), F.lit("\r\n")).alias("line"))
    write_files(lines, path, [F.col(c) for c in order], (BOM if bom else "") + ",".join(columns) + "\r\n", "", "", always)
