"""The flex reference: fields that are documented once for all models, in a spreadsheet of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators.enrich import last_wins

#: Normalised name of the dataset whose fields it describes, and of the header's first cell; its columns.
DATASET, HEADER = "GFLEXSETUP", "XMLTAGNAME"
COLUMNS = ["xml_tag_name", "column_description", "associated_table", "column_name", "column_characteristic"]


def is_flex(dataset: Column) -> Column:
    return text.normalize_token(dataset) == DATASET


def reference(rows: DataFrame, cells_col: str = "cells", order: str = "row_no") -> DataFrame:
    """COLUMNS from spreadsheet rows (order, cells), repaired if all of a row is in its first cell; the last row of a tag counts.

    rows: one sheet each, as of sources.files.read_xlsx (whose cells are repaired already).
    """
    cell = lambda i: F.btrim(F.coalesce(F.get(F.col(cells_col), i), F.lit("")))
    named = rows.where((cell(0) != "") & (text.normalize_token(cell(0)) != HEADER))
    return last_wins(named.select(F.upper(cell(0)).alias(COLUMNS[0]), *[cell(i).alias(c) for i, c in enumerate(COLUMNS) if i], order), [COLUMNS[0]], order).select(*COLUMNS)


def describe(fields: DataFrame, ref: DataFrame) -> DataFrame:
    """fields (dataset, field, description, data_type, source_table, source_column, ..): those of a flex dataset take the reference's
    description and characteristic where it has them, its table and column only where theirs are blank or N/A."""
    r = ref.select(F.col(COLUMNS[0]).alias("__tag"), *[F.nullif(c, F.lit("")).alias(f"__{c}") for c in COLUMNS[1:]])
    joined = fields.join(r, is_flex(F.col("dataset")) & (F.upper("field") == F.col("__tag")), "left")
    blank = lambda c: F.coalesce(c, F.lit("")).isin("", "N/A")
    return joined.withColumns(
        {
            "description": F.coalesce("__column_description", "description"),
            "data_type": F.coalesce("__column_characteristic", "data_type"),
            "source_table": F.when(blank("source_table"), F.coalesce("__associated_table", "source_table")).otherwise(F.col("source_table")),
            "source_column": F.when(blank("source_column"), F.coalesce("__column_name", "source_column")).otherwise(F.col("source_column")),
        }
    ).select(*fields.columns)
