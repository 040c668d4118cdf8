"""Exact deduplication: 128-bit content hash, byte comparison inside groups, one stable survivor.

Rows are counted by (hash, text) with map-side combination, so a group that holds a third of all rows
shrinks to one row per task before the shuffle, and grouping by the text itself compares bytes: two
texts that share a hash fall into two groups. Documents meet their group by the hashes only, never by
the text; the join's hot keys are left to AQE's skew split.

Defined results: null text counts as empty; rows that repeat a doc_id count one by one in group_size
and carry the same flag; a null doc_id never survives a group that has another id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import documents, whole_text


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. keep: 'min' or 'max' id survives.

    normalise: a Column -> Column function; texts are equal when they are identical after it.
    """
    text = whole_text(text_col)
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    content, digest = F.unhex(F.md5("__text")).alias("__hash"), F.sha2("__text", 256).alias("text_sha256")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    exact = rows.select("doc_id", content, "__text").groupBy("__hash", "__text").agg(best.alias("keep_id"), F.count("*").alias("group_size")).select("__hash", digest, "keep_id", "group_size")
    # Equal hash and digest with different bytes would make two rows here: stop rather than mix them up.
    groups = exact.groupBy("__hash", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.count("*").alias("__texts"),
    )
    sound = F.when(F.col("__texts") > 1, F.raise_error(F.lit("two texts share all digests")).cast("bigint")).otherwise(F.col("group_size"))
    groups = groups.select("__hash", F.col("text_sha256").alias("__sha"), "keep_id", sound.alias("group_size"))
    out = rows.select("doc_id", content, digest).alias("d").join(groups.alias("g"), (F.col("d.__hash") == F.col("g.__hash")) & (F.col("d.text_sha256") == F.col("g.__sha")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each text, with all its columns: the one with the smallest (largest) id, null ids last.

    Rows with equal text and id are told apart by their other columns, which must have an order; the first stays.
    """
    text, null = whole_text(text_col), F.col(id_col).isNull()
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # The row travels in the aggregate, less its text, so no id has to find it again.
    row = F.struct((~null if keep == "max" else null).alias("none"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("void"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    kept = docs.groupBy(F.unhex(F.md5(text)).alias("__hash"), text.alias("__text")).agg((F.max if keep == "max" else F.min)(row).alias("__row"))
    back = {id_col: F.col("__row.id"), text_col: F.when(~F.col("__row.void"), F.col("__text"))} | {c: F.col(f"__row.c{i}") for i, c in enumerate(rest)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="max")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
