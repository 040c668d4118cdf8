"""A training-data pipeline over documents: language, exact and near duplicates, source weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import exact_dedup, language, mixing, packing, simhash_dedup
from concordia.llm.common import among, documents, materialize

#: A document goes below this score: no language has this share of the likelihoods, or of the letters in words it knows.
LEAST_SCORE = 0.5
#: Near-duplicate stage: words of a shingle, prints of 64 bits, blocks of the index less blocks of a key, blocks of the
#: index. Two texts whose shingle sets have a Jaccard similarity j differ in a share of about acos(2j / (1 + j)) / pi of
#: the bits: 10 of 64 and 29 of 192 at 0.8. RADIUS and MOST_BITS bound the pairs that are measured first.
SHINGLE, PRINTS, RADIUS, BLOCKS, MOST_BITS = 5, 3, 7, 9, 32
#: Differing bits of one print and of all prints of any pair that is measured; and the similarity that links.
WIDE_RADIUS, WIDE_BITS, SIMILARITY = 24, 52, 0.8


#: The columns that stages look at. Others only travel along, under names that clash with nothing.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage over docs whose other columns are renamed on the way in and named again on the way out."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in COLUMNS else f"extra{i}" for i, c in enumerate(docs.columns)])
        return stage(plain).toDF(*docs.columns)

    return run_stage


@apart
def language_stage(docs: DataFrame) -> DataFrame:
    """Keeps documents whose language can be told: not 'und', and a score of LEAST_SCORE at least.

    Null, empty and letterless texts go; texts are read whole; repeated rows and ids are judged one by one; a tie of languages
    goes to the first in order; where no row has a language, every text with a letter stays; an empty table gives an empty one.
    """
    model = language.fit(docs)
    if not model.langs:  # nothing to tell languages by is no reason to lose the corpus
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    told = language.identify(docs, model, pred="__pred", score="__score")
    return told.where((F.col("__pred") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


@apart
def exact_stage(docs: DataFrame) -> DataFrame:
    """Of rows with the same text, the one with the smallest doc_id stays: one row, null ids last, then by the other columns.

    A null text equals an empty one; repeated rows become one; an empty table gives an empty one.
    """
    return exact_dedup.exact_dedup(docs, keep="min")


@apart
def near_stage(docs: DataFrame) -> DataFrame:
    """Of each group that pairs of at least SIMILARITY join, the row with the smallest doc_id stays (null last, then by row).

    Rows are dropped, never ids. Null, empty and blank texts are one group; texts shorter than a shingle are one shingle;
    repeated rows are one group; an empty table gives an empty one.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col("__row").alias("row"), "text")
    found = simhash_dedup.similar_groups(texts, SHINGLE, PRINTS, RADIUS, BLOCKS, MOST_BITS, WIDE_RADIUS, WIDE_BITS, SIMILARITY)
    members = rows.select("__row", "doc_id").join(found, F.col("__row") == F.col("row")).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("k"))
    best = members.groupBy("root").agg(F.min("k").alias("best"))
    copies = members.join(best, "root").where("k.row <> best.row").select(F.col("k.row").alias("__row"))
    return among(rows, copies, "__row", inside=False).select(*docs.columns)


@apart
def mixing_stage(docs: DataFrame) -> DataFrame:
    """Copies of the documents by source, weights growing as the root of a source's size, in a new order.

    A null source is one of its own; null and empty texts count like others; rows that repeat an id, or have none, get the
    same number of copies; an empty table gives an empty one.
    """
    return mixing.mix(docs, mixing.source_rates(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' ids, as op7: a null or empty text is its end id; copies are packed one by one."""
    return packing.pack(materialize(packing.pieces(docs), "pieces"))


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no SimHash index, Poisson draw over its result or tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
