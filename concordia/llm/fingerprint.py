"""Document fingerprints: SimHash of weighted terms, and a search of fingerprints within a Hamming radius.

Terms are pairs of neighbouring words in lower case; a term weighs as many votes as it has bytes (at most
64), since short words are common ones and say little. Only built-in functions are used.

Defined results: null texts count as empty and have fingerprint zero; equal texts have equal fingerprints; very long texts are
read whole; documents are ordered by doc_id, null first, then by a hash of the text, so rows that repeat an id or a whole row follow each
other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import documents, hex64, likeness64, materialize, space_words, whole_text
from concordia.llm.gray_index import block_masks, block_tables, signed
from concordia.llm.votes import shingles, vote

#: Rows for a range of ids, and the most ranges: what is broadcast (a row for each range) is bounded by the latter.
RANGE_ROWS, MAX_RANGES = 4096, 100_000


def term_votes(rows: DataFrame, keys: list[str], text_col: str = "__text", out: str = "fp") -> DataFrame:
    keep = [c for c in rows.columns if c != text_col]
    words = rows.select(*keep, space_words(F.lower(text_col)).alias("__words"))
    return vote(shingles(words, "__words", 2), keys, weight=F.least(F.octet_length("__term"), F.lit(64)), out=out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp) for every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__text"))
    return term_votes(rows, ["row", "doc_id"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, place, doc_id, text, next_text, guest) in id order; the last document's next is the first.

    Ids are cut into ranges of equal width, which are windows of their own; the first document of each range
    is sent to the range before as well, as its guest, so no window spans the table. Ids that are very
    unevenly spread make uneven ranges; results stay the same.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    # In decimals: ids may lie further apart than a long can tell.
    exact = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    rows = rows.withColumn("range", F.coalesce(F.floor((F.col("doc_id").cast("decimal(20,0)") - exact(low or 0)) / exact(width)), F.lit(-1)).cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    heads = rows.select("range", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.xxhash64("text").alias("h")).alias("head")).groupBy("range").agg(F.min("head").alias("head"))
    chain = Window.orderBy("range")  # one row for each range, MAX_RANGES at most
    heads = heads.select("head", F.coalesce(F.lag("range").over(chain), F.max("range").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = heads.select(F.col("head.doc_id").alias("__id"), F.col("head.h").alias("__h"), "before")
    joined = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left")
    home = F.struct(F.col("range"), F.lit(False).alias("guest"))
    placed = joined.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))))).alias("at"))
    window = Window.partitionBy("range").orderBy("guest", *order)
    placed = placed.select(F.col("at.range").alias("range"), F.col("at.guest").alias("guest"), "doc_id", "text")
    return placed.select("range", "guest", "doc_id", "text", F.lead("text").over(window).alias("next_text"), F.row_number().over(window).alias("place"))


def table_masks(blocks: int, radius: int) -> list[int]:
    masks = block_masks(blocks)
    return [sum(masks[i] for i in chosen) for chosen in block_tables(blocks, radius)]


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp, n_near): for each query fingerprint, how many rows of prints are within radius bits of it.

    prints: (fp, n) with distinct fp; queries: (fp), distinct. Permuted block tables: any two fingerprints
    within the radius agree on all of blocks - radius blocks, so one of the tables has both under one key;
    a pair counts only in the first such table.
    """
    masks = [F.lit(signed(m)) for m in table_masks(blocks, radius)]

    def tables(df: DataFrame, *more: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(m).alias("k")) for t, m in enumerate(masks)])
        return df.select("fp", *more, F.explode(entries).alias("e")).select("fp", *more, "e.t", "e.k")

    q, f = tables(queries).alias("q"), tables(prints, "n").alias("f")
    apart = F.col("q.fp").bitwiseXOR(F.col("f.fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(m) == 0, F.lit(t)) for t, m in enumerate(masks)])
    hits = q.join(f, (F.col("q.t") == F.col("f.t")) & (F.col("q.k") == F.col("f.k")) & (F.bit_count(apart) <= radius) & (first == F.col("q.t")))
    return hits.groupBy(F.col("q.fp").alias("fp")).agg(F.sum("f.n").alias("n_near"))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; n_same: rows with the same fingerprint; n_near: for doc_id divisible by 20, the
    other rows within 3 bits (else null)."""
    rows = with_next(documents(spark, sf_dir))
    cut = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    sides = F.when(F.col("guest"), F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("t")), F.struct(F.lit(True).alias("edited"), edited.alias("t")))
    )
    both = rows.select("range", "guest", "doc_id", "place", F.explode(sides).alias("s"))
    both = both.select("range", "guest", "doc_id", "place", F.col("s.edited").alias("edited"), F.char_length("s.t").cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("s.t"), 256)).alias("sha"), F.col("s.t").alias("__text"))
    # What a row carries is grouped by with its place: as aggregates, strings would force a sort of all terms.
    voted = term_votes(both, ["range", "place", "edited", "guest", "doc_id", "n_chars", "sha"])
    pairs = voted.groupBy("range", "place").agg(
        F.first("guest").alias("guest"),
        F.first("doc_id").alias("doc_id"),
        *[F.max(F.when(~F.col("edited"), F.col(c))).alias(c) for c in ("fp", "n_chars")],
        F.max(F.when(F.col("edited"), F.col("fp"))).alias("edited_fp"),
        F.lower(F.hex(F.max(F.when(F.col("edited"), F.col("sha"))))).alias("edited_sha256"),
    )
    ahead = F.lead("fp").over(Window.partitionBy("range").orderBy("place"))
    out = materialize(pairs.withColumn("next_fp", ahead).where(~F.col("guest")).drop("guest", "place"), "fingerprints")
    classes = out.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.col("doc_id") % 20 == 0).alias("asked"))
    classes = materialize(classes, "classes")
    near = neighbours(classes.select("fp", "n"), classes.where("asked").select("fp"))
    counts = classes.select("fp", "n").join(near, "fp", "left")
    out = out.join(counts, "fp")
    asked = F.col("doc_id") % 20 == 0
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness64(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness64(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("n").alias("n_same"),
        F.when(asked, F.coalesce("n_near", F.col("n")) - 1).alias("n_near"),
    )
