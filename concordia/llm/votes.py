"""SimHash by signed votes, as plain DataFrame aggregation.

A term's 64-bit hash votes on each bit with the term's weight. Two vote counters of 32 bits share
one long, so 32 sums of longs hold the 64 counters of a document, and the sums combine before the
shuffle. All of it is built-in functions inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def shingle(words: Column, pos: Column, first: Column, k: int) -> Column:
    """k words from pos on, joined by a space; fewer where the sequence ends (get() gives null, which concat_ws skips)."""
    return first if k == 1 else F.concat_ws(" ", first, *[F.get(words, pos + i) for i in range(1, k)])


def shingles(df: DataFrame, words: str, k: int, out: str = "__term") -> DataFrame:
    """A row for each k-word shingle; a shorter sequence is one shingle, an empty one a single row ''.

    words: array column as made by common.space_words.
    """
    keep = [c for c in df.columns if c != words]
    rows = df.select(*keep, words, F.posexplode(words).alias("__pos", "__word"))
    rows = rows.where((F.col("__pos") == 0) | (F.col("__pos") <= F.size(words) - k))
    return rows.select(*keep, shingle(F.col(words), F.col("__pos"), F.col("__word"), k).alias(out))


def vote(terms: DataFrame, keys: list[str], term: str = "__term", weight: Column | None = None, out: str = "__fp", seed: str | None = None) -> DataFrame:
    """One row per keys with the fingerprint: a bit is 1 if over half the weight of the terms has it set.

    Terms '' have no vote; without votes the fingerprint is zero. seed: a column that, hashed first, seeds the terms' hash.
    """
    w = F.when(F.col(term) == "", F.lit(0)).otherwise(F.lit(1) if weight is None else weight).cast("long")
    return majority(terms.select(*keys, F.xxhash64(*([seed] if seed else []), term).alias("__h"), w.alias("__w")), keys, out)


def majority(rows: DataFrame, keys: list[str], out: str = "__fp") -> DataFrame:
    """One row per keys with the bits that over half the weight of rows (keys, __h, __w) has set."""
    lanes = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(_LANES)) * F.col("__w")).alias(f"__s{j}") for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("__w").alias("__n"), *lanes)

    def bit(count: Column, j: int) -> Column:
        return F.when(count * 2 > F.col("__n"), F.lit((1 << j) if j < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    fp = None
    for j in range(32):
        s = F.col(f"__s{j}")
        for b in (bit(s.bitwiseAND(F.lit(_LOW)), j), bit(F.shiftrightunsigned(s, 32), j + 32)):
            fp = b if fp is None else fp.bitwiseOR(b)
    return sums.select(*keys, fp.alias(out))
