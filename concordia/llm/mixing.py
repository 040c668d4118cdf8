"""Mixing sources to target weights by Poisson replication, in built-in functions only.

Each source gets a mean repetition rate, its target share of the rows over its present share. A document's
number of copies is the inverse of the Poisson distribution with that mean at a number that a seeded hash of
the id gives; a large mean is the sum of equal small ones, whose tables of the distribution are short.
Copies are dealt by a hash of (seed, id, copy) and sorted by it within partitions, which is the global shuffle.

Defined results: a source without a target keeps rate 1; a null source is a source of its own (rate 1 with given
targets); rows that repeat an id get the same number of copies; a row without an id is drawn and dealt by a hash of its other columns
(maps and variants, which have none, left out), so equal rows without an id get the same number; null and empty texts
are replicated like any other; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import documents, partitions

SEED, STEP, TERMS = 17, 8.0, 64
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, n, rate). Without targets a source's weight is its number of rows to the power temperature."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if targets is not None:
        table = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))]) if targets else F.lit(None).cast("map<string,double>")
        weight = F.try_element_at(table, F.coalesce("source", F.lit("\0")))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    sizes = sizes.withColumn("w", weight)
    total = sizes.agg(F.sum("w").alias("all_w"), F.sum(F.when(F.col("w").isNotNull(), F.col("n"))).alias("all_n"))
    rate = F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")
    return sizes.join(F.broadcast(total)).select("source", "n", F.coalesce(rate, F.lit(1.0)).alias("rate"))  # total is a single row


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Distribution function of a Poisson variable with a small mean at 0 .. TERMS."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"])


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True) -> DataFrame:
    """Copies of docs' rows with all their columns and __copy (from 1), __rate and __key (the order of the shuffle)."""
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(STEP))).cast("int")
    table = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), steps.alias("__steps"), poisson_table(F.col("rate") / steps).alias("__cdf"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(table) if few else table, docs[source_col].eqNullSafe(F.col("__source")))
    hashed = [F.col(f.name) for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashed).cast("string")))

    def draw(acc: Column, i: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), ident, i.cast("string"))
        return acc + F.size(F.filter(F.col("__cdf"), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("__steps")), F.lit(0), draw)
    counted = joined.withColumn("__n", copies).where("__n > 0")
    rows = counted.select(*[F.col(c) for c in docs.columns], "__rate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    rows = rows.withColumn("__key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), ident, F.col("__copy").cast("string"))))
    return rows.repartition(partitions(docs.sparkSession), "__key").sortWithinPartitions("__key") if shuffle else rows


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy_no, rate and order_key of every copy, for weights that grow as the root of a source's size."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "source", F.col("text"))
    mixed = mix(rows, source_rates(docs))
    return mixed.select("doc_id", "source", F.col("__copy").cast("long").alias("copy_no"), F.round("__rate", 6).alias("rate"), F.col("__key").alias("order_key"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


SQL = f"""
WITH docs AS (SELECT doc_id, source, length(coalesce(text, '')) AS n_chars, row_number() OVER () AS nr FROM documents),
sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM docs GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps AS (SELECT source AS src, rate, greatest(1, ceil(rate / {STEP}))::BIGINT AS steps FROM rates),
pmf AS (SELECT src, k, exp(-(rate / steps) + k * ln(rate / steps) - lgamma(k + 1)) AS p FROM steps, range(0, {TERMS + 1}) r(k)),
cdf AS (SELECT src, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM pmf),
tables AS (SELECT src, list(c ORDER BY c) AS cs FROM cdf GROUP BY src),
draws AS (SELECT nr, doc_id, source, rate, n_chars, src,
                 ('0x' || substr(md5('{SEED}:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM docs JOIN steps ON source IS NOT DISTINCT FROM src, LATERAL (SELECT unnest(range(1, steps + 1)) AS i)),
counts AS (SELECT nr, doc_id, source, rate, n_chars, sum(len(list_filter(cs, lambda c: c <= u))) AS n
           FROM draws JOIN tables ON draws.src IS NOT DISTINCT FROM tables.src GROUP BY ALL)
SELECT doc_id, source, j AS copy_no, round(rate, 6) AS rate, md5('{SEED}/order:' || doc_id || ':' || j) AS order_key, n_chars
FROM counts, LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS j)
"""
