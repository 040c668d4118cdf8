"""SimHash near-duplicates: word-shingle fingerprints, linked by a Gray-order hierarchical index.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; texts of
fewer words than a shingle are one shingle; rows that repeat a doc_id are separate rows of its component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import among, ascii_lower, documents, hex64, materialize, partitions, space_words, whole_text
from concordia.llm.components import components, spanning_links
from concordia.llm.gray_index import hamming_links, wide_links
from concordia.llm.shingle_sets import hash_sets, prints_and_sketches
from concordia.llm.votes import majority, shingles, vote

#: Times that the rows of a group are measured against its hub.
HUBS = 2
#: Hashes of the sets of a group's part, and what a row counts beside its hashes, which bounds the pairs of two parts.
CELL, EACH = 1 << 18, 256


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp): an unweighted SimHash of each row's word shingles; row numbers the rows of the scan."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), space_words(ascii_lower(whole_text(text_col))).alias("__words"))
    return vote(shingles(rows, "__words", shingle_words), ["row", "doc_id"], out="fp")


def near_groups(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(row, doc_id, fp, component_id): the smallest doc_id that links of at most radius bits reach.

    Equal fingerprints meet first, so a large group of copies is a single node of the index.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(hamming_links(nodes, radius, blocks))
    members = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints.fp == F.col("__fp")).select("row", "doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 3, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, shingle_words, id_col, text_col), "prints")
    return near_groups(prints, radius, blocks)


def set_sketches(rows: DataFrame, k: int) -> DataFrame:
    """(row, n, b0 .. b3): the number of distinct shingles of each row, and 256 parities: of the shingles whose hash falls on each."""
    return prints_and_sketches(rows, k, 0)


def cells(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs (group, a, b) with the columns i, j: rows of a group are dealt to parts of about CELL, a pair to its rows' parts.

    sizes: (row, n). So a row's set is needed once for each part of its group, however many pairs the row has.
    """
    ends = pairs.select("group", F.explode(F.array("a", "b")).alias("row")).distinct()
    parts = ends.join(sizes, "row").groupBy("group").agg(F.ceil(F.sum(F.col("n") + EACH) / F.lit(CELL)).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    return pairs.join(parts, "group").select("group", F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"), "a", "b")


def verified(rows: DataFrame, pairs: DataFrame, sizes: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b) of the pairs (group, a, b) whose shingle sets (by 64-bit hashes of the shingles) have a Jaccard similarity of at least least.

    group: any label that pairs of the same rows share; sizes: (row, n), the sizes of the sets. Pairs meet their sets in cells, so
    what is shuffled grows with the rows of a group and not with its pairs.
    """
    dealt = materialize(cells(pairs, sizes), "cells")
    cell = ["group", "i", "j"]
    wanted = dealt.select(*cell, F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = hash_sets(among(rows, dealt.select(F.explode(F.array("a", "b")).alias("row")), "row"), k)
    held = sets.join(wanted, "row").select(*cell, F.col("row").alias("a"), F.lit(None).cast("long").alias("b"), "s")
    asked = dealt.select(*cell, "a", "b", F.lit(None).cast("array<long>").alias("s"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *at, a, b, s in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5), strict=True):
                if at != now:
                    now, known = at, {}
                if b is None:
                    known[a] = s.values.to_numpy()
                    continue
                both = len(np.intersect1d(known[a], known[b], assume_unique=True))
                if both / (len(known[a]) + len(known[b]) - both) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    together = held.unionAll(asked).repartition(partitions(rows.sparkSession), *cell).sortWithinPartitions(*cell, F.col("b").asc_nulls_first())
    return materialize(together.mapInArrow(measure, "a long, b long"), "verified")


def hub_links(rows: DataFrame, nodes: DataFrame, names: list[str], groups: DataFrame, k: int, least: float) -> DataFrame:
    """Verified links of each group's rows to its hub, the row whose prints are nearest to the majority of the group's bits.

    groups: (row, root). Copies of one text with edits of their own are often nearer to it than to each other; a group costs
    as many pairs as it has rows.
    """
    members = materialize(nodes.join(groups, "row"), "members")
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(n).alias("fp")) for i, n in enumerate(names)])).alias("x")
    bits = majority(members.select("root", parts).select("root", "x.part", F.col("x.fp").alias("__h"), F.lit(1).cast("long").alias("__w")), ["root", "part"], "fp")
    middle = bits.groupBy("root").agg(*[F.max(F.when(F.col("part") == i, F.col("fp"))).alias(f"m{i}") for i in range(len(names))])
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(n).bitwiseXOR(F.col(f"m{i}"))) for i, n in enumerate(names)])
    hubs = members.join(middle, "root").groupBy("root").agg(F.min(F.struct(apart.alias("d"), "row")).alias("hub"))
    pairs = members.join(hubs, "root").select(F.col("hub.row").alias("a"), F.col("row").alias("b")).where("a <> b")
    pairs = materialize(pairs.withColumn("group", F.col("a")), "hub-pairs")
    return verified(rows, pairs, nodes.select("row", "n"), k, least)


def grouped(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs (a, b) as (group, a, b). groups: (row, root)."""
    return pairs.join(groups.select(F.col("row").alias("a"), F.col("root").alias("group")), "a").select("group", "a", "b")


def similar_groups(rows: DataFrame, shingle_words: int, parts: int, radius: int, blocks: int, most_bits: int, wide_radius: int, wide_bits: int, least: float) -> DataFrame:
    """(row, root) of every row of rows (row, text) that links of a Jaccard similarity of at least least join to another.

    The index only proposes pairs: two rows meet if they agree on blocks - radius blocks of one of their prints. Each
    pair is measured on its shingles before it links. Three rounds keep the pairs few, though no pair goes unmeasured
    but within a component:
    1. rows with equal prints against the smallest of them; those with the same set become one node;
    2. pairs within radius (one print) and most_bits (all prints) make groups; a spanning forest of these pairs is measured, and
       every row against the hub of its group, twice: the second time only rows that no link has joined to another yet;
    3. all pairs that their sketches do not rule out within wide_radius and wide_bits whose nodes are not in one component yet.
    """
    names, keys = [f"fp{s}" for s in range(parts)], blocks - radius
    prints = materialize(prints_and_sketches(rows, shingle_words, parts), "prints")
    firsts = prints.groupBy(*names).agg(F.min("row").alias("a"))
    alike = materialize(prints.join(firsts, names).where("a <> row").select(F.col("a").alias("group"), "a", F.col("row").alias("b")), "alike")
    sizes = prints.select("row", "n")
    same = verified(rows, alike, sizes, shingle_words, 1.0)
    nodes = materialize(prints.join(same, prints.row == same.b, "left_anti"), "nodes")
    links = reduce(DataFrame.unionAll, [wide_links(nodes, "row", names, s, keys, blocks, radius, most_bits) for s in range(parts)])
    forest = materialize(spanning_links(links), "forest")
    groups = components(forest).select(F.col("node").alias("row"), "root")
    sure = verified(rows, grouped(forest, groups), sizes, shingle_words, least)
    for _ in range(HUBS):
        sure = materialize(sure.unionAll(hub_links(rows, nodes, names, groups, shingle_words, least)), "sure")
        joined = sure.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        groups = groups.join(joined, "row", "left_anti")
    roots = components(sure)
    sketch = ["n", "b0", "b1", "b2", "b3"]
    known = materialize(nodes.join(roots, nodes.row == roots.node, "left").select("row", *names, *sketch, F.coalesce("root", "row").alias("root")), "known")
    wide = reduce(DataFrame.unionAll, [wide_links(known, "row", names, s, keys, blocks, wide_radius, wide_bits, "root", sketch, least) for s in range(parts)])
    wide = materialize(wide.distinct(), "pairs")
    more = verified(rows, grouped(wide, components(wide).select(F.col("node").alias("row"), "root")), sizes, shingle_words, least)
    return components(same.unionAll(sure).unionAll(more)).select(F.col("node").alias("row"), "root")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
