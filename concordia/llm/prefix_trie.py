"""Prefix trie of conversations, its totals by leaf-peeling message passing.

A node is a distinct sequence of first turns (role, text); it is named by its smallest member and its depth. Sequences are told by
a running 128-bit sum of hashes of (depth, role, text), so no conversation is held whole: see running_sums. Nodes are groups of
those sums; the members, children and ended conversations of a node are counted by partial aggregates.

Nodes with the same members lie on one path; such a path is one vertex of the message passing, named by (smallest member, number
of members). Every vertex holds the number of children still awaited. Vertices that await none are complete: they leave the
table, and send leaves and saved tokens of their subtree to their parents, summed up by parent; the next round does the same,
until the root's own vertex has left. A round is a join by key, written to the shared folder. There are as many rounds as
vertices on the longest path (at most one for each number of members along it), not as many as turns.

Memory of a task: rows of a range; one block of up to 4,096 ids. The hash of a node's ended conversations takes blocks in order.

Defined results: a null conv_id is no conversation, and its rows are ignored; turns are ordered by turn, null first, then by
role and text; repeated rows are turns of their own; null role or text is empty; texts of any length are hashed whole; an
empty table gives an empty trie (no root); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import materialize, partitions
from concordia.llm.intervals import crc32_sql
from concordia.llm.running import running_sums

#: Of the rebuilding: conversations that share openings, and the largest number of shared turns plus one.
GROUP, MOST = 5, 9
BLOCK_BITS = 12
_PIECES = ("k0", "k1", "k2", "k3")
_NONE = hashlib.sha256().hexdigest()


def _pieces(digest: Column) -> dict[str, Column]:
    """Four 32-bit numbers of an md5 in hexadecimal digits."""
    return {k: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i, k in enumerate(_PIECES)}


def _key(sums: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(F.pmod(s, F.lit(1 << 32))), 8, "0") for s in sums])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, size): turns from place 0, a hash of role and text, and the text's UTF-8 bytes."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = running_sums(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"__n": F.lit(1).cast("long")})
    return placed.select("conv_id", (F.col("__n") - 1).alias("place"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("turn_hash"), F.octet_length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's opening is exchanged for that of the first one of its group.

    Conversation c gets the first h turns of conversation c - c % group, h = crc32(c) % most, before its own turns from place h.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % group
    convs = lengths.select("conv_id", "n", first.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    # opening: how many turns it gets; total: all its turns
    opening = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.join(bases, "base", "left").select("conv_id", "base", "h", opening.alias("opening"), (opening + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    own = turns.join(convs.select("conv_id", "h", "opening"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("opening") + 1).alias("depth"), "turn_hash", "size")
    heads = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "turn_hash", "size")
    given = heads.join(convs.where("opening > 0").select("conv_id", "base", "opening"), "base").where("place < opening").select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash", "size")
    return own.unionByName(given), convs.select("conv_id", "total")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of conversations that are not rebuilt."""
    return turns.select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash", "size"), turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, block, ids) in order of node and block: SHA-256 of a node's ids, block after block."""
    node, state, nodes, hashes = None, None, [], []
    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    nodes.append(node)
                    hashes.append(state.hexdigest())
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(hashes)], names=["node", "ends_sha256"])
            nodes, hashes = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, node, above, size, sum_size, ends): a row for each conversation and node on its path, the root included."""
    tagged = turns.withColumn("tag", F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_hash"))))
    summed = running_sums(tagged, "conv_id", [F.col("depth")], {**{f"__{k}": v for k, v in _pieces(F.col("tag")).items()}, "__size": F.col("size")})
    here, own = [F.col(f"__{k}") for k in _PIECES], _pieces(F.col("tag"))
    below = summed.select("conv_id", "depth", _key(here).alias("node"), _key([s - own[k] for s, k in zip(here, _PIECES, strict=True)]).alias("above"), "size", F.col("__size").alias("sum_size"))
    ended = below.join(convs.select("conv_id", "total"), "conv_id").withColumn("ends", F.col("depth") == F.col("total")).drop("total")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), F.lit("0" * 32).alias("node"), F.lit(None).cast("string").alias("above"), zero.alias("size"), zero.alias("sum_size"), (F.col("total") == 0).alias("ends"))
    return ended.unionByName(root)


def end_hashes(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: their ids in order, joined by commas."""
    blocks = rows.where("ends").groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return blocks.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "block").mapInArrow(_hash_blocks, "node string, ends_sha256 string")


def peel(vertices: DataFrame) -> DataFrame:
    """(m, n, below_leaves, below_saved): what the subtrees under each vertex hold, leaf by leaf.

    vertices: (m, n, up_m, up_n, awaited, saved): name, the parent's name (null: none), number of children, own saved tokens.
    """
    waiting = materialize(vertices.select("*", F.lit(0).cast("long").alias("below_leaves"), F.lit(0).cast("long").alias("below_saved")), "peel")
    done = []
    while True:
        complete = waiting.where("awaited = 0")
        done.append(complete.select("m", "n", "below_leaves", "below_saved"))
        rest = waiting.where("awaited > 0")
        if rest.isEmpty():
            break
        leaves = F.greatest(F.col("below_leaves"), F.lit(1))
        sent = complete.where("up_m IS NOT NULL").groupBy(F.col("up_m").alias("m"), F.col("up_n").alias("n")).agg(F.count(F.lit(1)).alias("came"), F.sum(leaves).alias("got_leaves"), F.sum(F.col("below_saved") + F.col("saved")).alias("got_saved"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        after = rest.join(sent, ["m", "n"], "left").select("m", "n", "up_m", "up_n", (F.col("awaited") - F.coalesce("came", F.lit(0))).alias("awaited"), "saved", plus("below_leaves", "got_leaves"), plus("below_saved", "got_saved"))
        waiting = materialize(after, "peel")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of turns (conv_id, depth from 1, turn_hash, size) of convs (conv_id, total)."""
    rows = materialize(prefix_rows(turns, convs), "prefixes")
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("m"), F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), F.min("above").alias("above"), F.min("size").alias("size"), F.min("sum_size").alias("sum_size"))
    kids = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = materialize(nodes.join(kids, "node", "left").join(end_hashes(rows), "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "nodes")
    up = nodes.select(F.col("node").alias("above"), F.col("m").alias("up_m"), F.col("n").alias("up_n"))
    linked = materialize(nodes.join(up, "above", "left"), "linked")
    # a vertex: the nodes with the same members
    top = F.min_by(F.struct("up_m", "up_n"), "depth")
    paths = linked.groupBy("m", "n").agg(top.alias("up"), F.max("sum_size").alias("to"), F.sum("size").alias("sizes"))
    paths = materialize(paths.select("m", "n", "up.up_m", "up.up_n", "to", ((F.col("n") - 1) * F.col("sizes")).alias("saved")), "paths")
    kids = paths.where("up_m IS NOT NULL").groupBy(F.col("up_m").alias("m"), F.col("up_n").alias("n")).agg(F.count(F.lit(1)).alias("awaited"))
    below = peel(paths.drop("to").join(kids, ["m", "n"], "left").withColumn("awaited", F.coalesce("awaited", F.lit(0))))
    met = linked.join(paths.select("m", "n", "to"), ["m", "n"]).join(below, ["m", "n"])
    return met.select(
        F.col("m").alias("conv_id"), "depth", F.col("up_m").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.greatest("below_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("to") - F.col("sum_size") + F.col("size")) + F.col("below_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefix_trie(*rebuilt(turns))


SQL = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS b, {crc32_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM own)),
turns AS (SELECT c, 0 AS part, i, role, text FROM convs JOIN own ON conv_id = b WHERE i < h UNION ALL SELECT c, 1, i, role, text FROM convs JOIN own ON conv_id = c WHERE i >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth, {{'role': role, 'text': text}} AS turn, strlen(text) AS size FROM turns),
paths AS (SELECT c, depth, list(turn) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, size FROM placed
   UNION ALL SELECT c, 0, [], 0 FROM convs),
totals AS (SELECT c, max(depth) AS total FROM paths GROUP BY c),
nodes AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n, any_value(size) AS size, coalesce(string_agg(CASE WHEN depth = total THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
   FROM paths JOIN totals USING (c) GROUP BY depth, path),
linked AS (SELECT x.*, p.conv_id AS parent_conv_id FROM nodes x LEFT JOIN nodes p ON p.depth = x.depth - 1 AND p.path = x.path[1:x.depth - 1]),
kids AS (SELECT p.depth, p.path, count(x.conv_id) AS n_children FROM nodes p LEFT JOIN nodes x ON p.depth = x.depth - 1 AND p.path = x.path[1:p.depth] GROUP BY ALL),
below AS (SELECT x.depth, x.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((y.n - 1) * y.size) AS saved_tokens
   FROM nodes x JOIN nodes y ON y.depth >= x.depth AND y.path[1:x.depth] = x.path JOIN kids k ON k.depth = y.depth AND k.path = y.path GROUP BY ALL)
SELECT conv_id, l.depth, parent_conv_id, n AS n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM linked l JOIN kids k ON k.depth = l.depth AND k.path = l.path JOIN below b ON b.depth = l.depth AND b.path = l.path
"""
