"""Hamming links between 64-bit fingerprints by a Gray-order hierarchical index.

Fingerprints are dealt by block keys: 64 bits are cut into `blocks` blocks, and there is a table for each
choice of blocks - radius of them, so any two fingerprints within the radius agree on the key of some table.
Within a partition, a table's fingerprints are sorted by Gray rank, which brings those with many shared
bits together. Runs of the order form leaves, runs of leaves form upper nodes; a node keeps the bits that
all below it share. Two nodes meet only if their shared bits differ in no more than the radius, which
settles whole groups at once; nodes that already belong to one component are not compared again.
Each partition returns a spanning forest of direct links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import partitions

LEAF, FAN, CHUNK = 16, 8, 1 << 11
#: Rows up to which wide_links deals by single blocks; a task then holds about a 128th, 262,144 rows.
WHOLE = 1 << 25


def block_tables(blocks: int, radius: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), blocks - radius))


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code word in Gray order (inverse of x ^ x >> 1)."""
    x = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _permute(fps: np.ndarray, first: tuple[int, ...], blocks: int) -> tuple[np.ndarray, int]:
    """The key blocks moved to the top; and their number of bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out, bits, key = np.zeros_like(fps), 0, 0
    for i in (*first, *[b for b in range(blocks) if b not in first]):
        width = edges[i + 1] - edges[i]
        part = (fps >> np.uint64(edges[i])) & np.uint64((1 << width) - 1)
        out |= part << np.uint64(64 - bits - width)
        bits += width
        key += width if i in first else 0
    return out, key


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # those that joined two trees

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(self.root, high, low)
            won = np.flatnonzero(self.root[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.links.append((i[won], j[won]))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _near_pairs(codes: np.ndarray, key_bits: int, radius: int, wide: np.ndarray | None, most_bits: int, groups: np.ndarray | None, forests: list[_Forest]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, i, j) chunk by chunk: places order[i], order[j] of pairs with equal top key_bits that are near each other.

    groups: a label of each code; codes with one label are one component from the start. The forest of places is
    put into forests; links that its taker adds meanwhile are heeded.
    """
    n = len(codes)
    rank = gray_rank(codes)
    order = np.argsort(rank, kind="stable")
    code, key = codes[order], rank[order] >> np.uint64(64 - key_bits)
    same = key[1:] == key[:-1]
    busy = np.zeros(n, bool)  # alone under its key: nothing to compare
    busy[1:] |= same
    busy[:-1] |= same
    order, code, key = order[busy], code[busy], key[busy]
    more = None if wide is None else wide[:, order]
    n = len(code)
    if not n:
        return
    levels = []  # pattern, mask, first key, last key; leaves first
    starts = np.arange(0, n, LEAF)
    ones, some = np.bitwise_and.reduceat(code, starts), np.bitwise_or.reduceat(code, starts)
    lo, hi = key[starts], key[np.minimum(starts + LEAF, n) - 1]
    while True:
        levels.append((ones, ~(ones ^ some), lo, hi))
        if len(ones) == 1:
            break
        starts = np.arange(0, len(ones), FAN)
        last = np.minimum(starts + FAN, len(ones)) - 1
        ones, some, lo, hi = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts), lo[starts], hi[last]
    forest = _Forest(n)
    if groups is not None:
        _, at, label = np.unique(groups[order], return_index=True, return_inverse=True)
        forest.root = at[label]
    forests.append(forest)
    stack = [(len(levels) - 1, np.zeros(1, int), np.zeros(1, int))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > CHUNK:
            stack += [(level, a[i : i + CHUNK], b[i : i + CHUNK]) for i in range(0, len(a), CHUNK)]
            continue
        size, count = (FAN, len(levels[level - 1][0])) if level else (LEAF, n)
        # Pairs of nodes that are one component already need no comparison.
        below = np.arange(0, n, LEAF * FAN**level)
        least, most = np.minimum.reduceat(forest.root, below), np.maximum.reduceat(forest.root, below)
        open_ = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b = a[open_], b[open_]
        step = np.arange(size)
        i = np.broadcast_to((a[:, None] * size + step)[:, :, None], (len(a), size, size)).ravel()
        j = np.broadcast_to((b[:, None] * size + step)[:, None, :], (len(b), size, size)).ravel()
        near = (i < count) & (j < count) & ((i < j) if not level else (i <= j))
        i, j = i[near], j[near]
        if level:
            pattern, mask, lo, hi = levels[level - 1]
            near = hi[i] >= lo[j]
            i, j = i[near], j[near]
            near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= radius
            if near.any():
                stack.append((level - 1, i[near], j[near]))
        else:
            near = key[i] == key[j]
            i, j = i[near], j[near]
            near = np.bitwise_count(code[i] ^ code[j]) <= radius
            i, j = i[near], j[near]
            if more is not None and len(i):
                near = sum(np.bitwise_count(x[i] ^ x[j]).astype(int) for x in more) <= most_bits
                i, j = i[near], j[near]
            if groups is not None:
                near = forest.root[i] != forest.root[j]
                i, j = i[near], j[near]
            if len(i):
                yield order, i, j


def local_links(codes: np.ndarray, key_bits: int, radius: int, wide: np.ndarray | None = None, most_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of direct links that span the components of all links among codes with equal top key_bits.

    wide: further words of each code, a row each; then a link also has at most most_bits differing bits in these.
    """
    forests: list[_Forest] = []
    order = np.empty(0, int)
    for order, i, j in _near_pairs(codes, key_bits, radius, wide, most_bits, None, forests):
        forests[0].union(i, j)
    if not forests or not forests[0].links:
        return np.empty(0, int), np.empty(0, int)
    i, j = (np.concatenate(x) for x in zip(*forests[0].links, strict=True))
    return order[i], order[j]


def local_pairs(codes: np.ndarray, key_bits: int, radius: int, wide: np.ndarray, most_bits: int, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs as of local_links whose groups differ, chunk by chunk."""
    for order, i, j in _near_pairs(codes, key_bits, radius, wide, most_bits, groups, []):
        yield order[i], order[j]


def owners(tables: list[tuple[int, ...]], blocks: int) -> list[int]:
    """For each table one of its blocks, each block about as often."""
    return [chosen[0] if len(chosen) != 2 or chosen[1] - chosen[0] <= blocks // 2 else chosen[1] for chosen in tables]


def _deal(rows: DataFrame, tables: list[tuple[int, ...]], blocks: int) -> DataFrame:
    """A row (t, fp, ..) for each table t, those with equal keys in one partition."""
    masks = block_masks(blocks)
    key_masks = F.array(*[F.lit(signed(sum(masks[i] for i in chosen))) for chosen in tables])
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))).alias("t"), *rows.columns)
    # The key follows from t and fp, so it is not shuffled itself.
    return dealt.repartition(partitions(rows.sparkSession), F.col("t"), F.col("fp").bitwiseAND(F.get(key_masks, F.col("t"))))


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def hamming_links(fingerprints: DataFrame, radius: int, blocks: int, col: str = "fp") -> DataFrame:
    """Links (a, b) within the radius that span the same components as all pairs of fingerprints within it.

    fingerprints: a column of distinct longs. Nulls have no links.
    """
    tables = block_tables(blocks, radius)
    rows = fingerprints.where(F.col(col).isNotNull()).select(F.col(col).alias("fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if not got:
            return
        table, fps = got
        for t, chosen in enumerate(tables):
            mine = fps[table == t].view(np.uint64)
            if len(mine) > 1:
                codes, bits = _permute(mine, chosen, blocks)
                a, b = local_links(codes, bits, radius)
                if len(a):
                    mine = mine.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[a]), pa.array(mine[b])], names=["a", "b"])

    return _deal(rows, tables, blocks).mapInArrow(search, "a long, b long")


def possible(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of places can have a Jaccard similarity of least. sets: sizes, then words of parities.

    Where parities differ, one of the two has an element that the other lacks; sizes tell no less than their difference.
    """
    size, parities = sets[0], [m.view(np.uint64) for m in sets[1:]]  # bitwise_count() takes the absolute value of signed numbers
    total = size[i] + size[j]
    apart = np.maximum(sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in parities), np.abs(size[i] - size[j]))
    return total - apart >= least * (total + apart) - 1e-9


def wide_links(nodes: DataFrame, node: str, names: list[str], at: int, keys: int, blocks: int, radius: int, most_bits: int, group: str | None = None, sketch: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """(a, b), a < b: pairs that agree on a table's keys blocks of names[at], are within the radius there and differ in
    at most most_bits bits of all of names. Every row is such a pair itself.

    Without group, those that span the components of all such pairs of a partition and table; with it, every pair
    whose groups differ (a pair may come from several tables).

    Rows are dealt by single blocks, each of which serves all tables it owns: nine rows for 36 tables of two of nine blocks. So a
    task holds the rows of a block's value, a 128th of all; past WHOLE rows they are dealt by the tables' whole keys.

    sketch: columns with the size of a row's set and the parities of its elements' hashes; pairs that cannot have a Jaccard
    similarity of least are left out (see possible).
    """
    tables = block_tables(blocks, blocks - keys)
    rows = nodes.select(F.col(names[at]).alias("fp"), F.col(node).alias("node"), *([F.col(group).alias("group")] if group else []), *[F.col(n).alias(f"w{i}") for i, n in enumerate(names) if i != at], *[F.col(c).cast("long").alias(f"s{i}") for i, c in enumerate(sketch or [])])

    few = nodes.count() <= WHOLE
    owner = owners(tables, blocks) if few else list(range(len(tables)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _columns(batches)
        if not got:
            return
        dealt = got[0]
        for t, chosen in zip(owner, tables, strict=True):
            fps, mine, *wide = (c[dealt == t] for c in got[1:])
            if len(mine) < 2:
                continue
            groups = wide.pop(0) if group else None
            sets = wide[len(names) - 1 :]
            wide = wide[: len(names) - 1]
            codes, bits = _permute(fps.view(np.uint64), chosen, blocks)
            more = np.array([codes, *[w.view(np.uint64) for w in wide]])
            found = [local_links(codes, bits, radius, more, most_bits)] if groups is None else local_pairs(codes, bits, radius, more, most_bits, groups)
            for i, j in found:
                if sets and len(i):
                    can = possible(sets, i, j, least)
                    i, j = i[can], j[can]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine[i], mine[j])), pa.array(np.maximum(mine[i], mine[j]))], names=["a", "b"])

    return _deal(rows, [(i,) for i in range(blocks)] if few else tables, blocks).mapInArrow(search, "a long, b long")
