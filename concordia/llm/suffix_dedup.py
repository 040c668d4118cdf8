"""Substring deduplication over bytes: suffix arrays by the difference-cover algorithm.

repeats.py narrows the corpus to shards of segments that may share a 100-byte string; each partition sorts
all suffixes of its shards' segments: sample positions (those not divisible by 3) are sorted by triples and named, names that
repeat are sorted by recursion, the other suffixes follow from their first symbol and the sample rank behind it, and both are
merged. Neighbours in the order with the same first 100 bytes are one string, whose first place counts.

Defined results: null text counts as empty; shorter texts than a window lose nothing; documents without an id come behind
all others; of documents with one id, or none, and different texts, the one whose text has the smaller hash comes first; rows that
repeat an id and a text are one document and lose the same bytes; very long texts are cut into parts that overlap by a
window, and are joined whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concordia.llm.common import documents
from concordia.llm.repeats import ANSWERS, Spec, merged, removals

#: In bytes; MOST: of a shard that is solved at once.
WINDOW, GRAM, MOST = 100, 24, 1 << 21


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Order-preserving names, from 1, of the rows of the columns."""
    key, bits = columns[0].astype(np.int64), int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        more = int(c.max(initial=0)).bit_length()
        if bits + more > 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bits = int(key.max(initial=0)).bit_length()
        key = (key << more) | c
        bits += more
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order. s: positive integers."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with a sentinel position where the length needs it
    sample = np.concatenate([one, two])
    names = _dense(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample):
        inner = suffix_array(names)
        order = sample[inner]
    else:
        order = sample[np.argsort(names)]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    rest = np.arange(0, n, 3)
    keys = (t[rest] << 32) | rank[rest + 1] if t.max() < 1 << 30 else _dense(t[rest], rank[rest + 1])
    rest = rest[np.argsort(keys, kind="stable")]
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    pair = _dense(np.concatenate([t[first], t[rest]]), np.concatenate([rank[first + 1], rank[rest + 1]]))
    before = np.searchsorted(pair[: len(first)], pair[len(first) :])
    triple = _dense(*[np.concatenate([x[second + i], x[rest + i]]) for x, i in ((t, 0), (t, 1), (rank, 2))])
    before = before + np.searchsorted(triple[: len(second)], triple[len(second) :])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def _solve(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    m, seg, did, sub, start = (table.column(c).to_numpy() for c in ("m", "seg", "did", "sub", "start"))
    content = table.column("content").to_pylist()
    length = np.array([len(c) for c in content])
    at = np.cumsum(length + 1) - length - 1  # a separator behind each segment
    raw = np.frombuffer(b"\0".join(content) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 2
    ends = at + length
    s[ends] = 1
    valid = np.zeros(len(s) + 1, np.int8)
    valid[at] += 1
    valid[ends - window + 1] -= 1
    valid = np.cumsum(valid, dtype=np.int8)[:-1] > 0
    order = suffix_array(s)
    order = order[valid[order]]  # windows only, in suffix order
    same = np.zeros(len(order), bool)  # as the window before
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    for i in range(1, len(order), 1 << 15):
        a = order[i - 1 : i - 1 + (1 << 15)]
        b = order[i : i + (1 << 15)]
        a = a[: len(b)]
        same[i : i + len(b)] = (views[a] == views[b]).all(1)
    which = np.searchsorted(at, order, "right") - 1
    place = start[which] + order - at[which]
    by = np.lexsort((place, sub[which], did[which]))
    rank = np.empty(len(order), np.int64)
    rank[by] = np.arange(len(order))
    heads = np.flatnonzero(~same)
    lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(order)))) if len(order) else rank
    first = by[lowest]
    back = np.argsort(order)  # windows by segment and offset again
    own, to_did, to_sub, to_place = order[back], did[which][first][back], sub[which][first][back], place[first][back]
    seg_of = which[back]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1] + 1) | (to_did[1:] != to_did[:-1]) | (to_sub[1:] != to_sub[:-1]) | (to_place[1:] != to_place[:-1] + 1) | (seg_of[1:] != seg_of[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(own)))
    k = seg_of[head]
    columns = (m[k], seg[k], own[head] - at[k], size, to_did[head], to_sub[head], to_place[head])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=ANSWERS)


def spec(window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> Spec:
    table = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)
    code = lambda b: table[np.frombuffer(b, np.uint8)]
    return Spec(window, gram, True, str.encode, code, bytes, 1, code, most)


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, cuts) of every row: cuts holds byte ranges to remove, unmerged, or null."""
    return removals(docs, spec(window, gram, most), lambda t: _solve(t, window), "bytes", id_col, text_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for did, text, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw, gone, at = text.as_py().encode(), merged(cuts.as_py()), 0
                kept = hashlib.sha256()
                for a, e in gone:
                    kept.update(raw[at:a])
                    at = e
                kept.update(raw[at:])
                for to, x in zip(out, (did, len(raw), sum(e - a for a, e in gone), len(gone), kept.hexdigest()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_bytes(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
