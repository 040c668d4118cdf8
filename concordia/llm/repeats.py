"""Repeated windows of tokens across a corpus, found exactly and without comparing all pairs.

A window's smallest gram hash depends on the window alone, so equal windows have the same one: it is their
shard. Neighbouring windows with the same smallest hash make a run, whose tokens are a segment. Steps:

1. count shard values (narrow rows, combined before the shuffle); those met once hold no repeat;
2. keep the runs of the others, and reduce equal segments to the place of the first (so a passage with very
   many copies is one row a task before the shuffle);
3. shards with a single segment are settled: each window's first place is in the first segment. The others
   (edges of copies, overlaps) are solved exactly by the operator's own index over the shard's segments;
4. a shard whose segments hold more than Spec.most tokens (a common phrase in very many contexts) is not solved at
   once: its segments are cut again by the smallest of longer grams, and in the end by whole windows, until each part is small;
5. every run meets its segment's solution by a join (its hot keys are left to AQE's skew split); windows that
   start earlier elsewhere become spans of their document.

A document is an id with a text, so nothing is ever cut from a row because of another row's id. Rows that repeat an id
and a text are one document and are treated alike. Of documents with one id, or none, the one whose text has the smaller hash comes
first; documents without an id come behind all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import materialize, partitions, whole_text

LAST_ID = (1 << 63) - 1
#: Windows in a run, tokens handled at once, bytes of whole shards that are solved at once.
LONGEST_RUN, BATCH, SOLVED = 256, 1 << 18, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Spec:
    """window, gram: in tokens. units: a text's tokens as raw items; code: items as uint64; within: a document's own
    earlier windows count as well; raw: items as the bytes of a segment, width for each; load: these as uint64;
    most: tokens of a shard that is solved at once."""

    window: int
    gram: int
    within: bool
    units: Callable[[str], object]
    code: Callable[[object], np.ndarray]
    raw: Callable[[object], bytes]
    width: int
    load: Callable[[bytes], np.ndarray]
    most: int

    def finer(self) -> Spec | None:
        """The next way to cut shards: by longer grams, in the end by whole windows."""
        if self.gram == self.window:
            return None
        return replace(self, gram=(self.gram + self.window) // 2 if 2 * self.gram < self.window else self.window)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Runs:
    """Runs of windows with one smallest gram hash, for concatenated documents."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BATCH * 2)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INVERSE, self.size)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(32))
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def find(self, tokens: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """at, length: extents of the documents. Returns shard, segment hash, first token, windows, repeats-itself."""
        w, k = self.spec.window, self.spec.gram
        n, m = len(tokens), w - k + 1
        none = np.empty(0, np.int64)
        if n < w:
            return none, none, none, none, none
        self._grow(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * self.up[:n], out=prefix[1:])
        gram = self._mix((prefix[k:] - prefix[:-k]) * self.down[: n - k + 1])
        # Smallest of m neighbours: running minima from the left and the right of blocks of m.
        pad = -len(gram) % m
        blocks = np.concatenate([gram, np.full(pad, ~np.uint64(0))]).reshape(-1, m)
        left = np.minimum.accumulate(blocks, 1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        low = np.minimum(right[: n - w + 1], left[m - 1 : m - 1 + n - w + 1])
        fits = length >= w
        edge = np.zeros(n + 2, np.int8)
        edge[at[fits]] += 1
        edge[at[fits] + length[fits] - w + 1] -= 1
        valid = np.cumsum(edge, dtype=np.int8)[: n - w + 1] > 0
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        size = last - first + 1
        if len(size) and size.max() > LONGEST_RUN:
            cuts = -(-size // LONGEST_RUN)
            step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first, last = np.repeat(first, cuts) + step * LONGEST_RUN, np.repeat(last, cuts)
            size = np.minimum(last - first + 1, LONGEST_RUN)
        shard = low[first]
        segment = self._mix((prefix[first + size + w - 1] - prefix[first]) * self.down[first]) + np.uint64(1) * size.astype(np.uint64)
        own = np.zeros(len(first), np.int64)
        if self.spec.within and len(first):
            span = size + m - 1
            begin = np.cumsum(span) - span
            places = np.arange(span.sum()) + np.repeat(first - begin, span)
            own = (np.add.reduceat((gram[places] == np.repeat(shard, span)).astype(np.int32), begin) > 1).astype(np.int64)
        return shard.view(np.int64), segment.view(np.int64), first, size, own


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    for b in batches:
        for did, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            yield did, sub, text.as_py()


def _table(columns: dict[str, object], binary: str | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == binary else pa.int64()) for c, x in columns.items()], names=list(columns))


RUNS = ["m", "seg", "did", "sub", "start", "size", "own"]


def runs(rows: DataFrame, spec: Spec) -> DataFrame:
    """(m, seg, did, sub, start, size, own) of every run of rows (did, sub, text)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Runs(spec)
        held: list[tuple[int, int, int, np.ndarray]] = []  # document (two numbers), its first token here, tokens

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                length = np.array([len(h[3]) for h in held])
                at = np.cumsum(length) - length
                m, seg, first, size, own = finder.find(np.concatenate([h[3] for h in held]), at, length)
                which = np.searchsorted(at, first, "right") - 1
                did, sub, begin = (np.array([h[i] for h in held], np.int64) for i in range(3))
                held.clear()
                if len(first):
                    yield _table(dict(zip(RUNS, (m, seg, did[which], sub[which], first - at[which] + begin[which], size, own), strict=True)))

        total = 0
        for did, sub, text in _documents(batches):
            units = spec.units(text)
            for at in range(0, len(units) - spec.window + 1, BATCH):  # long documents in parts that overlap by a window
                tokens = spec.code(units[at : at + BATCH + spec.window - 1])
                held.append((did, sub, at, tokens))
                total += len(tokens)
                if total >= BATCH:
                    yield from flush()
                    total = 0
        yield from flush()

    return rows.mapInArrow(search, ", ".join(f"{c} long" for c in RUNS))


PLACED = ["m", "seg", "did", "sub", "start", "large"]
_CONTENT = ", ".join(f"{c} long" for c in PLACED) + ", content binary"


def segments(rows: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """wanted (m, seg, did, sub, start, large, size) with the segments' tokens as bytes, read from rows (did, sub, text)."""
    lists = wanted.groupBy(F.col("did").alias("__did"), F.col("sub").alias("__sub")).agg(F.collect_list(F.struct("m", "seg", "start", "large", "size")).alias("cuts"))
    held = rows.join(lists, (F.col("did") == F.col("__did")) & (F.col("sub") == F.col("__sub"))).select("did", "sub", "text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for did, sub, text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if (did, sub) == last:  # a row that repeats the one before
                    continue
                last, units = (did, sub), spec.units(text.as_py())
                for c in cuts.as_py():
                    for to, x in zip(out, (c["m"], c["seg"], did, sub, c["start"], c["large"], spec.raw(units[c["start"] : c["start"] + c["size"] + spec.window - 1])), strict=True):
                        to.append(x)
            yield _table(dict(zip([*PLACED, "content"], out, strict=True)), "content")

    return held.mapInArrow(cut, _CONTENT)


PARTS = ["pm", "pseg", "poff", *RUNS]


def recut(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """Segments (m, seg, did, sub, start, .., content) cut into runs by spec's grams: PARTS and content.

    pm, pseg: the segment; poff: the run's first window there. The new shard value holds the old one.
    """
    finder = Runs(spec)
    last = spec.gram == spec.window  # then a shard is one window, which needs no content any more
    for b in batches:
        if not b.num_rows:
            continue
        pm, pseg, did, sub, start = (b.column(c).to_numpy(zero_copy_only=False) for c in PLACED[:5])
        content = b.column("content").to_pylist()
        tokens = [spec.load(c) for c in content]
        length = np.array([len(t) for t in tokens])
        at = np.cumsum(length) - length
        m, seg, first, size, own = finder.find(np.concatenate(tokens), at, length)
        which = np.searchsorted(at, first, "right") - 1
        off = first - at[which]
        m = finder._mix(m.view(np.uint64) ^ finder._mix(pm[which].view(np.uint64) + np.uint64(1))).view(np.int64)
        piece = [None if last else content[w][o * spec.width : (o + n + spec.window - 1) * spec.width] for w, o, n in zip(which.tolist(), off.tolist(), size.tolist(), strict=True)]
        yield _table(dict(zip([*PARTS, "content"], (pm[which], pseg[which], off, m, seg, did[which], sub[which], start[which] + off, size, own, piece), strict=True)), "content")


def shard_groups(batches: Iterator[pa.RecordBatch], least: int = SOLVED) -> Iterator[pa.Table]:
    """Rows in order of m, as tables of whole shards with little over least bytes of content, or a single larger shard."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        m = b.column(0).to_numpy()
        total = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("content")).to_numpy())])
        edges = (np.flatnonzero(m[1:] != m[:-1]) + 1).tolist()
        begin = 0
        for e in ([0] if held and m[0] != last else []) + edges:
            if size + total[e] - total[begin] >= least:
                yield pa.Table.from_batches([*held, b.slice(begin, e - begin)])
                held, size, begin = [], 0, e
        held.append(b.slice(begin))
        size, last = size + int(total[-1] - total[begin]), m[-1]
    if held:
        yield pa.Table.from_batches(held)


ANSWERS = ["m", "seg", "off", "size", "at_did", "at_sub", "at_start"]


def _found(off: Column, n: Column, did: Column, sub: Column, start: Column) -> Column:
    return F.struct(off.cast("long").alias("off"), n.cast("long").alias("n"), did.alias("at_did"), sub.alias("at_sub"), start.alias("at_start"))


def answered(runs: DataFrame, answers: DataFrame, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """runs (m, seg, ..) with found, all answers to their segment, where of holds for one of them at least: a row for each run.

    answers: (m, seg, found). A segment has at most LONGEST_RUN windows, so found has no more elements.
    """
    whole = answers.groupBy(F.col("m").alias("__m"), F.col("seg").alias("__seg")).agg(F.flatten(F.collect_list("found")).alias("found"))
    same = (F.col("m") == F.col("__m")) & (F.col("seg") == F.col("__seg"))
    return runs.join(whole, same & F.exists("found", of) if of else same)


def _firsts(found: DataFrame, label: str) -> DataFrame:
    """Runs reduced to the first place of each (m, seg)."""
    distinct = found.groupBy("m", "seg").agg(F.min(F.struct("did", "sub", "start")).alias("f"), F.max("size").alias("size"), F.max("own").alias("own"))
    return materialize(distinct.select("m", "seg", "f.did", "f.sub", "f.start", "size", "own"), label)


def settle(distinct: DataFrame, fetch: Callable[[DataFrame], DataFrame], spec: Spec, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], label: str) -> DataFrame:
    """(m, seg, found) for the windows of distinct segments (a table), a segment in several rows: n windows from off on first start at (at_did, at_sub, at_start ...).

    fetch: wanted segments with their content.
    """
    finer = spec.finer()
    if finer is None:  # whole windows: all of a shard are one, and all but the first of a run have one before
        first = distinct.groupBy(F.col("m").alias("__m")).agg(F.min(F.struct("did", "sub", "start")).alias("f"))
        parts = F.array(*[_found(F.lit(off), n, F.col("f.did"), F.col("f.sub"), F.col("f.start")) for off, n in ((0, F.lit(1)), (1, F.col("size") - 1))])
        return distinct.join(first, F.col("m") == F.col("__m")).select("m", "seg", F.filter(parts, lambda x: x["n"] > 0).alias("found"))
    spark = distinct.sparkSession
    tokens = F.sum(F.col("size") + F.lit(spec.window - 1))
    mixed = distinct.groupBy("m").agg(F.count("*").alias("c"), F.max("own").alias("o"), (tokens > spec.most).cast("long").alias("large"))
    mixed = materialize(mixed.where("c > 1 OR o > 0").select(F.col("m").alias("__m"), "large"), f"{label}-mixed")
    same = distinct.m == F.col("__m")
    plain = distinct.join(mixed, same, "left_anti").select("m", "seg", F.array(_found(F.lit(0), F.col("size"), F.col("did"), F.col("sub"), F.col("start"))).alias("found"))
    columns = [*ANSWERS, *[c for c in PARTS if c not in ANSWERS]]

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        held = dict(zip(b.schema.names, b.columns, strict=True))
        none = {c: pa.nulls(b.num_rows, pa.int64()) for c in columns} | {"content": pa.nulls(b.num_rows, pa.binary())}
        return pa.RecordBatch.from_arrays(list((none | held).values()), names=list(none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, rest = iter(batches), []

        def first() -> Iterator[pa.RecordBatch]:  # those of large shards come last
            for b in batches:
                small = int((b.column("large").to_numpy() == 0).sum())
                if small:
                    yield b.slice(0, small)
                if small < b.num_rows:
                    rest.append(b.slice(small))
                    return

        for shards in shard_groups(first()):
            yield from map(whole, solve(shards))
        yield from map(whole, recut(chain(rest, batches), finer))

    # A large shard's segments are cut again wherever they lie, so they are dealt over all tasks.
    spread = F.when(F.col("large") > 0, F.pmod("seg", F.lit(partitions(spark)))).otherwise(F.lit(0))
    dealt = fetch(distinct.join(mixed, same)).repartition(partitions(spark), "m", spread).sortWithinPartitions("large", "m")
    done = materialize(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", content binary"), f"{label}-solved")
    out = plain.unionAll(done.where("pm IS NULL").select("m", "seg", F.array(_found(*map(F.col, ANSWERS[2:]))).alias("found")))
    parts = done.where("pm IS NOT NULL").select(*PARTS, "content")
    if not parts.isEmpty():
        inner = settle(_firsts(parts, f"{label}-segments"), lambda wanted: wanted.select(*PLACED).join(parts, PLACED[:5]).select(*PLACED, "content"), finer, solve, label)
        lifted = F.transform("found", lambda x: x.withField("off", x["off"] + F.col("poff")))
        out = out.unionAll(answered(parts.drop("content"), inner).select("pm", "pseg", lifted))
    return out


def spans(rows: DataFrame, spec: Spec, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], label: str) -> DataFrame:
    """(did, sub, cuts): for each document with repeats, [a, b) token ranges that windows met earlier cover.

    solve gets segments (m, seg, did, sub, start, content), whole shards each, and returns ANSWERS for their windows.
    """
    found = runs(rows, spec)
    if spec.within:
        shared = found.groupBy("m").agg(F.sum(F.col("own") + 1).alias("c")).where("c > 1").select(F.col("m").alias("__m"))
    else:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("did", "sub") for f in (F.min, F.max)]
        shared = found.groupBy("m").agg(*ends).where("min_did < max_did OR min_sub < max_sub").select(F.col("m").alias("__m"))
    kept = materialize(found.join(shared, F.col("m") == F.col("__m")).drop("__m"), f"{label}-runs")
    answers = settle(_firsts(kept, f"{label}-segments"), lambda wanted: segments(rows, wanted, spec), spec, solve, label)

    def earlier(x: Column) -> Column:
        one = x["at_did"] == F.col("did")
        before = (x["at_did"] < F.col("did")) | (one & (x["at_sub"] < F.col("sub")))
        return before | (one & (x["at_sub"] == F.col("sub")) & (x["at_start"] < F.col("start") + x["off"])) if spec.within else before

    met = answered(kept, answers, earlier)
    cut = F.transform(F.filter("found", earlier), lambda x: F.struct((F.col("start") + x["off"]).alias("a"), (F.col("start") + x["off"] + x["n"] + spec.window - 1).alias("b")))
    return met.select("did", "sub", cut.alias("r")).groupBy("did", "sub").agg(F.flatten(F.collect_list("r")).alias("cuts"))


def removals(docs: DataFrame, spec: Spec, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], label: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, cuts) of every row; cuts: the ranges to remove, unmerged, or null."""
    rows = ident(docs, id_col, text_col)
    found = spans(rows.where(F.octet_length("text") >= spec.window).select("did", "sub", "text"), spec, solve, label)
    found = found.select(F.col("did").alias("__did"), F.col("sub").alias("__sub"), "cuts")
    return rows.join(found, (F.col("did") == F.col("__did")) & (F.col("sub") == F.col("__sub")), "left").select("doc_id", "text", "cuts")


def merged(cuts: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of what the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted((c["a"], c["b"]) for c in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def ident(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, did, sub, text): did and sub tell documents apart and order them, those without an id last."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("did"), F.when(F.col("doc_id").isNull(), half).otherwise(-1 - half).alias("sub"), "text")
