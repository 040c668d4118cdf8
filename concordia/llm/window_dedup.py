"""Substring deduplication over words: suffix automata of reference shards.

repeats.py narrows the corpus to shards of segments that may share a window of 50 words. Each shard's
distinct segments are its reference: a generalised suffix automaton over them, built in ascending doc_id, whose states know
the smallest document that holds their strings. The segments are streamed through it for matching statistics;
wherever the match reaches the window's length, the state of just that length names the window's first document.
A literal broadcast of the whole corpus' automata has no bound, so a shard's automaton meets only the documents that
share its key.

Defined results: null text has no words; shorter texts than a window lose nothing; documents without an id come behind all
others; of documents with one id, or none, and different texts, the one whose text has the smaller hash counts as the smaller;
rows that repeat an id and a text are one document and lose the same words; very long texts are cut into parts that overlap
by a window, and are joined whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from concordia.llm.common import documents
from concordia.llm.repeats import ANSWERS, Spec, merged, removals

#: In words; MOST: of a shard that is solved at once. NOWHERE: no document.
WINDOW, GRAM, MOST, NOWHERE = 50, 8, 1 << 17, -1


class Automaton:
    """A generalised suffix automaton; texts are added in ascending document order."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NOWHERE]

    def _state(self, edges: dict[int, int], length: int, link: int, first: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, at: int, token: int, to: int) -> int:
        clone = self._state(dict(self.next[to]), self.length[at] + 1, self.link[to], self.first[to])
        self.link[to] = clone
        while at >= 0 and self.next[at].get(token) == to:
            self.next[at][token] = clone
            at = self.link[at]
        return clone

    def add(self, tokens: list[int], document: int) -> None:
        last = 0
        for token in tokens:
            to = self.next[last].get(token)
            if to is not None:  # known already: only the state for exactly this length is needed
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, token, to)
                continue
            new, at = self._state({}, self.length[last] + 1, 0, document), last
            while at >= 0 and token not in self.next[at]:
                self.next[at][token] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][token]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, token, to)
            last = new

    def firsts(self, tokens: list[int], window: int) -> list[int]:
        """For each window of tokens, the smallest document that holds it (NOWHERE: none)."""
        at, matched, out = 0, 0, []
        for i, token in enumerate(tokens):
            while at and token not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if (to := self.next[at].get(token)) is not None:
                at, matched = to, matched + 1
            while self.length[self.link[at]] >= window if at else False:
                at = self.link[at]
                matched = self.length[at]
            if i >= window - 1:
                out.append(self.first[at] if matched >= window else NOWHERE)
        return out


def _solve(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    table = table.sort_by([(c, "ascending") for c in ("m", "did", "sub", "start", "seg")])
    rows = zip(*[table.column(c).to_pylist() for c in ("m", "seg", "did", "sub", "content")], strict=True)
    out: list[list[int]] = [[] for _ in ANSWERS]
    for m, shard in groupby(rows, key=lambda r: r[0]):
        shard = [(seg, (did, sub), np.frombuffer(c, np.uint64).tolist()) for _, seg, did, sub, c in shard]
        documents_ = list(dict.fromkeys(d for _, d, _ in shard))  # in order
        number = {d: i for i, d in enumerate(documents_)}
        reference = Automaton()
        for _, d, tokens in shard:
            reference.add(tokens, number[d])
        for seg, _, tokens in shard:
            off = 0
            for first, same in groupby(reference.firsts(tokens, window)):
                n = sum(1 for _ in same)
                for to, x in zip(out, (m, seg, off, n, *documents_[first], 0), strict=True):
                    to.append(x)
                off += n
        if len(out[0]) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=ANSWERS)
            out = [[] for _ in ANSWERS]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=ANSWERS)


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def spec(window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> Spec:
    return Spec(window, gram, False, lambda text: text.encode().split(), _codes, lambda words: _codes(words).tobytes(), 8, lambda b: np.frombuffer(b, np.uint64), most)


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, cuts) of every row: cuts holds word ranges to remove, unmerged, or null."""
    return removals(docs, spec(window, gram, most), lambda t: _solve(t, window), "words", id_col, text_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for did, text, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words, kept, at, gone = text.as_py().encode().split(), [], 0, 0
                for a, e in merged(cuts.as_py()):
                    kept += words[at:a]
                    at, gone = e, gone + e - a
                kept += words[at:]
                for to, x in zip(out, (did, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated_words(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
