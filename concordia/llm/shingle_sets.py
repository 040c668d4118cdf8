"""Shingle sets of texts as 64-bit hashes, their SimHashes and sketches, in Arrow batches.

Each word is hashed once (XXH64, remembered in a bounded table); a shingle's hash is made of its words' hashes for all
places of a text at a time. Texts are cut into words piece by piece, so a very long text needs little more than eight
bytes a word beside itself.

Defined results: A-Z are lower-cased; a text shorter than a shingle is one shingle; null, empty and blank texts have the
one shingle without words, so they are alike; rows of other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Words remembered, bytes of a text that are cut into words at once, hashes counted at once, and hashes in a batch of sets.
MEMO, PIECE, BLOCK, BATCH = 200_000, 1 << 20, 255 * 64, 1 << 20
WORDS = 4  # of 64 parities
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
# The multipliers of the SplitMix64 finaliser and its increment.
_FIRST, _SECOND, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LANES, _SHIFTS = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None]


class WordHashes(dict):
    """Hash of each word asked for; forgets all words when it has MEMO of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str, known: WordHashes) -> np.ndarray:
    data, at, found = text.encode("utf-8", "surrogatepass").lower(), 0, []  # bytes: A-Z only
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of the k-word shingles, sorted; at least one."""
    words = _word_hashes(text or "", known)
    width = min(k, len(words))
    places = len(words) - width + 1
    x = np.full(max(places, 1), width, np.uint64)
    for i in range(width):
        x = _mixed(x + _STEP) + words[i : i + places]
    return np.unique(_mixed(x + _STEP))


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Of each row of hashes: a bit is 1 if over half of them have it set. Eight counters share a word, for up to 255 hashes at a time."""
    rows, n = hashes.shape
    counts = np.zeros((rows, 64), np.int64)
    for at in range(0, n, BLOCK):
        lanes = (hashes[:, None, at : at + BLOCK] >> _SHIFTS) & _LANES
        sums = np.add.reduceat(lanes, np.arange(0, lanes.shape[2], 255), axis=2).astype("<u8")
        counts += sums.view(np.uint8).reshape(rows, 8, -1, 8).sum(2, dtype=np.int64).transpose(0, 2, 1).reshape(rows, 64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8")[:, 0]


def parities(hashes: np.ndarray) -> np.ndarray:
    """WORDS longs: for each value of the low bits, whether an odd number of the hashes has it."""
    odd = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def prints_and_sketches(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """(row, fp0, fp1, .., n, b0 .. b3) of rows (row, text): independent SimHashes of the shingle set, its size and parities.

    The exclusive or of two rows' parities is that of the shingles only one of them has, so it bounds their number from
    below and, unlike a bitmap of the sets, does not fill up as texts grow, only as they differ.
    """
    names = [*[f"fp{p}" for p in range(parts)], "n", *[f"b{i}" for i in range(WORDS)]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        seeds = np.array([(p + 1) * int(_STEP) % (1 << 64) for p in range(parts)], np.uint64)[:, None]
        for batch in batches:
            out = np.empty((batch.num_rows, len(names)), np.int64)
            for at, text in enumerate(batch.column(1)):
                hashes = shingle_set(text.as_py(), k, known)
                out[at] = [*(majority_bits(_mixed(hashes ^ seeds)) if parts else ()), len(hashes), *parities(hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in out.T]], names=["row", *names])

    return rows.select("row", "text").mapInArrow(measure, "row long, " + ", ".join(f"{n} long" for n in names))


def hash_sets(rows: DataFrame, k: int) -> DataFrame:
    """(row, s) of rows (row, text): the shingle set as an array of hashes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            first, held, size = 0, [], 0
            for at, text in enumerate(batch.column(1)):
                held.append(shingle_set(text.as_py(), k, known).view(np.int64))
                size += len(held[-1])
                if size >= BATCH or at == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), sets], names=["row", "s"])
                    first, held, size = at + 1, [], 0

    return rows.select("row", "text").mapInArrow(gather, "row long, s array<long>")
