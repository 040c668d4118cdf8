"""Packing of tokenised documents into windows: best-fit decreasing over a segment tree of capacities.

A document becomes its token ids and an end id. Overlong documents are cut into full windows first; what remains goes,
longest first, into the tightest open window that has room. The tree's leaves are remaining capacities;
its nodes hold how many open windows lie below. Pieces are dealt by a hash into groups of about GROUP
pieces, each packed by itself, so memory is bounded and every group wastes at most its last windows.

Defined results: null text counts as empty, which leaves the end id alone; very long texts are encoded whole, in parts cut
where the pretokenizer parts as well; pieces of equal length keep the order of doc_id, start; rows that repeat an id are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import documents, materialize

WINDOW, END_ID, GROUP, MEMO, PART = 1024, 0, 1 << 16, 300_000, 1 << 20
#: Anything but single spaces and single line ends between visible characters; such texts are encoded whole.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$|[\x1c-\x1f\x85]")
#: The text of the vocabulary's only special token.
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, with words remembered.

    The pretokenizer always parts before a single space and around a single line end, so a plain text can be
    encoded word by word. Words go through the rank file of the same vocabulary when it is given (the ids
    are equal and it is faster), everything else through the library itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def _ids(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast and _SPECIAL not in text else self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of about PART characters, cut before a space between two ASCII letters, where the pretokenizer parts as well."""
        at = 0
        while len(text) - at > 2 * PART and (m := re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if len(text) > 2 * PART and _SPECIAL not in text:
            return b"".join(self._plain(x) for x in self.parts(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        lead, body = ("", text[1:]) if text[0] == " " else (None, text)
        if not body or _SPECIAL in text or _ODD.search(body):
            return self._ids(text)
        words = body.replace("\n", " \n").split(" ")
        memo = self.words
        first = self._ids(words[0]) if lead is None else self._word(words[0])
        try:
            return first + b"".join([memo[w] for w in words[1:]])
        except KeyError:
            return first + b"".join([memo.get(w) or self._word(w) for w in words[1:]])

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            got = self.words[word] = self._ids(word if word[0] == "\n" else f" {word}")
        return got


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One for each worker process: its words serve the tasks that follow."""
    return Encoder(path, ranks, pattern)


def default_paths() -> dict[str, str]:
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def pieces(docs: DataFrame, tokenizer: dict[str, str] | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows of each document, then its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(**(tokenizer or default_paths())).encode
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    for to, x in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """A segment tree over remaining capacities 0 .. top: counts of open windows."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at, count = capacity + self.size, self.count
        while at:
            count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """Smallest capacity of an open window that is at least need; -1 if there is none."""
        at, count = need + self.size, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece. Equal lengths keep their order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, open_at = CapacityTree(window), [[] for _ in range(window + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        room = tree.tightest(need) if need < window else -1
        if room < 0:
            room, bin_ = window, made
            made += 1
        else:
            bin_ = open_at[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = bin_, window - room
        if room > need:
            open_at[room - need].append(bin_)
            tree.add(room - need, 1)
    return bins, offsets


def pack(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """parts with sequence_id and offset. parts must be cheap to read twice (a table)."""
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        number = table.column("__group").to_numpy() * (1 << 32) + bins
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("__group").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(pieces(documents(spark, sf_dir)), "pieces"))
