"""Language identification: word-first backoff.

Known words score by their log frequency in each language; a word the model has not seen falls back to
its character n-grams, from the longest order down to the first of which some are known.
The model is fitted on a bounded sample: at most SAMPLE_DOCS expected rows of each language, chosen by a hash of the id;
one in CALIBRATION of them is not counted but tells how much of its own language such a text supports.
Of each language the WORDS most frequent words and GRAMS most frequent n-grams of each order are kept, fewer if more than CELLS
numbers a table came out, so what is broadcast is bounded by these parameters (and MAX_LANGS). Prediction reads whole texts.

The score is the smaller of two numbers: the winner's share of the likelihoods, and its support, which is the share of the
text's letters that stand in words known in that language; an unseen word counts by the share of its n-grams of the longest
known order n, times (n / 6) squared. Support is divided by what the language's calibration rows have on average. So a language
nobody labelled, program text or keyboard junk scores low, although one of the languages always wins.

Defined results: 'und' with score 0 where the text is null or has no letter, or where no row is labelled;
equal scores go to the first language in order; rows that repeat an id are predicted one by one; an empty
table gives an empty result; other columns are passed through or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.llm.common import documents, materialize

SAMPLE_DOCS, WORDS, GRAMS, ORDERS, MAX_LANGS = 4000, 100_000, 30_000, (5, 4, 3, 2, 1), 1000
CALIBRATION, CELLS = 8, 64_000_000
SMOOTH, MEMO, LEAST_TYPICAL = 0.5, 100_000, 0.05
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case words; empty if no character is a letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(word: str, n: int) -> list[str]:
    w = f"\x02{word}\x03" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    tables: dict[int, tuple[dict[str, int], np.ndarray]]  # by order, 0 for words
    floors: dict[int, np.ndarray]  # by order: above this a language has the word or n-gram
    typical: np.ndarray  # support of a text of the language, for each

    def unseen(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies and support of a word that no language has."""
        for n in ORDERS:
            ids, logs = self.tables[n]
            own = grams(word, n)
            if known := [ids[g] for g in own if g in ids]:
                rows = logs[known]
                return rows.mean(0), (rows > self.floors[n]).sum(0) / len(own) * (n / 6) ** 2
        return np.zeros(len(self.langs)), np.zeros(len(self.langs))

    def scores(self, words: list[str], memo: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood and support of the words for each language."""
        ids, logs = self.tables[0]
        total, held, counts = np.zeros(len(self.langs)), np.zeros(len(self.langs)), Counter(words)
        known = [(ids[w], c, c * len(w)) for w, c in counts.items() if w in ids]
        if known:
            at, times, size = zip(*known, strict=True)
            rows = logs[list(at)]
            total += np.asarray(times, float) @ rows
            held += np.asarray(size, float) @ (rows > self.floors[0])
        for w, c in counts.items():
            if w not in ids:
                if (row := memo.get(w)) is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    row = memo[w] = self.unseen(w)
                total += c * row[0]
                held += c * len(w) * row[1]
        return total, held / sum(map(len, words))

    def predict(self, text: str | None, memo: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[str, float]:
        words = letters(text)
        if not words or not self.langs:
            return "und", 0.0
        total, held = self.scores(words, memo)
        best = int(total.argmax())
        share = 1 / np.exp(total - total[best]).sum()
        return self.langs[best], float(min(share, held[best] / self.typical[best]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        out: Counter[tuple[str, int, str]] = Counter()
        for (lang, word), c in counts.items():
            out[lang, 0, word] += c
            for n in ORDERS:
                for g in grams(word, n):
                    out[lang, n, g] += c
        counts.clear()
        if out:
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys]), pa.array(list(out.values()), pa.int64())], names=["lang", "n", "gram", "c"])

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            counts.update((lang.as_py(), w) for w in letters(text.as_py()))
            if len(counts) > 200_000:
                yield from flush()
    yield from flush()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows; rows whose text or language is null are ignored."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {}, np.ones(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (share[F.col("lang")] * float(1 << 30))
    counted_part = F.lit(1 - 1 / CALIBRATION)
    counted = rows.where(place < counted_part).select("text", "lang").mapInArrow(_count, "lang string, n int, gram string, c long")
    counts = counted.groupBy("n", "lang", "gram").agg(F.sum("c").alias("c"))
    words, some = (max(1, min(most, CELLS // len(langs) ** 2)) for most in (WORDS, GRAMS))
    order = Window.partitionBy("n", "lang").orderBy(F.desc("c"), "gram")
    ranked = counts.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= max(words, some))
    kept = materialize(ranked.where(F.col("__at") <= F.when(F.col("n") == 0, words).otherwise(some)).drop("__at"), "grams")
    tables, floors, index = {}, {}, {lang: i for i, lang in enumerate(langs)}
    for n in (0, *ORDERS):
        table = kept.where(F.col("n") == n).toArrow()
        names = sorted(set(table.column("gram").to_pylist()))
        at = {g: i for i, g in enumerate(names)}
        c = np.zeros((len(names), len(langs)), np.float32)
        c[[at[g] for g in table.column("gram").to_pylist()], [index[x] for x in table.column("lang").to_pylist()]] = table.column("c").to_numpy()
        below = np.log(c.sum(0, dtype=float) + SMOOTH * (len(names) + 1)).astype(np.float32)
        tables[n] = (at, np.log(c + np.float32(SMOOTH)) - below)
        floors[n] = np.float32(np.log(SMOOTH) + 0.1) - below
    model = Model(langs, tables, floors, np.ones(len(langs)))
    rest = rows.where((place >= counted_part) & (place < 1.0))
    for lang, typical in _supports(rest, model).groupBy("lang").agg(F.avg("held")).collect():
        model.typical[index[lang]] = max(LEAST_TYPICAL, typical)
    return model


def _supports(rows: DataFrame, model: Model) -> DataFrame:
    """(lang, held): how far each labelled text supports its own language; texts without letters are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        index = {lang: i for i, lang in enumerate(m.langs)}
        for b in batches:
            got = [(lang.as_py(), w) for text, lang in zip(b.column(0), b.column(1), strict=True) if (w := letters(text.as_py()))]
            held = [float(m.scores(w, memo)[1][index[lang]]) for lang, w in got]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array(held, pa.float64())], names=["lang", "held"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, held double")


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with two columns more: the predicted language and the score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        m = held.value
        for b in batches:
            got = [m.predict(x.as_py(), memo) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*b.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text"))
    return identify(rows, model, score="score").select("doc_id", "held_out", "lang_pred", "score")
