"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are parted by a hash of their id into three: the first learns a lexicon (words far commoner in toxic texts), the
second trains the trees on features of whole texts, the third fits the calibration. The lexicon also learns word beginnings
("abc*"), so that inflected and compound forms of an insult count together; a word weighs what its strongest entry weighs. At most SAMPLE labelled rows of each label
are used, chosen by a hash of the id; all else reads every row. The trees and the calibration are trained and applied by Spark.

Features of a text: densities of the learned and of the general lexicon, the strongest word, words of a lexicon near a second
person, obfuscated words of a lexicon (letters exchanged for digits or signs, or split by signs), shares of capitals, of words in
capitals, of punctuation, of ! and ?, of obfuscated words, the longest run of a character, and the number of words.

The score is the calibrated probability; inside a step of the calibration, BLEND of it follows the trees' own probability.

Defined results: a null text is empty; an empty text is scored by its (zero) features; very long texts are read whole, one at a
time; repeated rows and ids are scored one by one; without labelled rows of both labels, every score is the share of toxic ones
(0 without any); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import documents, materialize

SAMPLE, LEXICON, SUPPORT, LEAST_Z, STEMS, MEMO = 20_000, 2000, 3, 4.0, range(3, 9), 100_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 7
NEAR, BLEND, TOXIC = 5, 0.001, 0.7
#: Few rows of a label in a part: then all three parts are the whole.
LEAST_ROWS = 30

# A general lexicon of insults, and words of the second person.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns imbecile fool jerk creep freak pig vermin filth filthy scumbag bastard bitch asshole shit crap fuck fucking damn"
    " dämlich trottel idiotin arschloch depp abschaum wertlos crétin imbécile connard ordure minable estúpido basura imbécil inútil escoria".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta vous votre tú ti usted ustedes vosotros".split())
FOLDS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

_WORD = re.compile(r"[^\W\d_]+")
#: A letter beside a digit or a sign that stands for one; letters apart by one sign; letters apart by spaces.
_MIXED = re.compile(r"[^\W\d_][@$!|€*\d]|[@$!|€*\d][^\W\d_]")
_PARTED = re.compile(r"(?:[^\W\d_][.\-*_]){2,}[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
EDGES = ".,;:!?\"'()[]{}<>*-_%&#~`/\\|+=«»„“”‘’…¿¡"
N_FEATURES = 14
_ASCII_LETTERS = [*range(65, 91), *range(97, 123)]
_ASCII_SIGNS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]


def spread(word: str) -> str:
    """An obfuscated word, read as plain letters."""
    return re.sub(r"[\W\d_]+", "", word.lower().translate(FOLDS))


def token_words(token: str) -> tuple[list[str], str]:
    """Lower-case words of a token between white space, and what it spells if it is obfuscated (else the empty string)."""
    core = token.rstrip(EDGES + "$").lstrip(EDGES)
    if core.isalpha():
        return [core.lower()], ""
    return _WORD.findall(core.lower()), spread(core) if _MIXED.search(core) or _PARTED.fullmatch(core) else ""


def entries(word: str) -> list[str]:
    """What a lexicon may hold of a word: the word, and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k <= len(word))]


#: weight, words of the learned lexicon, of the general one, in capitals, of the second person, obfuscated, obfuscated words of a lexicon
Told = tuple[float, int, int, int, int, int, int]


class Tokens(dict[str, Told | None]):
    """What tokens say, None for plain words; remembers what it was asked, up to MEMO tokens."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        return max((self.lexicon[e] for e in entries(word) if e in self.lexicon), default=0.0)

    def __missing__(self, token: str) -> Told | None:
        words, hidden = token_words(token)
        weights = [self.weight(w) for w in words]
        loud = len(token) > 1 and token.isupper() and any(len(w) > 1 for w in words)
        told = (max(weights, default=0.0), sum(map(bool, weights)), sum(w in INSULTS for w in words), int(loud), int(any(w in YOU for w in words)), int(bool(hidden)), int(hidden in INSULTS or bool(hidden and self.weight(hidden))))
        if len(self) >= MEMO:
            self.clear()
        self[token] = found = told if any(told) else None
        return found


def features(text: str | None, told: Tokens) -> list[float]:
    """Dense features of a whole text."""
    if not text:
        return [0.0] * N_FEATURES
    tokens = text.split()
    counts, n = Counter(tokens), max(len(tokens), 1)
    odd = [(t, c, x) for t, c in counts.items() if (x := told[t])]
    total = [sum(c * x[k] for _, c, x in odd) for k in range(7)]
    hits = {t for t, _, x in odd if x[1] or x[2]}
    hidden, spaced = total[6], 0
    if sum(c for t, c in counts.items() if len(t) == 1) > 2:
        for m in _SPACED.finditer(text):
            word = spread(m[0])
            spaced, hidden = spaced + 1, hidden + (word in INSULTS or told.weight(word) > 0)
    near = 0
    if hits and total[4]:
        marks = {t for t, _, x in odd if x[4]}
        you, k = [i for i, t in enumerate(tokens) if t in marks], 0
        for i in (i for i, t in enumerate(tokens) if t in hits):
            while k + 1 < len(you) and abs(you[k + 1] - i) <= abs(you[k] - i):
                k += 1
            near += abs(you[k] - i) <= NEAR
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    of = np.bincount(raw, minlength=256)
    wide = of[0xC3 : 0xF5].sum()  # characters beyond ASCII count as letters
    capitals = of[65:91].sum() + np.count_nonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E))
    ends = np.flatnonzero(raw[1:] != raw[:-1])
    run = np.diff(np.concatenate(([-1], ends, [len(raw) - 1]))).max()
    return [
        total[0] / n, 100 * total[1] / n, math.log1p(total[1]), max((x[0] for _, _, x in odd), default=0.0), 100 * total[2] / n, math.log1p(total[2]), math.log1p(near), math.log1p(hidden),
        100 * (total[5] + spaced) / n, float(capitals / max(of[_ASCII_LETTERS].sum() + wide, 1)), total[3] / n, float(of[_ASCII_SIGNS].sum() / len(raw)), float(100 * (of[33] + of[63]) / len(raw)), math.log1p(float(run)) + math.log1p(n) / 100,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    share: float


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, texts): in how many texts of a task each word and beginning is, by label."""
    counts: Counter[tuple[str, int]] = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "toxic", "texts"])
        counts.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words: set[str] = set()
            for token in set(text.as_py().split()):
                plain, hidden = token_words(token)
                words.update(plain, [hidden] if hidden else [])
            counts.update((e, toxic) for e in {e for w in words for e in entries(w)})
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def learn_lexicon(rows: DataFrame, most: int = LEXICON, support: int = SUPPORT, least_z: float = LEAST_Z) -> dict[str, float]:
    """Log odds of at most `most` words and beginnings that are in toxic texts far more often than in others.

    rows: (text, toxic). Equal texts count once.
    """
    rows = materialize(rows.groupBy(F.sha2("text", 256).alias("same")).agg(F.max(F.struct("toxic", "text")).alias("x")).select("x.text", "x.toxic"), "texts")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(_distinct_words, "word string, toxic int, texts long").groupBy("word").agg(F.sum(F.expr("CASE toxic WHEN 1 THEN texts ELSE 0 END")).alias("a"), F.sum(F.expr("CASE toxic WHEN 0 THEN texts ELSE 0 END")).alias("b"))
    # log odds with a half added to each count, and their standard deviation
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    wide = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    z = odds / wide
    best = counts.where((F.col("a") >= support) & (z >= min(least_z, 2 + math.log10(toxic)))).select("word", odds.alias("odds"), z.alias("z")).orderBy(F.desc("z"), "word").limit(most)
    return {r["word"]: r["odds"] for r in best.collect()}


def with_features(rows: DataFrame, lexicon: dict[str, float], text_col: str = "text", name: str = "features") -> DataFrame:
    """rows with an array of features in place of the text column."""
    held, others = rows.sparkSession.sparkContext.broadcast(lexicon), [c for c in rows.columns if c != text_col]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Tokens(held.value)
        for b in batches:
            got = pa.array([features(x.as_py(), told) for x in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], got], names=[*others, name])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), f"`{name}` array<double>"])
    return rows.select(text_col, *others).mapInArrow(run, schema)


def draw(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of about `sample` documents of each label, and how many documents have each label.

    What is drawn is known from ids alone: some 2 * sample ids at most are broadcast, and only their texts are shuffled. Of rows
    that repeat an id, the smallest text is drawn. Rows with a null id or text, or a label other than 0 and 1, are ignored.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct()
    known = materialize(ids.join(marks, "doc_id"), "known")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), sizes


def fit(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> Model:
    """Fit on docs (doc_id, text) that have labels (doc_id, toxic)."""
    drawn, sizes = draw(docs, labels, sample)
    if len(sizes) < 2:
        return Model({}, None, None, float(1 in sizes))
    weight = F.when(F.col("toxic") == 1, max(1.0, sizes[1] / sample)).otherwise(max(1.0, sizes[0] / sample))
    rows = materialize(drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))).withColumn("weight", weight.cast("double")), "labelled")
    least = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    parted = len(least) == 2 and min(least.values()) >= 3 * LEAST_ROWS
    part = lambda k: rows.where(F.col("part") == k) if parted else rows
    lexicon = learn_lexicon(part(0))
    told = materialize(with_features(part(1).select("text", "toxic", "weight", "part") if not parted else rows.where("part > 0").select("text", "toxic", "weight", "part"), lexicon), "features")
    told = told.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("toxic").cast("double"))
    chosen = lambda k: told.where(F.col("part") == k) if parted else told
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxMemoryInMB=64, checkpointInterval=-1).fit(chosen(1))
    raw = model.transform(chosen(2)).withColumn("raw", vector_to_array("probability")[1]).select("raw", "label", "weight")
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return Model(lexicon, model, steps, sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs without the text, with the probability (0 to 1) that it is toxic; the other columns stay under their names."""
    if model.trees is None or model.steps is None:
        return docs.drop(text_col).withColumn(name, F.lit(model.share))
    others = [c for c in docs.columns if c != text_col]
    plain = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"col{i}") for i, c in enumerate(others)])
    told = with_features(plain, model.lexicon).withColumn("vector", array_to_vector("features"))
    raw = model.trees.transform(told).withColumn("raw", vector_to_array("probability")[1])
    steps = model.steps.transform(raw.drop("prediction"))
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - BLEND) * F.col("prediction") + BLEND * F.col("raw")))
    return steps.select(*[F.col(f"col{i}").alias(c) for i, c in enumerate(others)], final.alias(name))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
