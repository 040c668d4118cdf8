"""Parity audit: fields that the scoped text never mentions, and the verdict of each model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.functions import text

FAIL_COUNT, FAIL_RATIO = 500, 0.5
#: Of a shard of fields that is broadcast and becomes an automaton (some thirty times as large).
MOST_BYTES = 2 << 20


def present(raw: Column, norm: Column, field: Column) -> Column:
    """Whether a text holds a field: as a whole word in any case, or in normalised form (an empty form: never).

    norm: normalize_token(raw). An ASCII field with a normalised form is in norm wherever it is a whole word, so raw is searched only
    for the others: a pattern for each row and field is costly to compile and to run over whole texts.
    """

    def held(bare: Column) -> Column:
        odd = (bare == "") | (F.octet_length(field) != F.length(field)) | raw.isNull()
        return ((bare != "") & F.contains(norm, bare)) | (odd & F.regexp_like(raw, F.concat(F.lit(r"(?i)\b\Q"), field, F.lit(r"\E\b"))))

    return text.let(text.normalize_token(field), held)


def presence(docs: DataFrame, fields: list[str], norm_col: str = "norm", raw_col: str | None = None) -> DataFrame:
    """docs with missing: the fields, in order, that the text does not hold.

    The text is normalised once for all fields; the fields are literals, so nothing is joined. A field with a normalised form is
    in the normalised text wherever it is a whole word, so the raw text is only searched for the others.
    """

    def absent(f: str) -> Column:
        bare = "".join(c for c in f.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        if bare and f.isascii():
            return ~F.contains(F.col(norm_col), F.lit(bare))
        return ~present(F.col(raw_col), F.col(norm_col), F.lit(f)) if raw_col else (text.normalize_token(F.lit(f)) == "") | ~F.contains(F.col(norm_col), text.normalize_token(F.lit(f)))

    return docs.withColumn("missing", F.filter(F.array(*[F.when(absent(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))


def missing_fields(scoped: DataFrame, fields: DataFrame) -> DataFrame:
    """Anti join of fields (extractor, field, ord) with the scoped text (extractor, raw, norm) of their extractor."""
    met = fields.join(scoped.select("extractor", F.col("raw").alias("__raw"), F.col("norm").alias("__norm")), "extractor")
    return met.where(~present(F.col("__raw"), F.col("__norm"), F.col("field"))).select(*fields.columns)


class FieldAutomaton:
    """Aho-Corasick automaton over the normalised forms of a shard of fields; tells the fields that a text does not hold."""

    def __init__(self, fields: list[tuple[str, str]]) -> None:
        self.fields = [f for f, _ in fields]
        self.places: dict[str, list[int]] = {}
        for i, (_, bare) in enumerate(fields):
            if bare:
                self.places.setdefault(bare, []).append(i)
        self.found_by = None
        if self.places:
            self.found_by = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for bare, places in self.places.items():
                self.found_by.add_word(bare, places)
            self.found_by.make_automaton()

    def missing(self, norm: str | None) -> list[str]:
        found: set[int] = set()
        if norm and self.found_by is not None:
            for _, places in self.found_by.iter(norm):
                found.update(places)
        return [f for i, f in enumerate(self.fields) if i not in found]


#: Automata of this worker, by shard: built once for all its tasks.
_BUILT: dict[str, FieldAutomaton] = {}
KEPT_AUTOMATA = 4


def _automaton(name: str, fields: list[tuple[str, str]]) -> FieldAutomaton:
    if name not in _BUILT:
        if len(_BUILT) >= KEPT_AUTOMATA:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = FieldAutomaton(fields)
    return _BUILT[name]


def field_shards(fields: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The distinct fields (field) and their normalised forms, in shards of about most_bytes, one after the other."""
    bare = fields.where("field IS NOT NULL").select("field", text.normalize_token(F.col("field")).alias("bare")).distinct()
    size = bare.agg(F.coalesce(F.sum(F.octet_length("field") + F.octet_length("bare") + 32), F.lit(0))).first()[0]
    parts = -(-size // most_bytes)
    for k in range(parts):
        yield [(r["field"], r["bare"]) for r in bare.where(F.pmod(F.xxhash64("field"), F.lit(parts)) == k).collect()]


def missing_of_table(docs: DataFrame, fields: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, missing): for each row of docs (key, norm) the sorted fields of a table (field) that its normalised text lacks.

    A shard of fields goes to every task, bounded by most_bytes, and becomes one automaton in each worker. A text passes
    once through each shard's automaton, however many fields there are; shards follow each other in the same stage, so no text
    is shuffled. Rows that repeat a key, or have none, stay apart; a null text lacks every field, and a field without a
    normalised form is in no text. No fields: nothing is missing.
    """
    context, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), "norm", F.array().cast("array<string>").alias("missing"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("norm", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType()))])
    for shard in field_shards(fields, most_bytes):
        rows = rows.mapInArrow(_searcher(context.broadcast(shard), uuid.uuid4().hex), schema)
    return rows.select(F.col("key").alias(key), F.array_sort("missing").alias("missing"))


def _searcher(held: Broadcast, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, held.value)
        for b in batches:
            lacks = [before + automaton.missing(norm) for norm, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lacks, pa.list_(pa.string()))], names=["key", "norm", "missing"])

    return search


def status(pages: Column, missing: Column, fields: Column) -> Column:
    ratio = F.coalesce(F.try_divide(missing.cast("double"), fields.cast("double")), F.lit(0.0))
    return F.when(pages == 0, "NOT_IN_DOC").when((missing >= FAIL_COUNT) | (ratio >= FAIL_RATIO), "FAIL").when(missing > 0, "PASS_WITH_WARNINGS").otherwise("PASS")


def summary(audits: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    inside = F.col("status") != "NOT_IN_DOC"
    return audits.agg(count("FAIL"), count("PASS_WITH_WARNINGS"), count("PASS"), count("NOT_IN_DOC"), F.count_if(inside).alias("n_in_doc"), F.coalesce(F.sum(F.when(inside, F.col("n_missing"))), F.lit(0)).cast("long").alias("n_missing"))


def verdict(audits: DataFrame) -> DataFrame:
    """FAIL before PASS_WITH_WARNINGS before PASS, over the models in the document."""
    rank = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "PASS_WITH_WARNINGS", 1).otherwise(0))
    return audits.where("status <> 'NOT_IN_DOC'").agg(rank.alias("r")).select(F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 1, "PASS_WITH_WARNINGS").otherwise("PASS").alias("verdict"))


def top(audits: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    return audits.where("status NOT IN ('PASS', 'NOT_IN_DOC')").orderBy(F.desc("n_missing"), key).limit(n)


def suppress(missing: DataFrame, reference: DataFrame, own: DataFrame) -> DataFrame:
    """Missing fields without those that the flex reference and the extractor's own flex dataset both hold.

    missing (extractor, field), reference (field), own (extractor, field).
    """
    both = own.select("extractor", F.upper("field").alias("__f")).join(reference.select(F.upper("field").alias("__f")).distinct(), "__f", "left_semi").distinct()
    return missing.withColumn("__f", F.upper("field")).join(both, ["extractor", "__f"], "left_anti").drop("__f")


def suppress_in_row(missing: Column, own: Column, reference: Column) -> Column:
    """suppress() on arrays of one row: no shuffle where the extractor's own flex fields are at hand. reference: in upper case."""
    mine = F.array_intersect(F.transform(own, F.upper), reference)
    return text.let(mine, lambda own_: F.filter(missing, lambda f: ~F.array_contains(own_, F.upper(f))))
