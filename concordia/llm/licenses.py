"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are lines and, since notices are wrapped over lines and commented, every run of as many words as the template has.
Templates are whole paragraphs of public licenses, short notices and titles (license_texts); a template may ask for its own share.

Tokens are ordered by how many documents of the whole corpus hold them, rarest first. A template needs
alpha = ceil(share * tokens) of its tokens in a block, so of its tokens - alpha + k rarest at least k must be
there (prefix filter, k half of alpha); the block must have alpha tokens at all (length filter); and from the last common
token of the prefix on, what both have left in that order must fill up the rest of alpha (positional filter). What remains is
counted exactly. Documents are joined like blocks first, since no line or run has more of a template than its document; lines
and runs are made of documents that pass. A run's count is a running sum: an occurrence adds one to every run that has it
as the first of its token, and takes it off again behind, so work grows with the occurrences and not with places times words.
Templates are a parameter; what is collected or broadcast has at most a row for each of their tokens.

Defined results: null text counts as empty (no words, no labels, score 0); a blank line is no block; texts are read whole, however
long; templates that tie all give their labels; rows that repeat an id are scanned one by one; an empty table gives an
empty result; other columns are ignored. A paragraph that licenses share has a label of its own (as-is).
Only built-in functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import documents, materialize, whole_text
from concordia.llm.license_texts import NOTICES, TITLES

THRESHOLD = 0.8
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, text) or (label, text, share), where the share of words replaces the threshold.
TEMPLATES: list[tuple] = [*NOTICES, *[(label, text, 1.0) for label, text in TITLES]]
#: What parts words, in texts whose letters are not lower-cased yet.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Template:
    label: str
    tokens: list[str]  # distinct, rarest first
    alpha: int
    words: int
    counts: list[int]  # of documents, for each token

    @property
    def least(self) -> int:
        """How many tokens of the prefix any block with alpha of the tokens has."""
        return max(1, self.alpha // 2)

    @property
    def prefix(self) -> list[str]:
        return self.tokens[: len(self.tokens) - self.alpha + self.least]


def flat(text: Column) -> Column:
    """The words joined by single spaces, letters as they are."""
    return F.btrim(F.regexp_replace(text, _GAP, " "))


def tokens(text: Column) -> Column:
    return F.split(F.lower(flat(text)), " ")


def word_list(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def token_set(text: str) -> list[str]:
    return list(dict.fromkeys(word_list(text)))


def order_templates(docs: DataFrame, templates: list[tuple], threshold: float, text_col: str = "text") -> list[Template]:
    """Templates with their tokens in ascending document frequency over the whole corpus; ties by name."""
    sets = [(label, token_set(text), len(word_list(text)), share[0] if share else threshold) for label, text, *share in templates]
    wanted = sorted({t for _, s, _, _ in sets for t in s})
    words = docs.select(F.explode(F.array_intersect(F.array(*[F.lit(t) for t in wanted]), tokens(whole_text(text_col)))).alias("t"))
    seen = {r[0]: r[1] for r in words.groupBy("t").count().collect()}
    sets = [(label, sorted(s, key=lambda t: (seen.get(t, 0), t)), n, share) for label, s, n, share in sets if s]
    return [Template(label, s, math.ceil(share * len(s) - 1e-9), n, [seen.get(t, 0) for t in s]) for label, s, n, share in sets]


def _known(ordered: list[Template]) -> Column:
    """The templates' tokens in the one order that each template's own tokens have."""
    return F.array(*[F.lit(t) for _, t in sorted({(n, t) for x in ordered for n, t in zip(x.counts, x.tokens, strict=True)})])


def _prefixes(ordered: list[Template]) -> Column:
    return F.array(*[F.lit(t) for t in sorted({t for x in ordered for t in x.prefix})])


def _table(spark: SparkSession, ordered: list[Template]) -> DataFrame:
    """(template, label, t_size, alpha, t_words, t_tokens), a row for each template."""
    rows = [(n, x.label, len(x.tokens), x.alpha, x.words, x.tokens) for n, x in enumerate(ordered)]
    return spark.createDataFrame(rows, "template int, label string, t_size int, alpha int, t_words int, t_tokens array<string>")


def candidates(blocks: DataFrame, ordered: list[Template], *key: str) -> DataFrame:
    """(*key, template) where no filter rules out that the block's tokens b, in the common order, hold enough of the template's."""
    entries = [(n, len(x.tokens), x.alpha, x.least, t, i) for n, x in enumerate(ordered) for i, t in enumerate(x.prefix)]
    index = blocks.sparkSession.createDataFrame(entries, "template int, t_size int, alpha int, least int, token string, i int")
    seeds = blocks.select(*key, F.size("b").alias("n"), "b", F.explode(F.array_intersect(_prefixes(ordered), F.col("b"))).alias("token"))
    seeds = seeds.select(*key, "n", "token", F.array_position("b", F.col("token")).alias("p"))
    pairs = seeds.join(F.broadcast(index), "token").where("n >= alpha")
    met = pairs.groupBy(*key, "template", "n", "t_size", "alpha", "least").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("p").alias("p"))
    left = F.least(F.col("t_size") - F.col("i") - 1, F.col("n") - F.col("p"))
    return met.where((F.col("k") >= F.col("least")) & (F.col("k") + left >= F.col("alpha"))).select(*key, "template")


def _held(text: Column, ordered: list[Template]) -> Column:
    return F.array_intersect(_known(ordered), tokens(text))


def _promising(b: Column, ordered: list[Template]) -> Column:
    return F.size(F.array_intersect(_prefixes(ordered), b)) >= min((x.least for x in ordered), default=1)


def matching_documents(rows: DataFrame, ordered: list[Template]) -> tuple[DataFrame, DataFrame]:
    """Documents (row, text) that hold enough tokens of a template at all, and for which (row, template)."""
    held = rows.select("row", whole_text("text").alias("text")).withColumn("b", _held(F.col("text"), ordered))
    some = materialize(held.where(_promising(F.col("b"), ordered)), "license-rows")
    pairs = candidates(some, ordered, "row")
    return some.select("row", "text"), materialize(pairs, "license-pairs")


def similar_blocks(rows: DataFrame, pairs: DataFrame, ordered: list[Template]) -> DataFrame:
    """(row, block, label, containment) of every line of rows.text that holds enough of a template's tokens."""
    hit = rows.join(pairs.select("row").distinct(), "row", "left_semi")
    lines = hit.select("row", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    blocks = lines.select("row", "block", _held(F.col("line"), ordered).alias("b")).where(_promising(F.col("b"), ordered))
    met = candidates(blocks, ordered, "row", "block").join(blocks, ["row", "block"]).join(F.broadcast(_table(rows.sparkSession, ordered)), "template")
    share = met.withColumn("o", F.size(F.array_intersect("b", "t_tokens"))).where("o >= alpha")
    return share.select("row", "block", "label", (F.col("o") / F.col("t_size")).alias("containment"))


def similar_runs(rows: DataFrame, pairs: DataFrame, ordered: list[Template]) -> DataFrame:
    """(row, label, containment): for each template, the most of its tokens in a run of as many words of rows.text."""
    spark = rows.sparkSession
    holders = [(t, [n for n, x in enumerate(ordered) if t in x.tokens]) for t in sorted({t for x in ordered for t in x.tokens})]
    holders = spark.createDataFrame(holders, "token string, holders array<int>")
    asked = pairs.groupBy("row").agg(F.collect_set("template").alias("asked"))
    words = rows.join(asked, "row").select("row", "asked", F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    met = words.join(F.broadcast(holders), "token").select("row", "token", "at", F.explode(F.array_intersect("asked", "holders")).alias("template"))
    met = met.join(F.broadcast(_table(spark, ordered).drop("t_tokens")), "template")
    # Runs are told by their first word. Those that begin behind the token's place before this one hold no earlier one.
    before = F.lag("at").over(Window.partitionBy("row", "template", "token").orderBy("at"))
    first = F.greatest(F.coalesce(before + 1, F.lit(-(1 << 31)).cast("long")), F.col("at").cast("long") - F.col("t_words") + 1)
    spans = met.select("row", "template", "label", "t_size", "alpha", first.alias("first"), "at")
    steps = spans.select("row", "template", "label", "t_size", "alpha", F.explode(F.array(F.struct(F.col("first").alias("s"), F.lit(1).alias("d")), F.struct((F.col("at").cast("long") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e"))
    sums = Window.partitionBy("row", "template").orderBy("e.s").rangeBetween(Window.unboundedPreceding, 0)
    best = steps.withColumn("o", F.sum("e.d").over(sums)).groupBy("row", "template", "label", "t_size", "alpha").agg(F.max("o").alias("o"))
    return best.where("o >= alpha").select("row", "label", (F.col("o") / F.col("t_size")).alias("containment"))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase_columns(text: Column, phrases: dict[str, str]) -> list[Column]:
    """n_words, n_base, first_word, last_word and base (array of labels) of the phrases' places.

    No phrase may hold or overlap another. Letters match in either case, A-Z only: (?i) without (?u).
    """
    padded = F.concat(F.lit(" "), flat(text), F.lit(" "))
    n_words = F.when(F.length(F.btrim(padded)) == 0, F.lit(0)).otherwise(_spaces(padded) - 1).cast("long")
    places = f"(?i) (?:{'|'.join(phrases)})(?= )"
    found = F.regexp_like(padded, F.lit(places))
    parts = F.split(padded, places, -1)
    last = F.element_at(F.regexp_extract_all(padded, F.lit(places), F.lit(0)), -1)
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.regexp_like(padded, F.lit(f"(?i) {p} ")), F.lit(v)) for p, v in phrases.items()]), lambda x: x.isNotNull())))
    return [
        n_words.alias("n_words"),
        F.when(found, F.size(parts) - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(found, _spaces(F.element_at(parts, 1))).alias("first_word"),
        F.when(found, n_words - (_spaces(F.element_at(parts, -1)) - 1) - _spaces(last)).alias("last_word"),
        F.when(found, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    ]


def license_scan(docs: DataFrame, templates: list[tuple] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score: the largest containment of a template in a line, or a run of as many words, of the document; 0 below the threshold.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = order_templates(docs, templates or TEMPLATES, threshold, text_col)
    hit, pairs = matching_documents(rows, ordered)
    blocks = similar_blocks(hit, pairs, ordered).select("row", "label", "containment").unionAll(similar_runs(hit, pairs, ordered))
    similar = blocks.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    similar = materialize(similar, "licenses").select(F.col("row").alias("__row"), "more", "score")
    base = rows.select("row", "doc_id", *phrase_columns(whole_text("text"), phrases or PHRASES))
    out = base.join(similar, F.col("row") == F.col("__row"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
