"""What the score of language identification tells, and rows without ids in mixing."""

import random
from itertools import pairwise

import pytest

import corpus_pipeline as cp
from concordia.llm import language, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Fixed texts of no labelled language: keys struck at random, Croatian, program text.
ODD = [
    "asdf qwer zxcv hjkl uiop qwerty asdfgh lkjhg mnbv poiu ytrewq dfgh vbnm wert",
    "Danas je lijep dan i svi smo otišli na more jer je bilo vrlo toplo, a voda je bila čista i mirna.",
    "int main(int argc, char **argv) { for (int i = 0; i < n; i++) { if (ptr == NULL) return -1; } free(ptr); }",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.fit(docs.where(~language.held_out()))


def test_texts_of_no_language_score_low(model):
    for text in ODD:
        assert model.predict(text, {})[1] < 0.5, text


def test_held_out_texts_score_high(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(language.held_out()).where("length(text) > 200 AND lang IS NOT NULL")
    rows = [(d.lang, *model.predict(d.text, {})) for d in docs.collect()]
    assert sum(lang == pred for lang, pred, _ in rows) >= 0.99 * len(rows)
    assert sum(score >= 0.5 for *_, score in rows) >= 0.99 * len(rows)


def test_a_small_language_keeps_its_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 6)
    draw = random.Random(3)
    big = [(i, " ".join(f"{draw.choice('abcdefgh')}{draw.choice('abcdefgh')}" for _ in range(40)), "big", "s", 0) for i in range(60)]
    small = [(100 + i, "wo xu vy zo wy", "small", "s", 0) for i in range(24)]
    fitted = language.fit(spark.createDataFrame(big + small, SCHEMA))
    assert {"wo", "xu", "vy", "zo", "wy"} <= set(fitted.tables[0][0])
    assert fitted.predict("wo wy xu", {})[0] == "small"


def test_without_labels_the_corpus_stays(spark):
    rows = [(1, "some words", None, "s", 0), (2, None, None, "s", 0), (3, "", None, "s", 0), (4, "12 !", None, "s", 0), (None, "ÄÖ", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in cp.language_stage(spark, docs, "").collect()} == {1, None}
    assert cp.language_stage(spark, docs.where("false"), "").count() == 0


def test_rows_without_id_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "en", "s", i) for i in range(2000)], SCHEMA)
    mixed = mixing.mix(docs, mixing.source_rates(docs, {"s": 1.0}))
    copies = [r["count"] for r in mixed.groupBy("text").count().collect()]
    assert 0.55 < len(copies) / 2000 < 0.72 and 0.9 < sum(copies) / 2000 < 1.1 and len(set(copies)) > 3
    keys = [r[0] for r in mixed.groupBy("__key").count().where("count > 1").collect()]
    assert not keys
    assert all(a <= b for part in mixed.select("__key").rdd.glom().collect() for a, b in pairwise(r[0] for r in part))
