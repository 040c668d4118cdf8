"""Toxicity: held-out accuracy, and features counted by hand."""

import math

from pyspark.sql import functions as F

from concordia.llm import toxicity

DATA = "/root/testdata/sf0.1"


def test_features_by_hand():
    told = toxicity.Tokens({"glorp": 2.0, "vequ*": 3.0})
    f = toxicity.features("You GLORP, vequta!! 1d10t m.o.r.o.n and s c u m more", told)
    assert f[1] == 100 * 2 / 11 and f[3] == 3.0 and told.weight("vequta") == 3.0 and told.weight("veq") == 0.0
    assert f[6] > 0 and f[7] == math.log1p(3) and f[8] == 100 * 3 / 11 and f[10] == 1 / 11 and f[12] > 0
    assert toxicity.features(None, told) == toxicity.features("", told) == [0.0] * toxicity.N_FEATURES
    assert [toxicity.token_words(w)[1] for w in ("1d10t!", "m.o.r.o.n", "$cum", "plain,", "don't")] == ["idiot", "moron", "scum", "", ""]
    assert len(toxicity.features("a " * 200_000 + "\x00!", told)) == len(toxicity.features(" ", told)) == toxicity.N_FEATURES


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.op13_toxicity(spark, DATA).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(labels[i], r.score, r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    toxic, clean = [x for x in held if x[0] == 1], [x for x in held if x[0] == 0]
    assert sum(x[2] for x in toxic) / len(toxic) >= 0.88 and sum(x[2] for x in clean) / len(clean) <= 0.01
    above = sum((t[1] > c[1]) + 0.5 * (t[1] == c[1]) for t in toxic for c in clean)
    assert above / len(toxic) / len(clean) >= 0.93


def test_odd_rows(spark):
    rows = [(i, "you stupid loser" if i % 2 else "a kind word", i % 2) for i in range(60)] + [(61, None, 1), (62, "x", None), (None, "scum you scum", 1)]
    known = spark.createDataFrame([r[:2] for r in rows] + [(1, "you stupid loser"), (1, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 9, r[2]) for r in rows] + [(0, 1, None), (0, 1, 0), (63, 1, 1), (64, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(known, labels, trees=3)
    docs = spark.createDataFrame([(1, "you loser", 5, 6.0), (1, "you loser", 5, 6.0), (None, None, None, None), (2, "", 1, 1.0), (3, "kind", 1, 1.0)], "doc_id long, text string, prediction int, `features.x` double")
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "prediction", "features.x", "score"]
    scores = sorted(((r.doc_id or 0), r.score) for r in got.collect())
    assert len(scores) == 5 and [s > 0.5 for _, s in scores] == [False, True, True, False, False]
    for some, share in (("false", 0.0), ("toxic = 1", 1.0), ("toxic = 0", 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(known, labels.where(some))).collect()} == {share}
    assert toxicity.score(docs.where(F.lit(False)), model).count() == 0
