"""Audits of models in their document's row: what is shuffled, and odd pages against plain Python."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concordia.operators import jobs, scope


def shuffled(spark, run):
    """Bytes and rows that run() shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        held = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteBytes() for s in held), sum(s.shuffleWriteRecords() for s in held)

    before = total()
    run()
    return [b - a for a, b in zip(before, total(), strict=True)]


def write(rows):
    return lambda: rows.write.format("noop").mode("overwrite").save()


N_DOCS, N_MODELS, LINES = 120, 6, 40


@pytest.fixture(scope="module")
def noise(spark):
    """Documents of random letters, which do not compress, and models that each of them names on every line; the texts' size."""
    draw = random.Random(3)
    names = [f"model{k}" for k in range(N_MODELS)]
    docs = [(d, "\n".join(" ".join(names) + "".join(draw.choices("BCDFGHJKLPQRTVWXZ0123456789", k=160)) for _ in range(LINES))) for d in range(N_DOCS)]
    models = [(d, n, [n]) for d in range(N_DOCS) for n in names]
    sets = [(d, n, o, s, "Q", [f"{s}{d % 7}{i}" for i in range(30)]) for d in range(N_DOCS) for n in names for o, s in enumerate(["G_A", "G_FLEX_SETUP"])]
    return (
        scope.blocks_with_size(spark.createDataFrame(docs, "doc_id long, text string")),
        spark.createDataFrame(models, "doc_id long, name string, names array<string>"),
        spark.createDataFrame(sets, "doc_id long, name string, ord int, dataset string, source string, fields array<string>"),
        sum(len(t) for _, t in docs),
    )


@pytest.mark.parametrize("mode", jobs.MODES)
def test_texts_are_shuffled_once(spark, noise, mode):
    """They were shuffled with each step and for each model, some fifteen times."""
    pages, models, sets, size = noise
    assert shuffled(spark, write(jobs.audit_models(pages, models, sets, mode=mode)))[0] < 2 * size


def test_cards_are_placed_where_the_reports_are(spark, noise):
    """The place of a document's cards had an exchange of its own, since reports lay by another key."""
    audits = jobs.audit_models(*noise[:3], mode="name-match")
    order = Window.partitionBy("doc_id").orderBy(*jobs.card_order(F.col("status"), F.size("missing"), F.col("name")))
    placed = audits.select("doc_id", "name", F.row_number().over(order).alias("place"))
    exchanges = [rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for rows in (audits.select("doc_id", "name", "status", "missing"), placed)]
    assert exchanges[0] == exchanges[1] > 0


def test_odd_pages(spark):
    """Gaps, doubles and numbers from below 1, models without a document or of one name, letters that are more in upper case."""
    blocks = {1: [(-1, "alpha"), (3, "stra"), (3, "ße alpha QTY"), (9, None), (30, "rest")], 2: [(1, "x"), (2, "alpha one"), (3, "two")], 3: [(1, "no one")]}
    pages = spark.createDataFrame([(d, p, b, len(bs)) for d, bs in blocks.items() for p, b in bs], "doc_id long, page_no long, block string, n_pages long")
    models = [(d, "alpha", ["alpha"]) for d in (1, 2, 3, 4)] + [(2, "alpha", ["two"])]
    sets = [(d, "alpha", 0, "G_A", "Q", ["strasse", "rest", "one-two", "straße", "é"]) for d in (1, 2, 3, 4)]
    audits = jobs.audit_models(pages, spark.createDataFrame(models, "doc_id long, name string, names array<string>"), spark.createDataFrame(sets, "doc_id long, name string, ord int, dataset string, source string, fields array<string>"), mode="name-match")
    got = sorted((r.doc_id, r.doc_pages, r.missing) for r in audits.collect())
    gone = ["strasse", "rest", "one-two", "straße", "é"]
    # beside document 1's "stra" page 3 has "ße", so the two are a word over the break in normalised form; both of document 2's models have its pages
    assert got == [(1, [-1, 3], ["rest", "one-two", "é"]), (2, [2, 3], ["strasse", "rest", "straße", "é"]), (2, [2, 3], ["strasse", "rest", "straße", "é"]), (3, [], gone), (4, [], gone)]


def test_many_models_of_one_document_are_dealt_out(spark):
    models = [(1, f"m{k}", [f"m{k}"]) for k in range(200)]
    pages = spark.createDataFrame([(1, k + 1, f"m{k} field{k}", 200) for k in range(200)], "doc_id long, page_no long, block string, n_pages long")
    sets = [(1, f"m{k}", 0, "G_A", "Q", [f"field{k}", f"field{k + 1}"]) for k in range(200)]
    audits = jobs.audit_models(pages, spark.createDataFrame(models, "doc_id long, name string, names array<string>"), spark.createDataFrame(sets, "doc_id long, name string, ord int, dataset string, source string, fields array<string>"), mode="name-match", dealt=True)
    rows = audits.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    assert {r.name: r.missing for r in rows} == {f"m{k}": [f"field{k + 1}"] for k in range(200)}


def test_missing_by_dataset(spark, noise):
    """Each field was a row of its own in three exchanges; the first dataset by order, then by place, has a field that several have."""
    pages, models, sets, _ = noise
    audits = jobs.audit_models(pages, models, sets, mode="name-match").select("doc_id", "name", "missing").persist()
    assert audits.count() == N_DOCS * N_MODELS
    assert shuffled(spark, write(jobs.missing_by_dataset(audits, sets)))[1] <= 4 * N_DOCS * N_MODELS
    audits.unpersist()
    lost = spark.createDataFrame([(1, "m", ["c", "b", "a", None, "z"]), (1, "m", ["b", "y"]), (2, "m", ["b"])], "doc_id long, name string, missing array<string>")
    rows = [(1, "m", 1, "later", ["a", "y"]), (1, "m", 0, "one", ["x", "b", "c"]), (1, "m", 0, "two", ["c", "a", None, "b"]), (1, "m", 2, "none", None), (3, "m", 0, "one", ["b"])]
    got = jobs.missing_by_dataset(lost, spark.createDataFrame(rows, "doc_id long, name string, ord int, dataset string, fields array<string>"))
    assert sorted((r.doc_id, r.ord, r.dataset, r.missing) for r in got.collect()) == [(1, 0, "one", ["b"]), (1, 0, "two", ["c", "a"]), (1, 1, "later", ["y"])]
