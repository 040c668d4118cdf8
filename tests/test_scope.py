"""Scope by folds inside a document's row, against plain Python over odd documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordia.operators import jobs, scope

NAMES = {"alpha": ["alpha", "al-pha"], "beta": ["beta"], "gamma": ["g.a", ""], "signs": ["--"], "none": [""]}


def bare(x):
    return re.sub("[^A-Z0-9]", "", x.upper())


def lines(text):
    return [x for x in (re.sub(r"\s+", " ", y).strip() for y in (text or "").split("\n")) if x]


def named(pages, names):
    own = [n for n in names if n]
    forms = [bare(n) for n in own]
    loose = [any(f and f in bare(p) for f in forms) for p in pages]
    word = re.compile(r"\b(?:" + "|".join(map(re.escape, own)) + r")\b", re.I) if own else None
    strict = [bool(word and (hit or "" in forms) and word.search(p)) for p, hit in zip(pages, loose, strict=True)]
    return [i + 1 for i, hit in enumerate(strict if any(strict) else loose) if hit]


def islands(numbers, gap):
    out = []
    for p in numbers:
        if out and p - out[-1][-1] <= gap:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def windows(pages, groups):
    found = {k: n for k, v in groups.items() if (n := named(pages, v))}
    front = {p for p in range(1, scope.FRONT_PAGES + 1) if sum(p in n for n in found.values()) >= max(scope.LEAST_FRONT, len(groups) // 6)}
    main = {k: min(islands([p for p in n if p not in front] or n, scope.ANCHOR_GAP), key=lambda x: (-len(x), x[0])) for k, n in found.items()}
    order = sorted(main, key=lambda k: (main[k][0], k))
    return [(k, main[k][0], max(main[k][0], main[order[i + 1]][0] - 1 if i + 1 < len(order) else len(pages)), main[k]) for i, k in enumerate(order)]


def picked(pages, window, tokens):
    _, start, end, anchors = window
    inside = [p for p in range(start, end + 1) if any(t in bare(pages[p - 1]) for t in tokens)]
    best = min(islands(inside, scope.RELEVANT_GAP), key=lambda x: (abs(x[0] - start), -len(x), x[0]), default=None)
    low, high = (max(start, best[0] - 1), min(end, best[-1] + 1)) if best else (start, end)
    near = {q for p in anchors for q in (p - 1, p, p + 1) if 1 <= q <= len(pages)}
    bridges = {q for a, b in zip(anchors, anchors[1:], strict=False) if 2 <= b - a <= 3 for q in range(a, b + 1)}
    return sorted(set(range(low, high + 1)) | near | bridges)


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(5)
    words = ["alpha", "ALPHA", "alphabet", "al pha", "beta", "betas", "g.a", "ga", "--", "x", "y", "token", "", "  "]
    made = ["\n".join(" ".join(draw.choice(words if draw.random() < 0.3 else ["x", "y", "zz"]) for _ in range(3)) for _ in range(draw.randrange(60))) for _ in range(80)]
    return list(enumerate([*made, None, "", "\n \n", "alpha", "\n".join(["alpha beta g.a"] * 400), "y " * 30_000 + "beta"]))


def test_windows_and_pages(spark, documents):
    tokens = ["TOKEN", "Y"]
    groups = {k: NAMES[k] for k in ("alpha", "beta", "gamma", "none")}

    def fold(pages):
        anchors = F.array(*[F.struct(F.lit(k).alias("name"), scope.named_pages(pages, scope.literal_terms(v)).alias("pages")) for k, v in groups.items()])
        n = F.size(pages).cast("long")
        found = scope.anchor_windows(anchors, n, F.lit(len(groups)))
        return F.transform(found, lambda w: F.struct(w.alias("w"), scope.select_pages(w, pages, n, F.array(*map(F.lit, tokens))).alias("pages")))

    rows = scope.fold_documents(spark.createDataFrame(documents, "doc_id long, text string"), fold).collect()
    want = [(i, *w, picked(lines(t), w, tokens)) for i, t in documents for w in windows(lines(t), groups)]
    assert sorted((r.doc_id, r.w["name"], r.w["window_start"], r.w["window_end"], r.w["primary_pages"], r.pages) for r in rows) == sorted(want)


def test_models_of_a_table_choose_the_same_pages(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    models = spark.createDataFrame([(i, k, v) for i, _ in documents for k, v in NAMES.items()], "doc_id long, name string, names array<string>")
    fields = models.select("doc_id", "name", F.when(F.col("name") != "beta", F.array(F.lit("TOKEN"))).alias("tokens"))
    pages = scope.blocks_with_size(docs)
    got = jobs.chosen_pages(pages, models, fields, "anchor-window").collect()
    want = [(i, w[0], picked(lines(t), w, [] if w[0] == "beta" else ["TOKEN"])) for i, t in documents for w in windows(lines(t), NAMES)]
    assert sorted((r.doc_id, r.name, r.pages) for r in got) == sorted(want)
    by_name = jobs.chosen_pages(pages, models, fields, "name-match").collect()
    assert sorted((r.doc_id, r.name, r.pages) for r in by_name) == sorted((i, k, n) for i, t in documents for k, v in NAMES.items() if (n := named(lines(t), v)))


def test_nothing_is_shuffled(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    plan = scope.fold_documents(docs, lambda pages: scope.islands(F.transform(pages, lambda e: e["page_no"]), 2))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sum(r.size for r in plan.collect()) == sum(len(lines(t)) for _, t in documents)
