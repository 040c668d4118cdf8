"""License texts that are wrapped and commented, and the join by brute force."""

import random
import textwrap

import pytest

from concordia.llm import licenses

SCHEMA = "doc_id long, text string"


def scan(spark, texts, **kwargs):
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r for r in licenses.license_scan(rows, **kwargs).collect()}


@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_notices(spark, width):
    prose = " ".join(f"prose{i}" for i in range(200))
    wrapped = [prose + "\n" + "\n".join("# " + x for x in textwrap.wrap(t, width)) + "\n" + prose for _, t, *_ in licenses.TEMPLATES]
    apart = [f" {prose} ".join(t.split()) for _, t, *_ in licenses.NOTICES]  # every word, none near another
    rows = [*wrapped, "", None, *["\n".join(x.split(" ")) for x in apart]]
    got = scan(spark, rows)
    for i, (label, *_) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert all(got[i]["score"] == 0 for i in range(len(wrapped), len(rows)))


def test_licenses_by_part(spark):
    """Parts of licenses, of which some differ from others by a word, and words that make none."""
    cases = [
        ("// SPDX-License-Identifier: GPL-2.0-or-later", {"gpl"}),
        ("/* SPDX-License-Identifier: Apache-2.0 */", {"apache"}),
        ("\t\tGNU LESSER GENERAL PUBLIC LICENSE\n\t\tVersion 2.1, February 1999", {"gpl", "lgpl"}),
        ("\t\tGNU GENERAL PUBLIC LICENSE\n\t\tVersion 3, 29 June 2007", {"gpl"}),
        ("Boost Software License - Version 1.0 - August 17th, 2003", {"boost"}),
        (next(t for label, t in licenses.NOTICES if label == "isc"), {"isc"}),
        (next(t for label, t in licenses.NOTICES if label == "unlicense"), {"unlicense"}),
        ("You need a license to drive, and the software in the car is provided by its maker.", set()),
        ("license " * 500, set()),
    ]
    got = scan(spark, [text for text, _ in cases])
    assert [set(filter(None, got[i]["labels"].split(","))) for i in range(len(cases))] == [labels for _, labels in cases]


def brute(text, templates, threshold):
    words, labels, score = licenses.word_list(text or ""), set(), 0.0
    for label, t, *share in templates:
        own, n = set(licenses.word_list(t)), len(licenses.word_list(t))
        runs = [set(words[max(0, i) : i + n]) for i in range(1 - n, len(words))]
        lines = [set(licenses.word_list(x)) for x in (text or "").split("\n")]
        best = max((len(own & b) for b in [*runs, *lines]), default=0) / len(own)
        if best >= (share[0] if share else threshold) - 1e-9:
            labels.add(label)
            score = max(score, best)
    return labels, score


@pytest.mark.parametrize("seed", range(3))
def test_join_by_brute_force(spark, seed):
    """Few words, so that templates overlap, repeat words, tie, and stand in documents in parts and out of order."""
    draw = random.Random(seed)
    letters = "abcdefghijklmnop"
    text = lambda n, m: "".join(draw.choice(letters[:m]) + draw.choice(" \n    ") for _ in range(n))
    templates = [(f"t{i}", text(draw.randint(1, 14), 16)) for i in range(12)] + [("all", "a b c", 1.0), ("all2", "b b d", 1.0)]
    texts = [text(draw.randint(0, 60), draw.choice([4, 10, 16])).replace(" ", draw.choice([" ", " \n", " x "])) for _ in range(60)] + [None, "", "a", "a b c", "c\nb\na"]
    threshold = draw.choice([0.6, 0.8])
    got = scan(spark, texts, templates=templates, threshold=threshold, phrases={"zz zz": "zz"})
    for i, t in enumerate(texts):
        labels, score = brute(t, templates, threshold)
        assert (set(filter(None, got[i]["labels"].split(","))), got[i]["score"]) == (labels, pytest.approx(score)), (t, templates)
