"""Repeated windows by row: missing and repeated ids, common phrases in many contexts, against plain Python."""

import random
import re

import pytest
import xxhash

from concordia.llm import repeats, suffix_dedup, window_dedup


def order(rows):
    """Documents (id, text) in the stated order, each once."""
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 1
    key = lambda r: (r[0] is None, r[0] or 0, half(r[1]) if r[0] is None else -1 - half(r[1]))
    return sorted({(i, t or "") for i, t in rows}, key=key)


def bytes_left(rows, window):
    seen, left = {}, {}
    for n, (i, t) in enumerate(order(rows)):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for j in range(len(b) - window + 1):
            if seen.setdefault(b[j : j + window], (n, j)) != (n, j):
                gone[j : j + window] = b"\1" * window
        left[i, t] = bytes(x for x, g in zip(b, gone) if not g)
    return left


def words_left(rows, window):
    seen, left = {}, {}
    for n, (i, t) in enumerate(order(rows)):
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        for j in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[j : j + window]), n) < n:
                gone |= set(range(j, j + window))
        left[i, t] = [x for j, x in enumerate(w) if j not in gone]
    return left


def held(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, m long, did string, sub long").repartition(4)


def check_bytes(spark, rows, window, **more):
    want, got = bytes_left(rows, window), suffix_dedup.repeated_bytes(held(spark, rows), window, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, at, out = r["text"].encode(), 0, b""
        for a, b in repeats.merged(r["cuts"]):
            out, at = out + raw[at:a], b
        assert out + raw[at:] == want[r["doc_id"], r["text"]], r["doc_id"]


def check_words(spark, rows, window, **more):
    want, got = words_left(rows, window), window_dedup.repeated_words(held(spark, rows), window, **more).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, at, out = r["text"].split(), 0, []
        for a, b in repeats.merged(r["cuts"]):
            out, at = out + raw[at:a], b
        assert out + raw[at:] == want[r["doc_id"], r["text"]], r["doc_id"]


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    prose = lambda n: " ".join(pick.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(pick.randrange(400)) for _ in range(n))
    a, b, c = prose(120), prose(90), prose(70)
    out = [(None, a), (None, "short"), (None, f"{b} {a}"), (None, f"end {c}"), (None, None), (None, ""), (None, "short"), (None, a)]
    out += [(7, f"{prose(30)} {a} {prose(9)}"), (7, f"{c} {prose(20)}"), (7, f"{c} {prose(20)} {c}"), (7, "short"), (7, "short")]
    out += [(2**63 - 1, b), (-(2**63), prose(80)), (3, f"{c}{c}"), (4, "z" * 700), (5, "z" * 300)]
    return out


def test_bytes_by_row(spark, rows):
    check_bytes(spark, rows, 100)


def test_words_by_row(spark, rows):
    check_words(spark, rows, 50)


@pytest.mark.parametrize("most", [1, 300, 5000])
def test_common_phrase(spark, most):
    """One phrase in very many contexts makes a shard that is cut again; results stay the same."""
    pick = random.Random(most)
    word = lambda: f"w{pick.randrange(10**6)}"
    phrase, longer = "the one phrase that all of them hold", " ".join(f"boiler{i}" for i in range(8))
    rows = [(i, " ".join([*(word() for _ in range(9)), pick.choice([phrase, longer]), *(word() for _ in range(9))])) for i in range(150)]
    rows += [(200 + i, rows[i * 7][1] + " tail " + rows[i * 3][1]) for i in range(20)] + [(300, "ha " * 200), (301, "x " + "ha " * 150)]
    check_bytes(spark, rows, 60, gram=12, most=most)
    check_words(spark, rows, 12, gram=3, most=most)


def join_rows(plan):
    """Rows that each join of an executed plan made."""
    inner = getattr(plan, {"AdaptiveSparkPlan": "executedPlan"}.get(plan.nodeName(), "plan" if "QueryStage" in plan.nodeName() else "children"))()
    below = [inner] if "Adaptive" in plan.nodeName() or "QueryStage" in plan.nodeName() else [inner.apply(i) for i in range(inner.size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for p in below for n in join_rows(p)]


def test_a_run_meets_its_answers_once(spark, monkeypatch):
    """A common phrase gives a segment an answer for each window; runs are not repeated for each of them."""
    pick, kept = random.Random(3), []
    word = lambda: f"w{pick.randrange(10**6)}"
    edges = [" ".join(word() for _ in range(9)) for _ in range(40)]
    rows = [(i, f"{edges[i]} the one phrase that all of them hold {edges[-i]}") for i in range(40)] * 2
    rows += [(100 + i, text) for i, text in rows]
    keep = repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, label: (kept.append((label, keep(df, label))), kept[-1][1])[1])
    docs = repeats.ident(held(spark, rows), "doc_id", "text").select("did", "sub", "text")
    found = repeats.spans(docs, window_dedup.spec(12, 3, 1), lambda t: window_dedup._solve(t, 12), "t")
    assert len(found.collect()) == 40
    made = join_rows(found._jdf.queryExecution().executedPlan())
    assert made and max(made) <= max(f.count() for label, f in kept if label == "t-runs")
