"""Field presence, substring join and recursive lookup against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordia.operators import audit, enrich, jobs


def bare(x):
    return re.sub("[^A-Z0-9]", "", (x or "").upper())


@pytest.mark.parametrize("most_bytes", [1 << 20, 700, 90])
def test_missing_fields_over_shards(spark, most_bytes):
    draw = random.Random(most_bytes)
    words = ["".join(draw.choice("ABC") for _ in range(draw.randrange(1, 6))) for _ in range(60)]
    fields = [*words, "a_b", "A B", "--", "é", "", None]
    docs = [(draw.choice([1, 1, 2, None, i]), "".join(draw.choice("ABC") for _ in range(draw.randrange(60)))) for i in range(80)] + [(3, None), (3, ""), (3, "ABC" * 20_000)]
    got = audit.missing_of_table(spark.createDataFrame(docs, "k long, norm string"), spark.createDataFrame([(f,) for f in fields], "field string"), "k", most_bytes)
    known = {f for f in fields if f is not None}
    want = [(k, sorted(f for f in known if not bare(f) or bare(f) not in (norm or ""))) for k, norm in docs]
    assert sorted(((r.k, r.missing) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_fields_and_no_texts(spark):
    docs, fields = spark.createDataFrame([(1, "A"), (1, "A")], "k long, norm string"), spark.createDataFrame([("A",)], "field string")
    assert [(r.k, r.missing) for r in audit.missing_of_table(docs, fields.where("false"), "k").collect()] == [(1, [])] * 2
    assert audit.missing_of_table(docs.where("false"), fields, "k").count() == 0


def by_hand(rows, tables):
    out = []
    for i, t, c in rows:
        hits = [(o, n, d) for n, o, k, d in tables if n and d and k == c and c is not None and t is not None and n.upper() in t.upper()]
        out.append((i, *(min(hits)[1:] if hits else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("columns", [["hot"], ["a", "b", None, "c"]])
def test_substring_update(spark, columns):
    draw = random.Random(len(columns))
    some = lambda n: "".join(draw.choice("abAB é_") for _ in range(n))
    names = list(dict.fromkeys(some(draw.randrange(0, 7)) for _ in range(150)))
    tables = [(n, i // 2, draw.choice(columns), draw.choice(["", f"of {i}", None, f"of {i}"])) for i, n in enumerate(names)] + [("ab", 1, columns[0], "again"), ("zzzz", 0, columns[0], "never")]
    rows = [(draw.choice([i, 1]), draw.choice([some(draw.randrange(30)), "abab", None, ""]), draw.choice(columns)) for i in range(200)]
    got = enrich.substring_update(spark.createDataFrame(rows, "row_id long, table_text string, column string"), spark.createDataFrame(tables, "name string, ord long, column string, description string"))
    assert sorted(((r.row_id, r.matched_table, r.description) for r in got.collect()), key=str) == by_hand(rows, tables)


def test_one_hot_column_makes_no_pairs_beyond_the_rarest_gram(spark):
    """2,000 names and 2,000 texts of one column: each name meets the texts of its rarest gram, not all."""
    names = [(f"name{i:04d}x", i, "hot", "d") for i in range(2000)]
    rows = [(i, f"from name{i:04d}x on", "hot") for i in range(2000)]
    frame = spark.createDataFrame(rows, "row_id long, table_text string, column string")
    got = {r.row_id: r.matched_table for r in enrich.substring_update(frame, spark.createDataFrame(names, "name string, ord long, column string, description string")).collect()}
    assert got == {i: f"name{i:04d}x" for i in range(2000)}


def search(root, described, edges, depth):
    seen, stack = set(), [(root, 0)]
    while stack:
        key, level = stack.pop()
        if key not in seen and level <= depth:
            seen.add(key)
            if described.get(key):
                return described[key], level
            stack += [(r, level + 1) for _, r in sorted(edges.get(key, []), reverse=True)]
    return None, None


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_recursive_lookup(spark, depth):
    draw = random.Random(depth)
    edges = {k: [(o, draw.choice([7, *range(60)])) for o in range(draw.randrange(5))] for k in range(50)}  # key 7 is a hub
    described = {k: draw.choice(["", f"text {k}"]) for k in range(0, 60, 6)}
    asked = [*range(60), 3, 3, None, 99]
    got = enrich.describe_recursively(
        spark.createDataFrame([(k,) for k in asked], "key long"),
        spark.createDataFrame(list(described.items()), "key long, description string"),
        spark.createDataFrame([(k, o, r) for k, rs in edges.items() for o, r in rs], "key long, ref_ord int, ref long"),
        depth,
    )
    assert sorted(((r.key, r.description, r.level) for r in got.collect()), key=str) == sorted(((k, *search(k, described, edges, depth)) for k in asked), key=str)


def test_letters_of_any_long(spark):
    """Four letters end at 475,253."""
    from concordia.functions import text

    def letters(n):
        return letters(n // 26 - 1) + chr(65 + n % 26) if n >= 0 else ""

    numbers = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 1199999, 12356629, 12356630, 2**40]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.column_letters(F.col("n")).alias("l"))
    assert [tuple(r) for r in rows.select("n", "l", text.column_index(F.col("l"))).collect()] == [(n, letters(n), n) for n in numbers]


def test_reports_are_made_once(spark):
    """A filter on the status, or an explode of the missing fields, had the optimizer make each report twice."""
    pages = spark.createDataFrame([(1, 1, "one THE block", 1)], "doc_id long, page_no long, block string, n_pages long")
    models = spark.createDataFrame([(1, "one", ["one"])], "doc_id long, name string, names array<string>")
    sets = spark.createDataFrame([(1, "one", 0, "G_A", "Q_A", ["THE", "gone", "-", "é"])], "doc_id long, name string, ord int, dataset string, source string, fields array<string>")
    audits = jobs.audit_models(pages, models, sets, mode="name-match")
    for rows in (audits.where("status = 'FAIL'"), audits.select("doc_id", F.explode("missing"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("octet_length(") <= audits._jdf.queryExecution().optimizedPlan().toString().count("octet_length(")
        assert not [x for x in plan.splitlines() if x.strip(" +-:").startswith("Filter") and "regexp_replace" in x]
    assert [tuple(r) for r in audits.select("status", "missing").collect()] == [("FAIL", ["gone", "-", "é"])]
