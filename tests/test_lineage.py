"""Lineage of SQL text: parsed sources of queries over schemas of our own."""

import pytest

from concordia.operators import lineage


def found(sql):
    return {a: (s.table, s.column, s.mode, s.confidence) for a, s in lineage.parse(sql)[0].items()}


def test_plain_and_renamed_columns():
    got = found("select t.seat, t.price as cost, venue.\"city\" from tickets t join venue on venue.id = t.venue_id")
    assert got == {"SEAT": ("TICKETS", "SEAT", "DIRECT", "HIGH"), "COST": ("TICKETS", "PRICE", "ALIAS", "HIGH"), "CITY": ("VENUE", "CITY", "DIRECT", "HIGH")}


@pytest.mark.parametrize("expr", ["upper(trim(m.title))", "m.title || ', ' || 'x.y'", "coalesce(m.title, '(a, b)')", "cast(m.title as varchar(20))"])
def test_expressions_over_one_column(expr):
    assert found(f"SELECT {expr} AS shown FROM movies m")["SHOWN"] == ("MOVIES", "TITLE", "EXPRESSION", "MEDIUM")


def test_expressions_over_several_columns():
    got = found("SELECT a.w * b.h AS area, 7 AS seven, sysdate now_ FROM boxes a, lids b")
    assert got["AREA"][2] == "MULTI_SOURCE" and got["SEVEN"][:3] == ("N/A", "UNKNOWN_SOURCE_COLUMN", "UNKNOWN")
    assert got["NOW_"][:2] == ("N/A", "SYSDATE")


def test_subquery_in_subquery():
    got = found("SELECT o.total FROM (SELECT i.sum_ AS total FROM (SELECT p.amount AS sum_ FROM payments p) i) o")
    assert got["TOTAL"][:2] == ("PAYMENTS", "AMOUNT")


def test_common_tables_see_earlier_ones():
    got = found("WITH base AS (SELECT r.km FROM rides r), twice AS (SELECT b.km AS far FROM base b) SELECT z.far AS distance FROM twice z")
    assert got["DISTANCE"][:2] == ("RIDES", "KM")


def test_first_select_of_a_union_counts():
    got = found("SELECT l.code FROM left_side l WHERE l.n > 1 UNION ALL SELECT r.other FROM right_side r")
    assert got == {"CODE": ("LEFT_SIDE", "CODE", "DIRECT", "HIGH")}


def test_comments_quotes_and_commas_in_literals():
    got = found("SELECT /* k.gone, */ k.name -- , k.lost\n, 'a, k.text, b' AS note FROM keys k")
    assert set(got) == {"NAME", "NOTE"} and got["NOTE"][0] == "N/A"


@pytest.mark.parametrize("sql", [None, "", "   ", "UPDATE x SET y = 1", "SELECT 1", "SELECT (", "WITH a AS (", "FROM a SELECT b"])
def test_what_is_no_query_has_no_sources(sql):
    assert found(sql) == {} and lineage.references_by_output(sql) == {}


def test_references_by_output():
    got = lineage.references_by_output("SELECT a.x, f(b.y, a.z) AS m, q.lost, 1 AS one FROM s.one a LEFT JOIN two b ON b.i = a.i")
    assert got == {"X": [("ONE", "X")], "M": [("TWO", "Y"), ("ONE", "Z")], "LOST": [], "ONE": []}


def test_sources_come_with_lineage(spark):
    rows = [(1, "SELECT a.x, b.y FROM s.one a, two b"), (2, None), (3, "SELECT q.z FROM one, (SELECT 1 FROM k) q")]
    queries = spark.createDataFrame(rows, "id long, sql string")
    apart = lineage.lineage(queries, "id").join(lineage.sources(queries, "id"), "id")
    got = lineage.lineage(queries, "id", with_sources=True)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # nothing that the driver may have to broadcast
    assert sorted(map(str, got.collect())) == sorted(map(str, apart.select(*got.columns).collect()))


def test_small_file_of_many_queries_is_dealt_out(spark):
    queries = spark.range(1000).selectExpr("id", "concat('SELECT a.c', id, ' FROM t a') AS sql").coalesce(1)
    for rows in (lineage.lineage(queries, "id"), lineage.sources(queries, "id"), lineage.select_references(queries, "id")):
        held = [n for n in rows.select("id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        assert len(held) >= 8 and max(held) < 250
