"""Queries on lineage of SQL text. The text is built from table values by a template; the SQL beside it returns the values
that the template used, not a parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import lineage, pages
from concordia.plans.inputs import table

SQL: dict[str, str] = {}
#: Each part is a query of its own: key, size and a table named after it.
_PARTS = "(SELECT p_partkey AS part_no, p_size AS part_size, upper(replace(p_name, ' ', '_')) AS part_table FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), F.col("p_size").alias("part_size"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("part_table"))


def _fill(template: str) -> Column:
    """{t}: the part's table, {r}: its size, {k}: its key."""
    out = F.lit(template)
    for mark, value in (("{t}", F.col("part_table")), ("{r}", F.col("part_size").cast("string")), ("{k}", F.col("part_no").cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _queries(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return _parts(spark, sf_dir).select("part_no", _fill(template).alias("sql"))


def _map(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    rows = lineage.lineage(_queries(spark, sf_dir, template), "part_no")
    return rows.select("part_no", "out_alias", "source_table", "source_column", "source_mode", "source_confidence")


def _expected(*rows: tuple[str, str, str, str, str]) -> str:
    """SELECT of rows (alias, table, column, mode, confidence), each an SQL expression over _PARTS."""
    return " UNION ALL ".join(f"SELECT part_no, {a} AS out_alias, {t} AS source_table, {c} AS source_column, '{m}' AS source_mode, '{x}' AS source_confidence FROM " + _PARTS for a, t, c, m, x in rows)


_FROM = "SELECT a.c1, b.c2 /* FROM no_table z */ FROM {t} a, s{r}.area_{r} AS b -- , gone g\n LEFT JOIN extra_{k} e ON e.id = a.id WHERE a.x IN (SELECT 1 FROM inner_t q)"


def q20_sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.sources(_queries(spark, sf_dir, _FROM), "part_no").select("part_no", F.array_join("tables", ",").alias("tables"))


SQL["q20_sql_tables"] = "SELECT part_no, part_table || ',AREA_' || part_size || ',EXTRA_' || part_no AS tables FROM " + _PARTS


def q21_sql_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.sources(_queries(spark, sf_dir, _FROM), "part_no")
    return found.select("part_no", F.explode("aliases").alias("alias", "table_name"))


SQL["q21_sql_aliases"] = "SELECT part_no, unnest(['A', 'B', 'E']) AS alias, unnest([part_table, 'AREA_' || part_size, 'EXTRA_' || part_no]) AS table_name FROM " + _PARTS


def q22_lineage_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "select x.col_{k}, x.depot_no depot_no_link, X.Name as \"label\", lone from {t} x where 1 = 1")


SQL["q22_lineage_direct"] = _expected(
    ("'COL_' || part_no", "part_table", "'COL_' || part_no", "DIRECT", "HIGH"),
    ("'DEPOT_NO_LINK'", "part_table", "'DEPOT_NO'", "ALIAS", "HIGH"),
    ("'LABEL'", "part_table", "'NAME'", "ALIAS", "HIGH"),
    ("'LONE'", "'N/A'", "'LONE'", "DIRECT", "MEDIUM"),
)


def q23_lineage_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(
        spark,
        sf_dir,
        "SELECT NVL(a.c_{k}, 0) v, upper(trim(a.n)) AS u, DECODE(a.kind, 'x,y', b.loc, 'z', b.loc) d, COALESCE(b.p || a.q, b.r, a.s) e, 1 + 1 AS two FROM {t} a JOIN area_{r} b ON a.id = b.id",
    )


SQL["q23_lineage_expr"] = _expected(
    ("'V'", "part_table", "'C_' || part_no", "EXPRESSION", "MEDIUM"),
    ("'U'", "part_table", "'N'", "EXPRESSION", "MEDIUM"),
    ("'D'", "'AREA_' || part_size", "'LOC'", "EXPRESSION", "MEDIUM"),
    ("'E'", "'AREA_' || part_size", "'R'", "EXPRESSION", "MEDIUM"),
    ("'TWO'", "'N/A'", "'UNKNOWN_SOURCE_COLUMN'", "UNKNOWN", "LOW"),
)


def q24_lineage_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "WITH one AS (SELECT t.loc_{k} AS place, t.id FROM {t} t), two (p, q) AS (SELECT o.place AS spot, o.id FROM one o) SELECT w.spot, w.id AS ident, z.other FROM two w, area_{r} z")


SQL["q24_lineage_cte"] = _expected(
    ("'SPOT'", "part_table", "'LOC_' || part_no", "ALIAS", "HIGH"),
    ("'IDENT'", "part_table", "'ID'", "ALIAS", "HIGH"),
    ("'OTHER'", "'AREA_' || part_size", "'OTHER'", "DIRECT", "HIGH"),
)


def q25_lineage_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "SELECT s.org, s.gone, d.deep FROM (SELECT l.org_{k} org FROM {t} l WHERE l.x > (SELECT 1 FROM y)) s, (SELECT i.v AS deep FROM (SELECT j.v FROM area_{r} j) i) AS d")


SQL["q25_lineage_subquery"] = _expected(
    ("'ORG'", "part_table", "'ORG_' || part_no", "ALIAS", "HIGH"),
    ("'GONE'", "'UNKNOWN_SUBQUERY'", "'GONE'", "DIRECT", "HIGH"),
    ("'DEEP'", "'AREA_' || part_size", "'V'", "ALIAS", "HIGH"),
)


def q26_lineage_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "SELECT CASE WHEN a.f = 1 THEN a.x ELSE b.y END pick, a.m + b.n AS total_{k} FROM {t} a JOIN area_{r} b ON a.id = b.id")


SQL["q26_lineage_multi"] = _expected(
    ("'PICK'", "'MULTI_SOURCE'", "'MULTI_SOURCE'", "MULTI_SOURCE", "LOW"),
    ("'TOTAL_' || part_no", "'MULTI_SOURCE'", "'MULTI_SOURCE'", "MULTI_SOURCE", "LOW"),
)


def q27_post_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir, "SELECT a.x, s.gone, a.p + b.q AS mix, (s.w) wrapped, q.z FROM {t} a, area_{r} b, (SELECT k.w2 FROM k_{k} k) s")
    rows = lineage.lineage(queries, "part_no", with_sources=True)
    # An alias that the parser left in place, as other readers of the text do.
    rows = rows.withColumn("source_table", F.when(F.col("out_alias") == "X", "A").otherwise(F.col("source_table")))
    return lineage.post_resolve(rows).select("part_no", "out_alias", "source_table", "source_column", "source_mode", "source_confidence", "reason")


def _reasoned(*rows: tuple[str, str, str, str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT part_no, '{a}' AS out_alias, {t} AS source_table, '{c}' AS source_column, '{m}' AS source_mode, '{x}' AS source_confidence, '{r}' AS reason FROM " + _PARTS for a, t, c, m, x, r in rows
    )


SQL["q27_post_resolution"] = _reasoned(
    ("X", "part_table", "X", "DIRECT", "HIGH", "alias_to_table"),
    ("GONE", "'N/A'", "GONE", "UNRESOLVED", "LOW", "unresolved_or_derived_alias"),
    ("MIX", "'MULTI_SOURCE'", "MULTI_SOURCE", "MULTI_SOURCE", "LOW", "multi_source_expression"),
    ("WRAPPED", "'N/A'", "W", "UNRESOLVED", "LOW", "unresolved_or_derived_alias"),
    ("Z", "'N/A'", "Z", "UNRESOLVED", "LOW", "unresolved_or_derived_alias"),
)


def q48_stage2_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted and schema-qualified names with $ and #, comma lists, join words that are no alias."""
    return _map(spark, sf_dir, 'SELECT "a"."c$1" AS "out_{k}", tab#2.d FROM "sch"."{t}" "a", fin.tab#2 LEFT OUTER JOIN x.y z ON z.i = "a".i')


SQL["q48_stage2_lineage"] = _expected(
    ("'OUT_' || part_no", "part_table", "'C$1'", "ALIAS", "HIGH"),
    ("'D'", "'TAB#2'", "'D'", "DIRECT", "HIGH"),
)


def q49_pick_sql_from_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest <pre> that holds SELECT and FROM."""
    page = "<pre>no query here, however long it may be, only words and words</pre><p>x</p><pre class='q'>select 1 from {t}</pre><pre>\nSELECT a.c_{k}\nFROM {t} a, area_{r} b</pre>"
    return _parts(spark, sf_dir).select("part_no", _fill(page).alias("html")).select("part_no", pages.query_text(F.col("html")).alias("sql"))


SQL["q49_pick_sql_from_html"] = "SELECT part_no, 'SELECT a.c_' || part_no || ' FROM ' || part_table || ' a, area_' || part_size || ' b' AS sql FROM " + _PARTS


def q50_headerless_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that holds the column: its type cell, and its first other cell of eight characters or more."""
    page = F.concat(F.lit("<tr><td>zz</td></tr><tr><td>P_NAME</td><td>short</td><td>NUMBER("), F.col("p_size").cast("string"), F.lit(")</td><td>described as "), F.col("p_name"), F.lit("</td></tr>"))
    return pages.column_metadata(table(spark, sf_dir, "part").select("p_partkey", page.alias("html"), F.lit("p_name").alias("column")), "p_partkey")


SQL["q50_headerless_metadata"] = "SELECT p_partkey, 'described as ' || p_name AS description, 'NUMBER(' || p_size || ')' AS data_type FROM part"
