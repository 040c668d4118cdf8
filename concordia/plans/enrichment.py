"""Queries on the cache of answers, search-and-try, and the ladder of table states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import cache, ladder, search
from concordia.plans.inputs import table

SQL: dict[str, str] = {}


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as answers about (status, customer); urgent ones are those of earlier runs."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = table(spark, sf_dir, "orders").select(
        F.lower("o_orderstatus").alias("table"), F.col("o_custkey").cast("string").alias("column"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"), F.lit("N/A").alias("characteristic"),
        F.lit("").alias("doc_url"), F.lit(True).alias("matched"), F.col("o_orderpriority").alias("provider"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).cast("long").alias("asked_at"), urgent.alias("old"),
    )
    return rows.where("old").drop("old"), rows.where("NOT old").drop("old")


def q75_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest answer of each key over the cached ones and those of this run."""
    return cache.merge(*_answers(spark, sf_dir)).select("table", "column", "description", "provider", "asked_at")


_ANSWERS = """
WITH answers AS (SELECT o_orderstatus AS "table", CAST(o_custkey AS VARCHAR) AS "column", 'order ' || o_orderkey AS description, o_orderpriority AS provider,
   datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS asked_at, o_orderpriority <> '1-URGENT' AS new FROM orders)
"""
SQL["q75_cache_merge"] = _ANSWERS + """SELECT "table", "column", description, provider, asked_at FROM answers QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY asked_at DESC, new DESC, description DESC) = 1"""


def q76_cache_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What this run still has to ask of the keys that the cache does not hold."""
    cached, answers = _answers(spark, sf_dir)
    return cache.to_ask(answers, cached)


SQL["q76_cache_asks"] = _ANSWERS + """SELECT DISTINCT "table", "column" FROM answers WHERE new AND ("table", "column") NOT IN (SELECT ("table", "column") FROM answers WHERE NOT new)"""


def q77_search_and_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k asks for a column on eight pages, its best link being the fourth; small parts have no table on their page."""
    key, url = F.col("p_partkey"), lambda k: F.concat(F.lit("http://docs/x/p"), k.cast("string"))
    parts = table(spark, sf_dir, "part")
    row = F.concat(F.lit("<table><tr><th>Column</th><th>Comments</th></tr><tr><td>C"), (key % 7).cast("string"), F.lit("</td><td>"), F.col("p_name"), F.lit("</td></tr></table>"))
    read = parts.select(url(key).alias("url"), F.when(F.col("p_size") < 10, "<p>nothing</p>").otherwise(row).alias("html"))
    links = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: url(key + j))
    keys = parts.select(key.alias("key"), F.concat(F.lit("p"), (key + 3).cast("string")).alias("table_name"), F.concat(F.lit("C"), (key % 5).cast("string")).alias("column"), links.alias("links"))
    return search.search_and_try(keys, read, "oedmf").select("key", "description", "doc_url", "provider", F.col("tries").cast("long").alias("tries"))


SQL["q77_search_and_try"] = """
WITH tries AS (SELECT * FROM (VALUES (1, 3), (2, 0), (3, 1), (4, 2), (5, 4), (6, 5)) t(n, j)),
hits AS (SELECT k.p_partkey AS key, n, p.p_name AS description, 'http://docs/x/p' || p.p_partkey AS doc_url FROM part k, tries JOIN part p ON p.p_partkey = k.p_partkey + j WHERE p.p_size >= 10 AND p.p_partkey % 7 = k.p_partkey % 5
   QUALIFY row_number() OVER (PARTITION BY k.p_partkey ORDER BY n) = 1)
SELECT p_partkey AS key, description, coalesce(doc_url, '') AS doc_url, CASE WHEN n IS NULL THEN 'not_found' ELSE 'http' END AS provider, CAST(coalesce(n, 6) AS BIGINT) AS tries FROM part LEFT JOIN hits ON key = p_partkey
"""


def q78_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a table of a fill run; sizes and prices make every state and every type of URL."""
    size, key = F.col("p_size"), F.col("p_partkey")
    before = (size % 7).cast("long")
    updated = F.least(before, (size % 4).cast("long"))
    url = F.when(size % 11 == 0, F.lit(None)).when(size % 2 == 0, "http://h/search?q=a&x=/search?").otherwise("http://h/doc")
    met = F.when((size % 5 == 0) & (updated == 0), 0).otherwise(before)
    rest = F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), F.lit(1), (met - updated).cast("int")), lambda j: F.concat(F.lit("C"), j.cast("string")))
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("T"), key.cast("string")).alias("table"), F.col("p_brand").alias("real_table"), url.alias("url"), (size % 13 == 0).alias("local"), before.alias("before"),
        (size % 9 != 0).alias("fetched"), F.when(size % 3 == 0, 0).otherwise(size).alias("parsed"), met.alias("met"), updated.alias("updated"), rest.alias("unresolved"),
    )
    return ladder.table_diagnostics(rows)


SQL["q78_status_ladder"] = """
WITH a AS (SELECT 'T' || p_partkey AS "table", p_brand AS real_table, p_size AS s, p_size % 7 AS before, least(p_size % 7, p_size % 4) AS up FROM part),
b AS (SELECT *, CASE WHEN s % 5 = 0 AND up = 0 THEN 0 ELSE before END - up AS unres, CASE WHEN s % 11 = 0 THEN '' WHEN s % 2 = 0 THEN 'http://h/search?q=a&x=/search?' ELSE 'http://h/doc' END AS url FROM a),
c AS (SELECT *, CASE WHEN s % 13 = 0 THEN CASE WHEN unres > 0 THEN 'OK_LOCAL_PARTIAL' ELSE 'OK_LOCAL_FULL' END
   WHEN before = 0 THEN 'SKIP_NO_CANDIDATES' WHEN url = '' THEN 'SKIP_NO_URL' WHEN s % 9 = 0 THEN 'ERROR_FETCH'
   WHEN s % 3 = 0 THEN CASE WHEN up = 0 THEN 'WARN_PARSE_EMPTY' ELSE 'OK_LINEAGE_FALLBACK' END
   WHEN up = 0 THEN CASE WHEN s % 5 = 0 THEN 'WARN_NO_CANDIDATES_IN_HTML' ELSE 'WARN_NO_COLUMN_MATCH' END WHEN unres > 0 THEN 'OK_PARTIAL' ELSE 'OK_FULL' END AS status FROM b),
d AS (SELECT *, status NOT IN ('SKIP_NO_CANDIDATES', 'SKIP_NO_URL', 'ERROR_FETCH') AS ended FROM c)
SELECT "table", real_table, url, CASE WHEN s % 13 = 0 THEN 'local_xlsx' WHEN url = '' THEN 'none' WHEN s % 2 = 0 THEN 'search' ELSE 'direct' END AS url_type, status, CAST(before AS BIGINT) AS pre_candidates,
  CAST(CASE WHEN ended AND s % 3 <> 0 THEN s ELSE 0 END AS BIGINT) AS parsed, CAST(CASE WHEN ended THEN up ELSE 0 END AS BIGINT) AS updated,
  CAST(CASE WHEN ended THEN unres WHEN status = 'SKIP_NO_CANDIDATES' THEN 0 ELSE before END AS BIGINT) AS unresolved_after,
  CASE WHEN ended THEN array_to_string(list_transform(range(0, unres), lambda j: 'C' || j), ', ') ELSE '' END AS unresolved_sample FROM d
"""


def q79_work_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a mapping of tables to pages, filtered and renamed by options."""
    mapping = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.when(F.col("s_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit("http://n/"), F.col("s_nationkey").cast("string"))).alias("url"))
    names = [f"supplier#{i:09d}" for i in range(0, 90, 2)]
    return ladder.work_tables(mapping, ", ".join([*names, ""]), [f"{names[i]} = {names[i + 1]}" for i in range(0, 40, 2)] + [f"{names[41]}=elsewhere"])


SQL["q79_work_tables"] = """
WITH m AS (SELECT upper(s_name) AS t, CAST(s_suppkey AS INT) AS k, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'http://n/' || s_nationkey END AS u, CASE WHEN s_nationkey % 3 = 0 THEN ' ' ELSE 'http://n/' || s_nationkey END AS own FROM supplier),
w AS (SELECT *, CAST(substr(t, 10) AS INT) AS i FROM m WHERE CAST(substr(t, 10) AS INT) % 2 = 0 AND CAST(substr(t, 10) AS INT) < 90),
r AS (SELECT *, CASE WHEN i % 4 = 0 AND i < 80 THEN 'SUPPLIER#' || printf('%09d', i + 2) WHEN i = 82 THEN 'ELSEWHERE' ELSE t END AS real_table FROM w)
SELECT r.t AS "table", real_table, coalesce(m.u, r.own) AS url FROM r LEFT JOIN m ON m.t = real_table
"""
