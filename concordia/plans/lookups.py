"""Queries on enrichment: keyed, substring, prefix and recursive lookups, HTML tables and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import enrich, pages
from concordia.plans.inputs import table

SQL: dict[str, str] = {}


def q28_html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(items).alias("i", "item")).select("page_id", (F.col("i") + 1).cast("long").alias("ord"), text.strip_tags(F.col("item")).alias("item"))


SQL["q28_html_items"] = """
SELECT page_id, generate_subscripts(l, 1) AS ord, trim(regexp_replace(unnest(l), '<[^>]*>', '', 'g')) AS item FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pages.harvest_links(F.col("html"), "example.com", ["/"], ["the"])
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(kept).alias("ord", "link"))


def q29_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links to example.com in order, site-relative ones made absolute, without those that hold an excluded part ('the')."""
    return _links(spark, sf_dir).select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "link")


_LINKS = """
WITH e AS (SELECT page_id, replace(unnest(l), '&amp;', '&') AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)),
f AS (SELECT page_id, 'https://example.com' || link AS link, min(i) AS i FROM e WHERE starts_with(link, '/') AND len(link) > 1 GROUP BY ALL),
links AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS ord, link FROM f WHERE NOT contains(lower(link), 'the'))
"""
SQL["q29_html_links"] = _LINKS + "SELECT page_id, ord, link FROM links"


def q32_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best link for the name 'at-ion': a path marker, the name, its bare form; the earliest of equals; none below 4."""
    scored = _links(spark, sf_dir).withColumn("score", enrich.link_score(F.col("link"), F.lit("at-ion"), "/in"))
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("link", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.where("b.score >= 4").select("page_id", "b.link", F.col("b.score").cast("long").alias("score"))


SQL["q32_link_rank"] = (
    _LINKS
    + """, s AS (SELECT page_id, ord, link, (CASE WHEN contains(lower(link), '/in') THEN 5 ELSE 0 END + CASE WHEN contains(lower(link), 'at-ion') THEN 4 ELSE 0 END
   + CASE WHEN contains(regexp_replace(lower(link), '[^a-z0-9]', '', 'g'), 'ation') THEN 2 ELSE 0 END)::BIGINT AS score FROM links)
SELECT page_id, link, score FROM s WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) = 1"""
)


def q31_html_table_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata table for each part is rendered, read back and asked for one of its columns."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    page = F.concat(
        F.lit("<p>x</p><table>"),
        row(F.lit("Other"), F.lit("Cells")),
        row(F.lit("<b>Column Name</b>"), F.lit("Datatype"), F.lit("Comments")),
        row(F.lit("P_BRAND"), F.lit("VARCHAR2(10)"), F.col("p_brand")),
        row(F.lit("P_NAME"), F.concat(F.lit("VARCHAR2("), F.col("p_size").cast("string"), F.lit(")")), F.concat(F.lit("<i>"), F.col("p_name"), F.lit("</i>"))),
        F.lit("</table>"),
    )
    return pages.column_metadata(table(spark, sf_dir, "part").select("p_partkey", page.alias("html"), F.lit("p_name").alias("column")), "p_partkey")


SQL["q31_html_table_desc"] = "SELECT p_partkey, p_name AS description, 'VARCHAR2(' || p_size || ')' AS data_type FROM part"


def q33_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    fields = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tag"),
        "c_custkey",
        F.when(key % 2 == 0, F.col("c_name")).otherwise("").alias("description"),
        F.lit("VARCHAR2").alias("data_type"),
        F.when(key % 3 == 0, F.lit("N/A")).otherwise(F.col("c_name")).alias("source_table"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("COL")).alias("source_column"),
    )
    r = F.col("n_nationkey")
    meta = table(spark, sf_dir, "nation").select(r.alias("tag"), F.when(r % 2 == 0, F.col("n_name")).otherwise("").alias("description"), F.lit("").alias("data_type"), F.col("n_name").alias("source_table"), F.when(r > 2, F.lit("RC")).alias("source_column"))
    return enrich.overlay(fields, meta).select("c_custkey", "description", "data_type", "source_table", "source_column")


SQL["q33_table_lookup"] = """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN n_name WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS description, 'VARCHAR2' AS data_type,
  CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_name END AS source_table, CASE WHEN c_custkey % 5 <> 0 THEN 'COL' WHEN c_nationkey > 2 THEN 'RC' ELSE '' END AS source_column
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def _placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("tab: "), F.col("p_name")).alias("table_text"), F.col("p_brand").alias("column"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of supplier-like names: one row per brand and word, with a blank description for some."""
    parts = table(spark, sf_dir, "part").where("p_size < 14")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_brand").alias("column")).distinct()
    desc = F.when(F.length("name") % 5 == 0, F.lit("")).otherwise(F.concat("name", F.lit(" of "), "column"))
    return words.select("name", F.col("name").alias("ord"), "column", desc.alias("description"))


def q34_theta_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrich.substring_update(_placeholders(spark, sf_dir), _described(spark, sf_dir))
    return out.select("row_id", "matched_table", "description")


_THETA = """
WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name, p_brand AS col FROM part WHERE p_size < 14),
h AS (SELECT p_partkey AS row_id, name, name || ' of ' || col AS d FROM part JOIN t ON p_brand = col AND contains(upper('tab: ' || p_name), upper(name)) WHERE len(name) % 5 <> 0),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY name) = 1)
"""
SQL["q34_theta_update"] = _THETA + "SELECT p_partkey AS row_id, name AS matched_table, d AS description FROM part LEFT JOIN b ON p_partkey = row_id"


def q35_rule_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules (order key -> customer key) lead to the customer's description; the last rule for a key wins."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5000).alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("target"))
    rules = enrich.last_wins(orders, ["key"], "ord")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.col("c_name").alias("description"))
    return rules.join(names, "target", "left").select("key", "target", "description")


SQL["q35_rule_update"] = """
WITH r AS (SELECT o_orderkey % 5000 AS key, o_custkey AS target FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey DESC) = 1)
SELECT key, target, c_name AS description FROM r LEFT JOIN customer ON target = c_custkey
"""


def q36_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    tags = parts.select(F.concat(name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit("_X")).alias("tag"))
    keys = parts.select(F.when(F.col("p_size") < 15, F.substring_index(name, "_", 1)).when(F.col("p_size") < 30, name).when(F.col("p_size") < 40, F.concat(name, F.lit("_"), F.col("p_partkey").cast("string"), F.lit("_X"))).alias("key")).where("key IS NOT NULL")
    return enrich.prefix_match(tags, keys)


SQL["q36_prefix_match"] = """
WITH p AS (SELECT p_partkey AS k, p_size, upper(replace(p_name, ' ', '_')) AS n FROM part),
keys AS (SELECT DISTINCT CASE WHEN p_size < 15 THEN split_part(n, '_', 1) WHEN p_size < 30 THEN n ELSE n || '_' || k || '_X' END AS key FROM p WHERE p_size < 40),
tags AS (SELECT n || '_' || k || '_X' AS tag FROM p)
SELECT tag, arg_max(key, len(key)) AS key FROM tags LEFT JOIN keys ON tag = key OR starts_with(tag, key || '_') GROUP BY tag
"""


def q37_recursive_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k refers to k div 2, then k div 3; every eleventh is described."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    described = parts.where("key % 11 = 3").select("key", F.col("p_name").alias("description"))
    edges = parts.where("key > 0").select("key", F.explode(F.array(F.struct(F.lit(0).alias("ref_ord"), F.expr("key div 2").alias("ref")), F.struct(F.lit(1).alias("ref_ord"), F.expr("key div 3").alias("ref")))).alias("e")).select("key", "e.*")
    return enrich.describe_recursively(parts.select("key"), described, edges).select("key", "description", F.col("level").cast("long").alias("level"))


# A search of one root as a stack machine: the top of the stack is entered, or dropped if it was met before or lies too deep.
SQL["q37_recursive_desc"] = """
WITH RECURSIVE m AS (
  SELECT p_partkey AS root, [{'k': p_partkey, 'l': 0::BIGINT}] AS stack, []::BIGINT[] AS seen, NULL::BIGINT AS hit, NULL::BIGINT AS level FROM part
  UNION ALL
  SELECT root,
    CASE WHEN list_contains(seen, stack[1].k) OR stack[1].l > 4 OR stack[1].k = 0 THEN stack[2:]
         ELSE list_concat([{'k': stack[1].k // 2, 'l': stack[1].l + 1}, {'k': stack[1].k // 3, 'l': stack[1].l + 1}], stack[2:]) END,
    CASE WHEN stack[1].l > 4 THEN seen ELSE list_append(seen, stack[1].k) END,
    CASE WHEN stack[1].k % 11 = 3 AND stack[1].l <= 4 AND NOT list_contains(seen, stack[1].k) THEN stack[1].k END,
    CASE WHEN stack[1].k % 11 = 3 AND stack[1].l <= 4 AND NOT list_contains(seen, stack[1].k) THEN stack[1].l END
  FROM m WHERE hit IS NULL AND len(stack) > 0)
SELECT p.p_partkey AS key, d.p_name AS description, h.level FROM part p LEFT JOIN (SELECT root, hit, level FROM m WHERE hit IS NOT NULL) h ON p.p_partkey = root LEFT JOIN part d ON d.p_partkey = hit
"""


def q38_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn") % 3 == 0, F.md5("text").alias("h")).toDF("conv_id", "turn", "header", "h")
    return enrich.carry_forward(rows, "conv_id", "turn", F.col("header"), F.col("h"), "dataset").select("conv_id", "turn", "dataset")


SQL["q38_carry_forward"] = """
SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS dataset FROM conversations
"""


def q39_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = q34_theta_update(spark, sf_dir).select("row_id", F.col("description").isNotNull().cast("int").alias("updated"))
    rows = table(spark, sf_dir, "part").join(updated, F.col("p_partkey") == F.col("row_id"))
    brand = F.substring("p_brand", 7, 3).cast("int")
    url = F.when(brand % 4 == 0, F.lit("")).when(brand % 4 == 1, F.lit("http://x/search?q=1")).otherwise("http://x/doc")
    live = F.when(brand % 6 == 5, 0).otherwise(1)
    return enrich.diagnostics(rows.select(F.col("p_brand").alias("table"), url.alias("url"), live.alias("candidate"), F.when(brand % 3 == 0, 0).otherwise(1).alias("parsed"), (F.col("updated") * live).alias("updated")))


SQL["q39_diagnostics"] = (
    _THETA
    + """, r AS (SELECT p_brand AS tab, substr(p_brand, 7, 3)::INT AS n, (d IS NOT NULL)::INT AS u FROM part LEFT JOIN b ON p_partkey = row_id),
s AS (SELECT tab, n, (CASE WHEN n % 6 = 5 THEN 0 ELSE count(*) END)::BIGINT AS candidate, (CASE WHEN n % 6 = 5 THEN 0 ELSE sum(u) END)::BIGINT AS updated FROM r GROUP BY tab, n)
SELECT tab AS "table", CASE WHEN n % 4 = 0 THEN 'none' WHEN n % 4 = 1 THEN 'search' ELSE 'direct' END AS url_type,
  CASE WHEN candidate = 0 THEN 'SKIP_NO_CANDIDATES' WHEN n % 4 = 0 THEN 'SKIP_NO_URL' WHEN n % 3 = 0 THEN 'WARN_PARSE_EMPTY' WHEN updated = 0 THEN 'WARN_NO_COLUMN_MATCH' WHEN updated < candidate THEN 'OK_PARTIAL' ELSE 'OK_FULL' END AS status,
  candidate, updated, candidate - updated AS unresolved FROM s"""
)


def q40_remaining_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten tables with most rows that no table described."""
    rest = q34_theta_update(spark, sf_dir).where("description IS NULL").select("row_id")
    rows = table(spark, sf_dir, "part").join(rest, F.col("p_partkey") == F.col("row_id"), "left_semi")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


SQL["q40_remaining_top"] = _THETA + "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT row_id FROM b) GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10"


def q51_enrich_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache before pages before the default, with the provider that answered; a blank answer is none."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    cache = parts.where(key % 3 == 0).select(key, F.when(key % 2 == 0, F.col("p_name")).otherwise(" ").alias("description"))
    found = parts.where(key % 5 < 2).select(key, F.col("p_brand").alias("description"))
    return pages.cascade(parts, "p_partkey", [("cache", cache), ("pages", found)])


SQL["q51_enrich_cascade"] = """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_name WHEN p_partkey % 5 < 2 THEN p_brand ELSE 'N/A' END AS description,
  CASE WHEN p_partkey % 6 = 0 THEN 'cache' WHEN p_partkey % 5 < 2 THEN 'pages' ELSE 'default' END AS provider FROM part
"""


def q52_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's metadata comes from the first dataset (supplier) that has it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("field"), F.struct("l_orderkey", "l_linenumber").alias("ord"), "l_suppkey")
    return enrich.first_wins(lines, ["field"], "ord").select("field", "l_suppkey")


SQL["q52_first_match"] = "SELECT l_partkey AS field, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1"


def q53_placeholder_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of candidates, updated and unresolved rows per type; tables N/A and MULTI_SOURCE are no candidates."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_type", (key % 3 == 0).alias("placeholder"), F.when(key % 4 == 1, "N/A").when(key % 4 == 2, "MULTI_SOURCE").otherwise("T").alias("t"), (F.col("p_size") > 25).alias("known"))
    live = F.col("placeholder") & ~F.col("t").isin("N/A", "MULTI_SOURCE")
    return rows.groupBy("p_type").agg(F.count_if(live).alias("candidates"), F.count_if(live & F.col("known")).alias("updated"), F.count_if(live & ~F.col("known")).alias("unresolved"))


SQL["q53_placeholder_update"] = """
SELECT p_type, count_if(l)::BIGINT AS candidates, count_if(l AND p_size > 25)::BIGINT AS updated, count_if(l AND p_size <= 25)::BIGINT AS unresolved
FROM (SELECT *, p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 3) AS l FROM part) GROUP BY p_type
"""


def q56_lookup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY=VALUE lines with comments, blanks and repeated keys; the last line of a key wins."""
    key = F.col("p_partkey")
    line = F.when(key % 9 == 0, F.lit("# note = x")).when(key % 9 == 1, F.lit("  ")).when(key % 9 == 2, F.lit("no separator")).otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" = http://h/?k="), key.cast("string")))
    lines = table(spark, sf_dir, "part").select(key.alias("ord"), F.btrim(line).alias("line"))
    from concordia.sources.files import mapping_rows

    return mapping_rows(lines).select(F.col("key").alias("table_name"), "url")


SQL["q56_lookup_files"] = """
SELECT upper(p_brand) AS table_name, 'http://h/?k=' || max(p_partkey) AS url FROM part WHERE p_partkey % 9 > 2 GROUP BY p_brand
"""
