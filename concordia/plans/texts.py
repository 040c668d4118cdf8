"""Queries on scalar rules: normalisation, types, names, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import candidates
from concordia.operators.scope import blocks
from concordia.plans.inputs import table

SQL: dict[str, str] = {}
_NORM = "regexp_replace(upper(replace({x}, 'ß', 'ss')), '[^A-Z0-9]', '', 'g')"


def q01_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines are put between all lines first; they are no blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \t\n")).alias("text"))
    return blocks(docs)


SQL["q01_blocks"] = """
SELECT doc_id, generate_subscripts(b, 1) AS page_no, unnest(b) AS block FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)
"""


def q02_normalize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalize_token(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", norm.alias("token"))


SQL["q02_normalize_token"] = f"SELECT doc_id, {_NORM.format(x='text')} AS token FROM documents"


def q03_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_accents(F.col("text")).alias("token"))


SQL["q03_fold_accents"] = "SELECT doc_id, regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z0-9]', '', 'g') AS token FROM documents"


def q04_normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.replace(F.replace("text", F.lit(" the "), F.lit("  the\t")), F.lit(". "), F.lit(".  "))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(F.concat(F.lit(" \t"), odd, F.lit(" "))).alias("text"))


SQL["q04_normalize_ws"] = """
SELECT doc_id, trim(regexp_replace(replace(chr(9) || replace(replace(text, ' the ', ' ' || chr(160) || 'the' || chr(9)), '. ', '.  '), chr(160), ' '), '\\s+', ' ', 'g')) AS text FROM documents
"""

_DECLARED = ["xsd:string", "xs:INT", "decimal", "xsd:date", "dateTime", " xsd:boolean ", "", "foo:bar", "time", "positiveInteger", "a:anyURI", "FLOAT"]
_VENDOR = ["VARCHAR2", "NUMBER", "NUMBER", "DATE", "TIMESTAMP", "VARCHAR2", "N/A", "N/A", "TIMESTAMP", "NUMBER", "VARCHAR2", "NUMBER"]


def q05_xsd_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.element_at(F.array(*[F.lit(x) for x in _DECLARED]), (F.col("p_partkey") % len(_DECLARED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.xsd_type(declared).alias("data_type"))


SQL["q05_xsd_type"] = f"SELECT p_partkey, ({_VENDOR}::VARCHAR[])[p_partkey % {len(_VENDOR)} + 1] AS data_type FROM part"


def q06_infer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 7
    sample = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format("ts", "dd/MM/yyyy"))
        .when(kind == 3, F.format_string("%.2f", "value"))
        .when(kind == 4, F.lit("  "))
        .when(kind == 5, F.concat(F.lit("-"), F.replace(F.format_string("%.1f", "value"), F.lit("."), F.lit(","))))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.infer_type(sample).alias("data_type"))


SQL["q06_infer_type"] = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'DATE' WHEN 1 THEN 'TIMESTAMP' WHEN 2 THEN 'DATE' WHEN 3 THEN 'NUMBER' WHEN 4 THEN 'N/A' WHEN 5 THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type FROM events
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda by, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat("p_type", F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit("")), pick(key, "", "_TEST", "_Bkp2", "-Copy1", "_Debug", "_Incremental", ""), pick(size, "", "_v1", "-V2", "_v3"), F.lit(".xdmz"))
    modified = F.timestamp_seconds(F.lit(1577836800) + key * 3600)
    return table(spark, sf_dir, "part").select(key.alias("ord"), name.alias("file_name"), modified.alias("modified"))


def q07_candidate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates.classify(_files(spark, sf_dir))
    return c.select("ord", "group_key", F.col("version").cast("long").alias("version"), "official", F.array_join("reasons", ",").alias("reasons"), F.round("score", 3).alias("score"))


_CANDIDATES = """
WITH c AS (
  SELECT p_partkey AS ord,
         p_type || '_' || replace(p_brand, '#', '') || (['', '_TEST', '_Bkp2', '-Copy1', '_Debug', '_Incremental', ''])[p_partkey % 7 + 1] AS group_key,
         (p_size % 4)::BIGINT AS version,
         (['', 'TEST', 'BKP', 'COPY', 'DEBUG', '', ''])[p_partkey % 7 + 1] AS reasons,
         (1577836800 + p_partkey * 3600) / 1000.0 AS age
  FROM part),
s AS (SELECT ord, group_key, version, reasons = '' AS official, reasons,
             round(CASE WHEN reasons = '' THEN 10000000 ELSE 0 END + CASE WHEN version = 0 THEN 1000000 ELSE 0 END + age - version, 3)::DOUBLE AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY official DESC, (version = 0 AND group_key NOT LIKE '%Incremental') DESC, score DESC, ord) AS place,
             bool_or(official) OVER (PARTITION BY group_key) AS live FROM s)
"""
SQL["q07_candidate_classify"] = _CANDIDATES + "SELECT ord, group_key, version, official, reasons, score FROM s"


def q08_pick_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pick(candidates.classify(_files(spark, sf_dir))).select("group_key", "ord", F.col("version").cast("long").alias("version"))


SQL["q08_pick_candidates"] = _CANDIDATES + "SELECT group_key, ord, version FROM r WHERE live AND place = 1"


def q09_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.rejected(candidates.classify(_files(spark, sf_dir))).select("group_key", "ord")


SQL["q09_rejected"] = _CANDIDATES + "SELECT group_key, ord FROM r WHERE live AND place > 1"


def q10_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("Dm_")), F.when(F.col("p_partkey") % 2 == 0, F.lit("_Extract_Dm")).otherwise(F.lit("-Admin_v2")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.name_variants(key), "|").alias("names"))


SQL["q10_name_variants"] = """
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0
  THEN a || 'Dm_' || b || '_Extract_Dm|' || a || '_' || b || '_Extract|' || a || 'Dm_' || b || '_Dm|' || a || '_' || b
  ELSE a || 'Dm_' || b || '-Admin|' || a || '_' || b || '-Admin|' || a || '_' || b || '-Ain' END AS names FROM w
"""


def q30_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_ws(text.strip_tags(F.col("html"), " ")).alias("plain"))


SQL["q30_strip_tags"] = "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages"


def q47_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(
        F.array(F.concat(F.lit(" schema1."), "n"), F.concat(F.lit('"'), "n", F.lit('"')), F.concat("n", F.lit(" x")), F.lit("select"), F.concat("n", F.lit("()")), F.concat("n", F.lit("$#1")), F.lit("")),
        (F.col("p_partkey") % 7 + 1).cast("int"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).select("p_partkey", raw.alias("raw"))
    return parts.select("p_partkey", text.table_name(F.col("raw")).alias("table_name"), text.is_table_name(F.col("raw")).alias("valid"))


SQL["q47_table_name"] = """
WITH w AS (SELECT p_partkey, p_partkey % 7 AS k, upper(replace(p_name, ' ', '_')) AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n || ' X' WHEN 3 THEN 'SELECT' WHEN 4 THEN n || '()' WHEN 5 THEN n || '$#1' ELSE '' END AS table_name, k IN (0, 5) AS valid FROM w
"""


def q57_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("#?!")).otherwise(F.concat(F.lit("/"), "p_brand", F.lit(" & "), "p_name", F.lit(".csv*")))
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(raw).alias("file_name"))


SQL["q57_safe_name"] = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'extractor' ELSE replace(p_brand, '#', '_') || '_' || replace(p_name, ' ', '_') || '.csv' END AS file_name FROM part"


def q58_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("<b>'"), "s_name", F.lit('" & co'))
    url = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("http://x/?a=1&s="), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.linked_cell(name, url).alias("cell"))


SQL["q58_html_escape"] = """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN '<a href="http://x/?a=1&amp;s=' || s_suppkey || '">' ELSE '' END || '&lt;b&gt;&#x27;' || s_name || '&quot; &amp; co' || CASE WHEN s_suppkey % 3 > 0 THEN '</a>' ELSE '' END AS cell FROM supplier
"""


def q59_local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("{http://ns/"), "n_name", F.lit("}Item"))).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.local_name(tag).alias("tag"))


SQL["q59_local_name"] = "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Item' ELSE n_name END AS tag FROM nation"


def q61_column_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = text.column_letters(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", letters.alias("letters"), text.column_index(letters).alias("back"))


SQL["q61_column_codec"] = """
SELECT p_partkey, CASE WHEN p_partkey >= 702 THEN chr(((p_partkey - 702) // 676 + 65)::INT) ELSE '' END
  || CASE WHEN p_partkey >= 26 THEN chr((((p_partkey - 26) // 26) % 26 + 65)::INT) ELSE '' END || chr((p_partkey % 26 + 65)::INT) AS letters, p_partkey AS back FROM part
"""
