"""Queries on the parity audit over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import audit, scope
from concordia.plans.inputs import table

SQL: dict[str, str] = {}
FIELDS = ["THE", "AND", "FOR", "WITH", "THAT", "FROM"]

_AUDIT = """
WITH norms AS (SELECT doc_id, text, lang, source, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n,
    regexp_matches(text, '(^|[^\\p{L}\\p{M}\\p{N}_])the($|[^\\p{L}\\p{M}\\p{N}_])', 'i') AS strict FROM documents),
fields AS (SELECT unnest(['THE', 'AND', 'FOR', 'WITH', 'THAT', 'FROM']) AS field, unnest(range(1, 7)) AS ord),
missing AS (SELECT doc_id, field, ord FROM norms, fields WHERE NOT contains(n, field)),
counts AS (SELECT doc_id, count(field) AS n_missing, string_agg(field, ',' ORDER BY ord) AS fields FROM missing GROUP BY doc_id),
audits AS (SELECT d.doc_id, lang, source, coalesce(n_missing, 0) AS n_missing, coalesce(fields, '') AS missing,
   CASE WHEN NOT (strict OR contains(n, 'THE')) THEN 'NOT_IN_DOC' WHEN coalesce(n_missing, 0) >= 500 OR coalesce(n_missing, 0) / 6.0 >= 0.5 THEN 'FAIL'
        WHEN n_missing > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status
   FROM norms d LEFT JOIN counts USING (doc_id))
"""


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is audited against FIELDS; it is in scope if it names 'the', as a word or at least inside one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").rlike(r"(?i)\bthe\b").alias("strict"), text.normalize_token(F.col("text")).alias("norm"))
    found = audit.presence(docs, FIELDS)
    pages = (F.col("strict") | F.contains("norm", F.lit("THE"))).cast("int")
    n = F.size("missing").cast("long")
    return found.select("doc_id", "lang", "source", "missing", n.alias("n_missing"), audit.status(pages, n, F.lit(len(FIELDS))).alias("status"))


def q15_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anti join of part-name words, a table, with the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize_token(F.col("text")).alias("norm"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("field")).distinct()
    found = audit.missing_of_table(docs, words, "doc_id")
    return found.select("doc_id", F.size("missing").cast("long").alias("n_missing"), F.array_join("missing", ",").alias("missing"))


SQL["q15_missing_fields"] = """
WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS field FROM part),
norms AS (SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n FROM documents)
SELECT doc_id, count(field) AS n_missing, coalesce(string_agg(field, ',' ORDER BY field), '') AS missing
FROM norms LEFT JOIN words ON NOT contains(n, upper(field)) GROUP BY doc_id
"""


def q16_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audits(spark, sf_dir).select("doc_id", "n_missing", F.array_join("missing", ",").alias("missing"), "status")


SQL["q16_status"] = _AUDIT + "SELECT doc_id, n_missing, missing, status FROM audits"


def q17_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(_audits(spark, sf_dir))


SQL["q17_summary"] = (
    _AUDIT
    + """SELECT count_if(status = 'FAIL')::BIGINT AS n_fail, count_if(status = 'PASS_WITH_WARNINGS')::BIGINT AS n_pass_with_warnings, count_if(status = 'PASS')::BIGINT AS n_pass,
count_if(status = 'NOT_IN_DOC')::BIGINT AS n_not_in_doc, count_if(status <> 'NOT_IN_DOC')::BIGINT AS n_in_doc, coalesce(sum(n_missing) FILTER (status <> 'NOT_IN_DOC'), 0)::BIGINT AS n_missing FROM audits"""
)


def q18_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top(_audits(spark, sf_dir)).select("doc_id", "n_missing", "status")


SQL["q18_top10"] = _AUDIT + "SELECT doc_id, n_missing, status FROM audits WHERE status IN ('FAIL', 'PASS_WITH_WARNINGS') ORDER BY n_missing DESC, doc_id LIMIT 10"


def q19_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference: words of benchmark; the extractor's own flex fields: AND, THAT where the id is even, else FROM."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("field"))
    known = words.select(F.upper("field").alias("field")).where(F.col("field").isin(FIELDS)).distinct()
    reference = known.agg(F.collect_set("field").alias("reference"))  # one row, no more fields than FIELDS
    own = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("And"), F.lit("That"))).otherwise(F.array(F.lit("from")))
    rows = _audits(spark, sf_dir).join(F.broadcast(reference))
    return rows.select("doc_id", F.explode(audit.suppress_in_row(F.col("missing"), own, F.col("reference"))).alias("field"))


SQL["q19_suppression"] = (
    _AUDIT
    + """, ref AS (SELECT DISTINCT upper(unnest(regexp_split_to_array(text, '[^A-Za-z]+'))) AS field FROM benchmark)
SELECT doc_id, field FROM missing m WHERE NOT (field IN (SELECT field FROM ref) AND CASE WHEN doc_id % 2 = 0 THEN field IN ('AND', 'THAT') ELSE field = 'FROM' END)"""
)


def q41_presence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _audits(spark, sf_dir)
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(f), ~F.array_contains("missing", f)) for f in FIELDS]))
    return found.select("doc_id", F.to_json(entries).alias("presence"))


SQL["q41_presence_map"] = (
    _AUDIT + """SELECT doc_id, '{' || string_agg('"' || field || '":' || contains(n, field), ',' ORDER BY ord) || '}' AS presence FROM norms, fields GROUP BY doc_id"""
)


def q42_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record for each audit, as the report lists them."""
    return _audits(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("extractor"), "status", F.col("missing").alias("missing_fields_in_doc"))).alias("record"))


SQL["q42_report_json"] = (
    _AUDIT
    + """SELECT doc_id, '{"extractor":' || doc_id || ',"status":"' || status || '","missing_fields_in_doc":[' || CASE WHEN missing = '' THEN '' ELSE '"' || replace(missing, ',', '","') || '"' END || ']}' AS record FROM audits"""
)


def q54_scope_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of the sources asked for (substring of the folded name), with their rank by missing fields among those kept."""
    from pyspark.sql import Window

    kept = _audits(spark, sf_dir).where(F.contains(text.normalize_token(F.col("source")), F.lit("SRC1")) & (F.col("status") != "NOT_IN_DOC"))
    order = Window.partitionBy("source").orderBy(F.desc("n_missing"), "doc_id")
    return kept.select("doc_id", "source", F.row_number().over(order).cast("long").alias("place"))


SQL["q54_scope_filters"] = _AUDIT + "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_missing DESC, doc_id) AS place FROM audits WHERE contains(upper(source), 'SRC1') AND status <> 'NOT_IN_DOC'"


def q60_capped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature's own caps: at most 40 missing fields and 24 scope tokens of six characters or more."""
    words = F.array_distinct(F.filter(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "), lambda w: F.length(w) >= 6))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(words, 1, 24), ",").alias("tokens"), F.size(F.slice(words, 1, 40)).cast("long").alias("n_sample"))


SQL["q60_capped_samples"] = """
WITH w AS (SELECT doc_id, list_filter(string_split(upper(replace(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), '§', ' ')), ' '), lambda x: len(x) >= 6) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM w),
f AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY doc_id, t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
SELECT d.doc_id, coalesce(string_agg(t, ',' ORDER BY k) FILTER (k <= 24), '') AS tokens, count(t) FILTER (k <= 40) AS n_sample FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""


def q55_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: w != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


SQL["q55_ordered_distinct"] = """
WITH e AS (SELECT item_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z]+') AS l FROM benchmark)),
f AS (SELECT item_id, w, min(i) AS i FROM e WHERE w <> '' GROUP BY ALL)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY item_id
"""


def q62_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verdict(_audits(spark, sf_dir))


SQL["q62_verdict"] = (
    _AUDIT + "SELECT CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'PASS_WITH_WARNINGS' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM audits WHERE status <> 'NOT_IN_DOC'"
)
