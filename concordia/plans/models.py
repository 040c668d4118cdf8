"""Queries on the audit of models end to end, and on the lookups that feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.operators import enrich, flex, jobs, lineage, pages, scope
from concordia.plans.inputs import table
from concordia.plans.scopes import _BLOCKS, _ISLANDS, SQL as _SCOPES

SQL: dict[str, str] = {}
#: Models of every document, and the names each may have there.
MODELS = {"the": ["the", "thx"], "with": ["with", "anvil"], "anvil": ["anvil"], "tion": ["tion", "zzz"]}
#: Datasets of every model: name, source, fields.
DATASETS = [("G_MAIN", "Q_MAIN", ["THE", "AND", "STION", "THATHE", "QUARTZ", "ENTION"]), ("G_FLEX_SETUP", "Q_FLEX", ["ANVIL", "RETHE", "AND", "TION"])]


def _strings(xs: list[str]):
    return F.array(*[F.lit(x) for x in xs])


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), _strings(v).alias("names")) for n, v in MODELS.items()])).alias("m"))
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("dataset"), F.lit(s).alias("source"), _strings(f).alias("fields")) for i, (n, s, f) in enumerate(DATASETS)]
    sets = found.select("doc_id", "m.name", F.explode(F.array(*entries)).alias("d")).select("doc_id", "name", "d.*")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.upper("text"), "[^A-Z]+")).alias("field"))
    return scope.blocks_with_size(docs), found.select("doc_id", "m.*"), sets, words.where(F.col("field").isin(DATASETS[1][2])).distinct()


def _audits(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return jobs.audit_models(*_inputs(spark, sf_dir), mode=mode)


def _flat(audits: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return audits.select("doc_id", "name", "status", joined("doc_pages"), "field_count", joined("missing"), joined("suppressed"))


def q46_audit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models against each document: pages by anchor windows, fields, second chance and suppression of flex fields, status."""
    return _flat(_audits(spark, sf_dir, "anchor-window"))


def q63_audit_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all pages that name the model."""
    return _flat(_audits(spark, sf_dir, "name-match"))


_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"


def _marks(name: str, own: list[str]) -> str:
    loose = " OR ".join(f"contains(n, '{v.upper()}')" for v in own)
    return f"SELECT doc_id, '{name}' AS name, page_no, regexp_matches(block, '(^|{_EDGE})({'|'.join(own)})($|{_EDGE})', 'i') AS strict, {loose} AS loose FROM norms"


_MARKS = (
    _BLOCKS[: _BLOCKS.index("bare AS")]
    + f"""names AS (SELECT unnest({list(MODELS)}) AS name),
norms AS (SELECT *, regexp_replace(upper(replace(block, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n FROM pages),
marks AS ({" UNION ALL ".join(_marks(*m) for m in MODELS.items())}),
best AS (SELECT *, bool_or(strict) OVER (PARTITION BY doc_id, name) AS any_strict FROM marks),
anchors AS (SELECT doc_id, name, page_no FROM best WHERE CASE WHEN any_strict THEN strict ELSE loose END)
"""
)
_TOKENS = ["GMAIN", "MAIN", "QMAIN", "THATHE", "QUARTZ", "ENTION", "GFLEXSETUP", "FLEXSETUP", "QFLEX", "FLEX"]
_PICKED = _SCOPES["q14_select_pages"][len(_BLOCKS + _ISLANDS) :]
_PICKED = _PICKED[: _PICKED.rindex("SELECT doc_id, name, string_agg")].replace("contains(n, 'THATH') OR contains(n, 'ENTI') OR contains(n, 'RING')", " OR ".join(f"contains(n, '{t}')" for t in _TOKENS)).replace("norms AS", "norms2 AS").replace("JOIN norms n", "JOIN norms2 n")
_ORDERED = list(dict.fromkeys(f for _, _, fs in DATASETS for f in fs))
_FIELDS = ", ".join(f"('{f}', {i}, '{next(n for n, _, fs in DATASETS if f in fs)}', {str(f in DATASETS[1][2]).lower()})" for i, f in enumerate(_ORDERED))
_JUDGED = f"""
, scoped AS (SELECT p.doc_id, p.name, string_agg(block, chr(10) ORDER BY page_no) AS s, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pp FROM (SELECT DISTINCT doc_id, name, p FROM picked) p JOIN pages g ON p.doc_id = g.doc_id AND p = page_no GROUP BY ALL),
whole AS (SELECT doc_id, string_agg(block, chr(10) ORDER BY page_no) AS w FROM pages GROUP BY doc_id),
models AS (SELECT doc_id, name FROM documents, names),
texts AS (SELECT m.doc_id, m.name, coalesce(pp, '') AS doc_pages, coalesce(nullif(s, ''), w, '') AS s, coalesce(w, '') AS w FROM models m LEFT JOIN whole USING (doc_id) LEFT JOIN scoped USING (doc_id, name)),
bare AS (SELECT doc_id, name, doc_pages, regexp_replace(upper(replace(s, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS s, regexp_replace(upper(replace(w, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS w FROM texts),
fields AS (SELECT * FROM (VALUES {_FIELDS}) f(field, ord, dataset, flex)),
ref AS (SELECT DISTINCT unnest(regexp_split_to_array(upper(text), '[^A-Z]+')) AS field FROM benchmark),
absent AS (SELECT doc_id, name, field, ord, dataset, flex AND field IN (SELECT field FROM ref) AS known FROM bare, fields WHERE NOT contains(s, field) AND NOT (flex AND contains(w, field))),
counts AS (SELECT doc_id, name, count(*) FILTER (NOT known) AS n, string_agg(field, ',' ORDER BY ord) FILTER (NOT known) AS missing, string_agg(field, ',' ORDER BY ord) FILTER (known) AS suppressed FROM absent GROUP BY ALL),
audits AS (SELECT doc_id, name, CASE WHEN doc_pages = '' THEN 'NOT_IN_DOC' WHEN coalesce(n, 0) >= {len(_ORDERED) / 2} THEN 'FAIL' WHEN coalesce(n, 0) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, doc_pages,
  {len(_ORDERED)}::BIGINT AS field_count, coalesce(missing, '') AS missing, coalesce(suppressed, '') AS suppressed, coalesce(n, 0) AS n FROM bare LEFT JOIN counts USING (doc_id, name))
"""
_COLUMNS = "SELECT doc_id, name, status, doc_pages, field_count, missing, suppressed FROM audits"
SQL["q46_audit_models"] = _MARKS + _ISLANDS + _PICKED + _JUDGED + _COLUMNS
SQL["q63_audit_name_match"] = _MARKS + ", picked AS (SELECT doc_id, name, page_no AS p FROM anchors)" + _JUDGED + _COLUMNS


def q64_missing_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inputs(spark, sf_dir)
    rows = jobs.missing_by_dataset(jobs.audit_models(*found, mode="name-match"), found[2])
    return rows.select("doc_id", "name", "dataset", F.array_join("missing", ",").alias("missing"))


SQL["q64_missing_by_dataset"] = (
    _MARKS + ", picked AS (SELECT doc_id, name, page_no AS p FROM anchors)" + _JUDGED + "SELECT doc_id, name, dataset, string_agg(field, ',' ORDER BY ord) AS missing FROM absent WHERE NOT known GROUP BY doc_id, name, dataset"
)


def q65_card_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document's report cards."""
    rows = _audits(spark, sf_dir, "name-match").where("status IN ('FAIL', 'PASS_WITH_WARNINGS')")
    order = Window.partitionBy("doc_id").orderBy(*jobs.card_order(F.col("status"), F.size("missing"), F.col("name")))
    return rows.select("doc_id", "name", F.row_number().over(order).cast("long").alias("place"))


SQL["q65_card_order"] = (
    _MARKS
    + ", picked AS (SELECT doc_id, name, page_no AS p FROM anchors)"
    + _JUDGED
    + "SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'FAIL' THEN 0 ELSE 1 END, n DESC, upper(name)) AS place FROM audits WHERE status IN ('FAIL', 'PASS_WITH_WARNINGS')"
)


def q66_scope_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_size") > 25, "G_").otherwise("x "), F.col("p_brand"))
    tokens = scope.scope_tokens(name, F.concat(F.lit("q_"), F.col("p_type")), F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens, ",").alias("tokens"))


SQL["q66_scope_tokens"] = """
WITH r AS (SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS b, regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') AS t, p_size > 25 AS g, string_split(upper(p_name), ' ') AS w FROM part),
e AS (SELECT p_partkey, [CASE WHEN g THEN 'G' || b ELSE 'X' || b END, CASE WHEN g THEN b END, 'Q' || t, t] AS head, list_filter(w, lambda x: len(x) >= 6) AS tail FROM r),
u AS (SELECT p_partkey, unnest(list_concat(head, tail)) AS tok, generate_subscripts(list_concat(head, tail), 1) AS i FROM e),
f AS (SELECT p_partkey, tok, min(i) AS i FROM u WHERE tok IS NOT NULL GROUP BY ALL)
SELECT p_partkey, string_agg(tok, ',' ORDER BY i) AS tokens FROM f GROUP BY p_partkey
"""


def q67_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordia.functions import text

    rows = scope.blocks_with_size(table(spark, sf_dir, "documents"))
    hits = scope.relevance_hits(text.normalize_token(F.col("block")), _strings(["RING", "THATH", "ENTI"]))
    return rows.select("doc_id", "page_no", F.array_join(hits, ",").alias("hits")).where("hits <> ''")


SQL["q67_page_hits"] = (
    _BLOCKS[: _BLOCKS.index("bare AS")]
    + """n AS (SELECT doc_id, page_no, regexp_replace(upper(replace(block, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS n FROM pages)
SELECT doc_id, page_no, array_to_string(list_filter(['RING', 'THATH', 'ENTI'], lambda t: contains(n, t)), ',') AS hits FROM n WHERE contains(n, 'RING') OR contains(n, 'THATH') OR contains(n, 'ENTI')"""
)


def q68_flex_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spreadsheet's rows become the reference, the last of a tag; it then describes the fields of flex datasets."""
    k = F.col("p_partkey")
    cells = F.when(k % 50 == 0, F.array(F.lit(" xml Tag name "), F.lit("x"))).otherwise(F.array(F.concat(F.lit(" "), F.lower("p_brand")), F.col("p_name"), F.col("p_type"), F.lit("C1"), F.when(k % 2 == 0, F.lit("")).otherwise("N")))
    ref = flex.reference(table(spark, sf_dir, "part").select(k.alias("row_no"), cells.alias("cells")))
    s = F.col("s_suppkey")
    fields = table(spark, sf_dir, "supplier").select(s, F.when(s % 2 == 0, "g_flex setup").otherwise("G_X").alias("dataset"), F.concat(F.lit("Brand#"), s % 10).alias("field"), F.lit("old").alias("description"), F.lit("T").alias("data_type"), F.when(s % 3 == 0, "N/A").otherwise("KEEP").alias("source_table"), F.lit("").alias("source_column"))
    return flex.describe(fields, ref)


SQL["q68_flex_reference"] = """
WITH r AS (SELECT upper(p_brand) AS tag, p_name, p_type, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'N' END AS c FROM part WHERE p_partkey % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1),
f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'g_flex setup' ELSE 'G_X' END AS dataset, 'Brand#' || s_suppkey % 10 AS field, CASE WHEN s_suppkey % 3 = 0 THEN 'N/A' ELSE 'KEEP' END AS st FROM supplier)
SELECT s_suppkey, dataset, field, coalesce(p_name, 'old') AS description, coalesce(nullif(c, ''), 'T') AS data_type, CASE WHEN st = 'N/A' THEN coalesce(p_type, st) ELSE st END AS source_table, CASE WHEN tag IS NOT NULL THEN 'C1' ELSE '' END AS source_column
FROM f LEFT JOIN r ON s_suppkey % 2 = 0 AND upper(field) = tag
"""


def q69_header_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in other words, cases and rows, attributes on every tag, entities; a header cell that only contains a name is none."""
    k = F.col("p_partkey")
    heads = [
        "<tr class='h'><th>Column</th><th>Type</th><th>Description</th></tr>",
        "<TR id=1><TH scope=col>NAME</TH></TR><tr><td>-</td><td> Data type </td><td>Comment</td></tr>",
        "<tr><td>Username</td><td>Mimetype</td><td>x</td></tr><tr><td><b>column</b> name</td><td>n</td><td>Comments</td></tr>",
        "<tr><td>Name</td><td>n</td></tr>",
    ]
    head = F.get(_strings(heads), (k % 4).cast("int"))
    page = F.concat(F.lit("<table>"), head, F.lit("<tr valign=top><td>p_size</td><td>&lt;NUMBER&gt;</td><td>first\n part &amp; "), F.col("p_name"), F.lit("</td></tr><TR><TD>P_SIZE</TD><TD>DATE</TD><TD>second</TD></TR></table>"))
    return pages.column_metadata(table(spark, sf_dir, "part").select("p_partkey", page.alias("html"), F.lit("P-size").alias("column")), "p_partkey")


SQL["q69_header_variants"] = """
SELECT p_partkey, 'first part & ' || p_name AS description, CASE WHEN p_partkey % 4 = 2 THEN 'N/A' ELSE '<NUMBER>' END AS data_type FROM part
"""


def q70_text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table names the column: the text around its first mention, and a type in it."""
    page = F.concat(F.repeat(F.lit("abc "), F.col("p_size") * 3), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit(" is a varchar2 field ")).otherwise(" says nothing "), F.repeat(F.lit("wx  yz "), F.lit(60)))
    return pages.column_metadata(table(spark, sf_dir, "part").select("p_partkey", page.alias("html"), F.upper("p_name").alias("column")), "p_partkey")


SQL["q70_text_metadata"] = """
WITH p AS (SELECT p_partkey, p_size, p_name, repeat('abc ', p_size * 3) || p_name || CASE WHEN p_size % 2 = 0 THEN ' is a varchar2 field ' ELSE ' says nothing ' END || repeat('wx  yz ', 60) AS t FROM part),
s AS (SELECT p_partkey, p_size, t, instr(upper(t), upper(p_name)) AS i FROM p),
c AS (SELECT p_partkey, p_size, trim(regexp_replace(substr(t, greatest(1, i - 220), least(len(t), i - 1 + 320) - greatest(1, i - 220) + 1), '\\s+', ' ', 'g')) AS around FROM s)
SELECT p_partkey, substr(around, 1, 200) AS description, CASE WHEN p_size % 2 = 0 THEN 'VARCHAR2' ELSE 'N/A' END AS data_type FROM c
"""


def _documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: described columns, and a query over the pages of parts k div 2 and k div 3."""
    k = F.col("p_partkey")
    t = lambda x: F.concat(F.lit("T"), x.cast("string"))
    rows = F.concat(F.lit("<tr><td>NAME</td><td>Type</td><td>l</td><td>p</td><td>n</td><td>Comments</td></tr>"), F.when(k % 7 == 3, F.concat(F.lit("<tr><td>C0</td><td>NUMBER</td><td>1</td><td>2</td><td>3</td><td> "), F.col("p_name"), F.lit("</td></tr>"))).otherwise("<tr><td>C0</td><td>few</td></tr>"))
    sql = F.concat(F.lit("<pre>SELECT a.c0, NVL(b.c0, a.c0) AS c1 FROM s."), t(F.expr("p_partkey div 2")), F.lit(" a, "), t(F.expr("p_partkey div 3")), F.lit(" b</pre>"))
    return table(spark, sf_dir, "part").select(t(k).alias("table"), F.concat(F.lit("<p>x</p>"), rows, F.when(k > 0, sql).otherwise("<pre>none</pre>")).alias("html"))


def q71_document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and references of all pages, as one list."""
    told, refs = pages.document_info(_documentation(spark, sf_dir))
    out = told.select("key.table", "key.column", F.lit(-1).cast("long").alias("ord"), "description")
    return out.unionAll(refs.select("key.table", "key.column", F.col("ref_ord").cast("long"), F.concat_ws(".", "ref.table", "ref.column")))


SQL["q71_document_info"] = """
SELECT 'T' || p_partkey AS "table", 'C0' AS "column", -1::BIGINT AS ord, p_name AS description FROM part WHERE p_partkey % 7 = 3
UNION ALL SELECT 'T' || p_partkey, 'C0', 0, 'T' || p_partkey // 2 || '.C0' FROM part WHERE p_partkey > 0
UNION ALL SELECT 'T' || p_partkey, 'C1', 0, 'T' || p_partkey // 3 || '.C0' FROM part WHERE p_partkey > 0
UNION ALL SELECT 'T' || p_partkey, 'C1', 1, 'T' || p_partkey // 2 || '.C0' FROM part WHERE p_partkey > 0 AND p_partkey // 2 <> p_partkey // 3
"""


def q72_described_by_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column C0 of each part's page, described there or by the pages its query refers to."""
    told, refs = pages.document_info(_documentation(spark, sf_dir))
    asked = table(spark, sf_dir, "part").select(F.struct(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("table"), F.lit("C0").alias("column")).alias("key"))
    return enrich.describe_recursively(asked, told, refs).select(F.col("key.table").alias("table"), "description", F.col("level").cast("long").alias("level"))


SQL["q72_described_by_documents"] = """
WITH l AS (SELECT p_partkey AS k, unnest(range(0, 5)) AS level FROM part),
c AS (SELECT k, level, k // (1 << level)::BIGINT AS node FROM l WHERE level = 0 OR k // (1 << (level - 1))::BIGINT > 0),
h AS (SELECT * FROM c WHERE node % 7 = 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY level) = 1)
SELECT 'T' || p.p_partkey AS "table", d.p_name AS description, h.level FROM part p LEFT JOIN h ON p.p_partkey = k LEFT JOIN part d ON d.p_partkey = node
"""


def q73_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no map names, fields with a map, and fields that end in _LINK, some of whose base the query holds."""
    k = F.col("p_partkey")
    null = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 3 == 0, "base_Link").when(k % 3 == 1, "gone_link").otherwise("plain").alias("field"),
        F.when(k % 6 == 3, F.lit("select x.other -- base\n from t")).otherwise("select x.BASE /* gone */ from t").alias("sql"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.upper("p_brand"), F.lit("B"))).alias("tables"),
        F.when(k % 5 == 0, "MAPPED").otherwise(null).alias("source_table"),
        F.when(k % 5 == 0, "M").otherwise(null).alias("source_column"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, "DIRECT").otherwise("UNRESOLVED")).otherwise(null).alias("source_mode"),
        F.when(k % 5 == 0, "HIGH").otherwise(null).alias("source_confidence"),
        F.when(k % 10 == 0, "s").otherwise(null).alias("snippet"),
    )
    return lineage.fill_defaults(rows).drop("sql", "tables")


SQL["q73_fill_defaults"] = """
WITH r AS (SELECT p_partkey, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'base_Link' WHEN 1 THEN 'gone_link' ELSE 'plain' END AS field, p_brand FROM part),
l AS (SELECT *, k % 3 = 0 AND k % 6 <> 3 AND (k % 5 <> 0 OR k % 2 <> 0) AS linked FROM r)
SELECT p_partkey, field, CASE WHEN k % 5 = 0 THEN 'MAPPED' WHEN k % 4 = 0 THEN 'N/A' ELSE upper(p_brand) END AS source_table,
  CASE WHEN linked THEN 'BASE' WHEN k % 5 = 0 THEN 'M' ELSE upper(field) END AS source_column,
  CASE WHEN linked THEN 'ALIAS' WHEN k % 5 <> 0 THEN 'UNKNOWN' WHEN k % 2 = 0 THEN 'DIRECT' ELSE 'UNRESOLVED' END AS source_mode,
  CASE WHEN linked THEN 'MEDIUM' WHEN k % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS source_confidence,
  CASE WHEN k % 10 = 0 THEN 's' WHEN linked THEN 'BASE ... BASE_LINK' ELSE '' END AS snippet FROM l
"""


def q74_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), F.col("p_name").alias("column"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(" ").alias("description"))
    return jobs.unresolved(rows, 5).select("table", "n_unresolved", F.array_join("sample", ",").alias("sample"))


SQL["q74_unresolved"] = """
WITH u AS (SELECT DISTINCT p_brand AS "table", upper(p_name) AS c FROM part WHERE p_size <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY c) AS i FROM u)
SELECT "table", count(*) AS n_unresolved, string_agg(c, ',' ORDER BY i) FILTER (i <= 5) AS sample FROM n GROUP BY "table"
"""
