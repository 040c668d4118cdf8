"""Round trips: files made from the test tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import lineage
from concordia.plans.inputs import table
from concordia.sources import files, writers

SQL: dict[str, str] = {}
BOOK = 100


def q43_docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOCX of each document, a paragraph per line; blank lines are no blocks."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string"), F.split("text", "\n"))
    got = files.read_docx(writers.encode(docs, writers.docx_bytes))
    return got.select(F.col("path").cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), "block")


SQL["q43_docx_roundtrip"] = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, nr, trim(regexp_replace(line, '\s+', ' ', 'g')) AS block FROM lines)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS page_no, block FROM kept WHERE block <> ''
"""


def q44_xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per BOOK parts with key and name, into which a third column is then written in place."""
    parts = table(spark, sf_dir, "part").withColumn("book", F.floor(F.col("p_partkey") / BOOK).cast("string"))
    books = parts.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("parts"))
    rows = books.select("book", F.transform("parts", lambda x: F.array(x["p_partkey"].cast("string"), x["p_name"])).alias("rows"))
    each = books.select(F.col("book").alias("path"), F.posexplode("parts").alias("at", "part"))
    changes = each.select("path", (F.col("at") + 1).alias("row_no"), F.lit(2).alias("col_no"), F.col("part.p_type").alias("value"))
    changed = writers.update_xlsx(writers.encode(rows, writers.xlsx_bytes), changes)
    got = files.read_xlsx(lineage.spread(changed))  # a step in Python for each stage: a core has one worker, not one for each step
    cell = lambda i: F.get("cells", F.lit(i))
    return got.select(F.col("path").cast("long").alias("book"), F.col("row_no").cast("long").alias("row_no"), cell(0).cast("long").alias("p_partkey"), cell(1).alias("p_name"), cell(2).alias("p_type"))


SQL["q44_xlsx_roundtrip"] = f"""
SELECT p_partkey // {BOOK} AS book, row_number() OVER (PARTITION BY p_partkey // {BOOK} ORDER BY p_partkey) AS row_no, p_partkey, p_name, p_type FROM part
"""


def q45_package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per region whose fields are its nations, with a sample value of each."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    field = F.concat(F.lit("N_"), F.col("n_nationkey"))
    fields = F.sort_array(F.collect_list(F.struct("n_nationkey", field.alias("field"), F.col("n_name"))))
    packed = nations.groupBy(F.col("r_regionkey").cast("string").alias("path")).agg(fields.alias("fields"))
    name = F.concat(F.lit("R_"), F.col("path"))
    sql = F.concat(F.lit("SELECT * FROM NATION WHERE N_REGIONKEY < 9 AND N_REGIONKEY = "), F.col("path"))
    rows = packed.select("path", name.alias("name"), sql.alias("sql"), F.transform("fields", lambda x: F.array(x["field"], F.lit("xsd:string"), x["n_name"])).alias("fields"))
    got = files.read_packages(writers.encode(rows, writers.package_bytes).withColumnsRenamed({"path": "entry", "content": "package"}))
    return got.select(F.col("entry").cast("long").alias("r_regionkey"), "dataset", "source", "sql_text", F.col("ord").cast("long").alias("ord"), "field", "declared", "sample")


SQL["q45_package_roundtrip"] = """
SELECT r_regionkey, 'G_R_' || r_regionkey AS dataset, 'Q_R_' || r_regionkey AS source,
    'SELECT * FROM NATION WHERE N_REGIONKEY < 9 AND N_REGIONKEY = ' || r_regionkey AS sql_text,
    row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS ord, 'N_' || n_nationkey AS field, 'xsd:string' AS declared, n_name AS sample
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
