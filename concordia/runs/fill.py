"""Filling descriptions that a comparison left open, from a mapping of tables to pages, rules and a sheet of shared fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import enrich, flex, ladder, pages
from concordia.sources import files, report_files, write_back, writers

#: How a description that is still to be written begins, and tables that are none.
PREFIX, NO_TABLES = "A PREENCHER", ("", "N/A", "MULTI_SOURCE")


@dataclass(frozen=True)
class Options:
    """rows: a table of missing fields as a comparison makes it; mapping: a TABLE=URL file; pages: a table (url, html).

    tables: a comma list of the tables to work on; aliases: ALIAS=REAL_TABLE; rules: a CSV of lineage rules; flex_file: a
    spreadsheet of shared fields; books: a folder of workbooks to fill; skip_pages: local rules alone.
    """

    rows: str
    mapping: str
    out: str
    pages: str = ""
    tables: str = ""
    aliases: list[str] = field(default_factory=list)
    rules: str = ""
    flex_file: str = ""
    books: str = ""
    skip_pages: bool = False


def is_open(description: str = "description"):  # noqa: ANN201
    return F.upper(F.coalesce(F.col(description), F.lit(""))).startswith(PREFIX)


def descriptions(tables: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, column, description) of each table's page, or of pages that its query refers to; (table, fetched, parsed)."""
    met = tables.join(read.select("url", "html"), "url", "left").select("table", "html")
    own, edges = pages.document_info(met.where("html IS NOT NULL"))
    parsed = own.groupBy("key.table").agg(F.count(F.lit(1)).alias("parsed"))
    state = met.select("table", F.col("html").isNotNull().alias("fetched")).join(parsed, "table", "left").select("table", "fetched", F.coalesce("parsed", F.lit(0)).alias("parsed"))
    asked = own.select("key").unionByName(edges.select("key")).distinct()
    found = enrich.describe_recursively(asked, own, edges).where("description IS NOT NULL")
    return found.select("key.table", "key.column", "description"), state


def run(spark: SparkSession, options: Options) -> dict[str, int]:
    """Fills, writes filled_dashboard rows, the remaining rows, the diagnostics of every table and the workbooks; the counts."""
    rows = spark.read.parquet(options.rows).withColumn("row_id", F.xxhash64("name", "field", "dataset"))
    column = F.upper("source_column")
    diagnostics = []
    if options.flex_file:
        ref = flex.reference(files.read_xlsx(files.binary(spark, options.flex_file)))
        told = ref.select(F.col(flex.COLUMNS[0]).alias("__tag"), F.nullif("column_description", F.lit("")).alias("__d"))
        shared = flex.is_flex(F.col("dataset")) & is_open()
        met = rows.join(told, F.upper("field") == F.col("__tag"), "left")
        sums = met.where(shared).agg(F.count(F.lit(1)).alias("before"), F.count("__d").alias("updated"), F.collect_set(F.when(F.col("__d").isNull(), F.upper("field"))).alias("unresolved"))
        size = ref.agg(F.count(F.lit(1)).alias("parsed"))
        diagnostics.append(sums.join(F.broadcast(size)).select(F.lit("G_FLEX_SETUP").alias("table"), F.lit("G_FLEX_SETUP").alias("real_table"), F.lit(options.flex_file).alias("url"), F.lit(True).alias("local"), "before", F.lit(True).alias("fetched"), "parsed", F.col("before").alias("met"), "updated", "unresolved"))
        rows = met.withColumn("description", F.when(shared, F.coalesce("__d", "description")).otherwise(F.col("description"))).drop("__tag", "__d")
    known = spark.createDataFrame([], "table string, column string, description string")
    if not options.skip_pages:
        tables = ladder.work_tables(files.read_mapping(spark, options.mapping), options.tables, options.aliases)
        read = spark.read.parquet(options.pages) if options.pages else spark.createDataFrame([], "url string, html string")
        known, state = descriptions(tables, read)
        mine = rows.where(is_open() & ~F.upper("source_table").isin(*NO_TABLES)).select("row_id", F.col("source_table").alias("table_text"), column.alias("column"))
        every = tables.select(F.col("table").alias("name"), F.col("table").alias("ord"))
        hits = enrich.substring_update(mine, known.join(tables.select("table"), "table").select(F.col("table").alias("name"), F.col("table").alias("ord"), "column", "description"))
        rows = rows.join(hits.where("description IS NOT NULL").select("row_id", F.col("description").alias("__d")), "row_id", "left").withColumn("description", F.coalesce("__d", "description")).drop("__d")
        # what became of each table: its rows, whichever table described them
        named = enrich.substring_matches(mine.select(F.col("table_text").alias("text"), F.lit("").alias("column")).distinct(), every.select("name", F.lit("").alias("column")))
        of = mine.join(named.select(F.col("text").alias("table_text"), "name"), "table_text").join(hits.select("row_id", F.col("description").isNotNull().alias("hit")), "row_id")
        counts = of.groupBy(F.col("name").alias("table")).agg(F.count(F.lit(1)).alias("before"), F.count_if("hit").alias("updated"), F.collect_set(F.when(~F.col("hit"), F.col("column"))).alias("unresolved"))
        told = tables.join(counts, "table", "left").join(state, "table", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        diagnostics.append(told.select("table", "real_table", "url", F.lit(False).alias("local"), zero("before"), "fetched", zero("parsed"), zero("before").alias("met"), zero("updated"), "unresolved"))
        if options.rules:
            rules = files.read_lineage_rules(spark, options.rules)
            lead = rules.join(known.select(F.col("table").alias("target_table"), F.col("column").alias("target_column"), F.col("description").alias("__d")), ["target_table", "target_column"])
            lead = lead.select(F.col("source_table").alias("__t"), F.col("source_column").alias("__c"), "__d")
            met = rows.join(lead, (F.upper("source_table") == F.col("__t")) & (column == F.col("__c")), "left")
            rows = met.withColumn("description", F.when(is_open(), F.coalesce("__d", "description")).otherwise(F.col("description"))).drop("__t", "__c", "__d")
    rows.drop("row_id").write.mode("overwrite").parquet(f"{options.out}/filled")
    filled = spark.read.parquet(f"{options.out}/filled")
    rest = filled.where(is_open())
    left = rest.select("ord", "dataset", F.col("field").alias("xml_tag_name"), "description", F.col("source_table").alias("associated_table"), F.col("source_column").alias("column_name"), F.col("characteristic").alias("column_characteristic"))
    writers.write_remaining(left, f"{options.out}/remaining.csv")
    if diagnostics:
        told = diagnostics[0]
        for d in diagnostics[1:]:
            told = told.unionByName(d)
        told = ladder.table_diagnostics(told)
        report_files.write_csv_files(told, options.out, F.lit("table_diagnostics.csv"), told.columns, ["table"], bom=False, always="table_diagnostics.csv")
    counts = {"rows": filled.count(), "remaining": rest.count()}
    if options.books:
        changed, told = write_back.fill_workbooks(files.binary(spark, options.books, "*.xlsx"), known)
        sums = told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "updated")]).first()  # counted before the books change
        write_back.write_binary(changed)
        counts |= sums.asDict()
    return counts
