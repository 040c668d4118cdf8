"""The comparison: packages of models against one published document, with its reports."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import audit, cache, candidates, flex, jobs, lineage, scope, search
from concordia.runs.stages import Stages
from concordia.sources import files, report_files, writers

#: Fixed value: what stands for a description that is still to be written.
PLACEHOLDER = "A preencher pela documentacao funcional 5"
#: Of the missing fields, shown in the scope report.
SAMPLE = 40


@dataclass(frozen=True)
class Options:
    """What a comparison reads and writes.

    packages: a bundle (.xdrz), a package or a folder of packages (.xdmz); names: a comma list of their file names or stems;
    document: a .docx file; out: the folder of the reports. extractor: a comma list, models whose name holds one of it are
    compared alone. flex_file: a spreadsheet of shared fields. pages (url, html) and links (table, links array) are tables to look
    descriptions up in; cache: the folder of answers.
    """

    packages: str
    document: str
    out: str
    names: str = ""
    extractor: str = ""
    scope_mode: str = "anchor-window"
    include_pass: bool = False
    scope_debug: bool = False
    flex_file: str = ""
    pages: str = ""
    links: str = ""
    cache: str = ""
    marker: str = "oedmf"

    def check(self) -> None:
        if not self.document.lower().endswith(".docx"):
            raise ValueError(f"the document is no .docx file: {self.document}")
        if not self.packages:
            raise ValueError("no packages are named")
        if bool(self.pages) != bool(self.links):
            raise ValueError("pages and links are given together or not at all")


def archive(spark: SparkSession, options: Options) -> DataFrame:
    """(path, ord, entry, file_name, modified, package) of the bundle, or of the packages of a folder, by name in capitals."""
    if options.packages.lower().endswith(".xdrz"):
        found = files.read_archive(files.binary(spark, options.packages))
    else:
        loose = files.binary(spark, options.packages, "*.[xX][dD][mM][zZ]").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        found = loose.select(F.lit(options.packages).alias("path"), F.lit(0).alias("ord"), F.col("file_name").alias("entry"), "file_name", F.col("modificationTime").alias("modified"), F.col("content").alias("package"))
    wanted = [n.strip().upper() for n in options.names.split(",") if n.strip()]
    stem = F.regexp_replace(F.upper("file_name"), r"\.[^.]*$", "")
    return found.where(F.upper("file_name").isin(wanted) | stem.isin(wanted)) if wanted else found


def requested(models: DataFrame, extractor: str, name: str = "group_key") -> DataFrame:
    """Models whose name holds one of the comma list, accents, case and white space aside; all if it is blank. None: an error."""
    spark = models.sparkSession
    plain = lambda c: F.lower(text.normalize_ws(text.fold_accents(c)))
    asked = [r[0] for r in spark.createDataFrame([(x,) for x in extractor.split(",")], "x string").select(plain(F.col("x"))).collect() if r[0]]
    if not asked:
        return models
    kept = models.withColumn("__plain", plain(F.col(name)))
    kept = kept.where(F.exists(F.array(*[F.lit(a) for a in asked]), lambda a: F.contains(F.col("__plain"), a))).drop("__plain")
    if kept.isEmpty():
        raise ValueError(f"no model is called like {extractor}")
    return kept


def package_fields(chosen: DataFrame) -> DataFrame:
    """(name, dataset, source, dataset_ord, ord, field, data_type, sample, source_table, .., reason): every field of the chosen packages.

    chosen (entry, package, group_key). A field's source is what its dataset's query says, checked against the query's tables.
    """
    rows = files.read_packages(chosen).withColumn("at", F.monotonically_increasing_id())  # rows of a package follow each other
    rows = rows.join(chosen.select("entry", F.col("group_key").alias("name")), "entry").withColumn("query", F.sha2("sql_text", 256))
    queries = rows.where("coalesce(sql_text, '') <> ''").select("query", F.col("sql_text").alias("sql")).distinct()
    tables = lineage.sources(queries, "query")
    told = lineage.post_resolve(lineage.lineage(queries, "query", with_sources=True)).drop("tables", "aliases", "ord")
    told = told.withColumn("out_alias", F.upper("out_alias"))
    met = rows.join(tables.select("query", "tables"), "query", "left").withColumn("out_alias", F.upper("field")).join(told, ["query", "out_alias"], "left").withColumn("sql", F.col("sql_text"))
    filled = lineage.fill_defaults(met)
    kind = F.coalesce(F.nullif(text.xsd_type(F.col("declared")), F.lit("")), text.infer_type(F.col("sample")))
    first = F.min("at").over(_window("name", "dataset"))
    return filled.select("name", "dataset", "source", first.alias("dataset_ord"), F.col("at").alias("ord"), "field", kind.alias("data_type"), "sample", "source_table", "source_column", "source_mode", "source_confidence", "snippet", F.coalesce("reason", F.lit("")).alias("reason"))


def _window(*by: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def enriched(missing: DataFrame, options: Options) -> DataFrame:
    """missing (.., source_table, source_column, data_type) with description, characteristic, doc_url and provider.

    Keys that the cache does not hold are searched in the pages, and their answers are added to it.
    """
    spark, none = missing.sparkSession, F.lit(None).cast("string")
    if options.pages:
        store = cache.EnrichmentCache(spark, options.cache or f"{options.out}/cache")
        cached = store.load()
        keys = cache.to_ask(missing.select(F.col("source_table").alias("table"), F.col("source_column").alias("column")), cached)
        links = spark.read.parquet(options.links).select(F.upper("table").alias("table"), "links")
        asked = keys.join(links, "table", "left").select(F.struct("table", "column").alias("key"), F.col("table").alias("table_name"), "column", "links")
        found = search.search_and_try(asked, spark.read.parquet(options.pages), options.marker)
        answers = found.select("key.table", "key.column", "description", "characteristic", "doc_url", "matched", "provider", F.unix_micros(F.current_timestamp()).alias("asked_at"))
        if not answers.isEmpty():
            store.flush(cache.merge(cached, answers))
            cached = store.load()
        told = cached.select(F.col("table").alias("__t"), F.col("column").alias("__c"), F.when(F.col("matched"), F.nullif("description", F.lit(""))).alias("d"), F.nullif("characteristic", F.lit("N/A")).alias("k"), "doc_url", "provider")
        rows = missing.join(told, (F.upper("source_table") == F.col("__t")) & (F.upper("source_column") == F.col("__c")), "left").drop("__t", "__c")
    else:
        rows = missing.withColumns({"d": none, "k": none, "doc_url": F.lit(""), "provider": F.lit("none")})
    return rows.withColumns({"description": F.coalesce("d", F.lit(PLACEHOLDER)), "characteristic": F.coalesce(F.nullif("k", F.lit("")), "data_type", F.lit("N/A")), "doc_url": F.coalesce("doc_url", F.lit(""))}).drop("d", "k")


def run(spark: SparkSession, options: Options) -> tuple[str, Stages]:
    """Compares and writes the reports; the verdict, and which stages had to be made.

    Reports: comparison_report.json and .md, comparison_dashboard.html, by_extractor/*.csv and, if asked for,
    comparison_scope_debug.json. A package that cannot be read is a model without fields; broken_files.csv lists those.
    """
    options.check()
    told = {k: v for k, v in asdict(options).items() if k not in ("out", "include_pass", "scope_debug", "cache")}
    stages = Stages(spark, f"{options.out}/_stages", [options.packages, options.document, options.flex_file, options.pages, options.links], told)
    ranked = stages.run("candidates", lambda: candidates.ranked(candidates.classify(archive(spark, options))))
    chosen = requested(ranked.where("place = 1"), options.extractor)
    blocks = stages.run("blocks", lambda: _blocks(spark, options.document))
    fields = stages.run("fields", lambda: package_fields(chosen))
    reference = flex.reference(files.read_xlsx(files.binary(spark, options.flex_file))) if options.flex_file else None
    if reference is not None:
        renamed = {"data_type": "data_type", "source_table": "source_table", "source_column": "source_column"}
        fields = flex.describe(fields.withColumn("description", F.lit("")), reference).withColumns({c: F.col(c) for c in renamed})
    else:
        fields = fields.withColumn("description", F.lit(""))
    models = chosen.select(F.lit(1).alias("doc_id"), F.col("group_key").alias("name"), text.name_variants(F.col("group_key")).alias("names"), "entry", "file_name")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"])
    datasets = fields.groupBy("name", "dataset", "source", F.col("dataset_ord").alias("ord")).agg(ordered.alias("fields")).select(F.lit(1).alias("doc_id"), "name", "ord", "dataset", "source", "fields")
    known = None if reference is None else reference.select(F.col(flex.COLUMNS[0]).alias("field"))
    audits = stages.run("audits", lambda: jobs.audit_models(blocks, models, datasets, known, options.scope_mode, dealt=True))
    missing = stages.run("missing", lambda: enriched(_missing_rows(audits, fields), options))
    rejected = ranked.where("place > 1").join(chosen.select("group_key"), "group_key", "left_semi")
    _reports(options, audits, models, fields, missing, rejected)
    bad = files.broken(chosen.select(F.col("entry").alias("path"), F.col("package").alias("content")), files.package_rows)
    report_files.write_csv_files(bad, options.out, F.lit("broken_files.csv"), ["path", "error"], ["path"], bom=False, always="broken_files.csv")
    return audit.verdict(audits).first()["verdict"], stages


def _blocks(spark: SparkSession, document: str) -> DataFrame:
    rows = files.read_docx(files.binary(spark, document))
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_pages"))
    return rows.join(sizes, "path").select(F.lit(1).alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), "block", "table_text", "n_pages")


def _missing_rows(audits: DataFrame, fields: DataFrame) -> DataFrame:
    """Missing fields with the details of the first dataset that has them."""
    lost = audits.select("name", F.explode("missing").alias("field"))
    details = [c for c in fields.columns if c not in ("name", "field", "ord", "dataset_ord")]
    first = fields.groupBy("name", "field").agg(F.min(F.struct("dataset_ord", "ord", *details)).alias("f"))
    return lost.join(first, ["name", "field"]).select("name", "field", "f.*")


def _reports(options: Options, audits: DataFrame, models: DataFrame, fields: DataFrame, missing: DataFrame, rejected: DataFrame) -> None:
    spark = audits.sparkSession
    flat = audits.select(F.col("name").alias("extractor"), "status", F.size("missing").cast("long").alias("n_missing"))
    detail = F.struct(*[F.col(c) for c in ("ord", "field", "data_type", "sample", "source_table", "source_column", "source_mode", "source_confidence", "reason")])
    sets = fields.groupBy("name", "dataset", "source", "dataset_ord").agg(F.array_sort(F.collect_list(detail)).alias("fields"))
    sets = sets.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("dataset_ord").alias("ord"), "dataset", "source", "fields"))).alias("datasets"))
    worse = rejected.groupBy(F.col("group_key").alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", "file_name", "entry", "official", "reasons", "version", F.round("score", 2).alias("score")))).alias("rejected_candidates"))
    report = audits.join(models.select("name", "names", "entry", "file_name"), "name").join(sets, "name", "left").join(worse, "name", "left")
    presence = F.map_from_entries("field_presence")
    nested = report.select(
        F.col("name").alias("extractor"), F.col("entry").alias("selected_entry"), F.col("file_name").alias("selected_file"), "status", F.col("names").alias("doc_search_names"), "doc_pages", "field_count",
        F.col("missing").alias("missing_fields_in_doc"), F.coalesce("datasets", F.array()).alias("datasets"), F.coalesce("rejected_candidates", F.array()).alias("rejected_candidates"),
        F.struct(F.lit(options.scope_mode).alias("scope_mode"), F.col("suppressed").alias("flex_setup_suppressed_missing_fields"), presence.alias("field_presence")).alias("scope_debug"),
    )
    writers.write_json(nested, f"{options.out}/comparison_report.json", ("extractor",))
    writers.write_lines(spark, f"{options.out}/comparison_report.md", writers.markdown(flat))
    cells = missing.withColumn("row", writers.table_row(*[F.col(c) for c in ("field", "description", "source_table", "doc_url", "source_column", "characteristic")]))
    cards = rejected.select(F.col("group_key").alias("extractor"), "file_name", "reasons")
    writers.write_dashboard(flat, cells.select(F.col("name").alias("extractor"), "dataset", "ord", "row"), f"{options.out}/comparison_dashboard.html", options.include_pass, "DocSync", cards)
    own = missing.select(F.col("name").alias("extractor"), "ord", "dataset", F.col("field").alias("xml_tag_name"), F.col("source_column").alias("column_name"), F.col("characteristic").alias("column_characteristic"), F.col("source_table").alias("associated_table_to_each_column"))
    sources = fields.select(F.col("name").alias("extractor"), "ord", "dataset", F.col("field").alias("xml_tag_name"), "source_table", "source_column", "source_mode", "source_confidence", F.col("reason").alias("source_validation_reason"), F.col("snippet").alias("source_sql_snippet"))
    writers.write_csvs(flat, own, sources, options.out)
    if options.scope_debug:
        shown = report.select(
            F.col("name").alias("extractor"), F.col("file_name").alias("selected_file"), "doc_pages", F.size("missing").alias("missing_fields_count"), F.slice("missing", 1, SAMPLE).alias("missing_fields_sample"),
            F.struct(F.col("names").alias("doc_search_names"), presence.alias("field_presence"), F.col("suppressed").alias("suppressed")).alias("scope_debug"), F.lit(options.scope_mode).alias("scope_mode"),
        )
        writers.write_json(shown, f"{options.out}/comparison_scope_debug.json", ("extractor",))
