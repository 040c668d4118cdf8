"""The audit of every model against its document, end to end, as one plan over many documents and models.

Blocks, models and datasets meet by doc_id only, in one row for each document: its blocks are shuffled once, whatever the number of
its models, and normalised once. A model's pages are taken from that row, and all its fields are looked for there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.operators import audit, flex, scope

#: How pages are chosen: by the windows between anchors, or all that name the model.
MODES = ("anchor-window", "name-match")


def model_names(models: DataFrame) -> DataFrame:
    """models (doc_id, name) with names: the spellings of the model's group that documents may use."""
    return models.select("doc_id", "name", text.name_variants(F.col("name")).alias("names"))


def model_fields(datasets: DataFrame) -> DataFrame:
    """(doc_id, name, fields, flex_fields, tokens) from datasets (doc_id, name, ord, dataset, source, fields): distinct, in order."""
    entry = F.struct("ord", "fields", flex.is_flex(F.col("dataset")).alias("flex"), scope.scope_tokens(F.col("dataset"), F.col("source"), F.col("fields")).alias("tokens"))
    held = datasets.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(entry)).alias("d"))
    flat = lambda xs: F.array_distinct(F.flatten(xs))
    return held.select(
        "doc_id",
        "name",
        flat(F.transform("d", lambda x: x["fields"])).alias("fields"),
        flat(F.transform(F.filter("d", lambda x: x["flex"]), lambda x: F.transform(x["fields"], F.upper))).alias("flex_fields"),
        flat(F.transform("d", lambda x: x["tokens"])).alias("tokens"),
    )


def _documents(pages: DataFrame, models: DataFrame, how: str) -> DataFrame:
    """(doc_id, groups, pages, n_pages): models (doc_id, name, names, ..) meet their document once, as an array beside its pages."""
    terms = scope.search_terms(F.col("names")).alias("terms")
    groups = models.select("doc_id", F.struct("name", terms, *[c for c in models.columns if c not in ("doc_id", "name", "names")]).alias("g"))
    # by size, guessed from a small file, the driver would broadcast the pages
    held = groups.groupBy("doc_id").agg(F.collect_list("g").alias("groups")).join(scope.page_lists(pages).hint("merge"), "doc_id", how)
    none = F.array().cast(held.schema["pages"].dataType)
    return held.select("doc_id", "groups", scope.with_norms(F.coalesce("pages", none)).alias("pages"), F.coalesce("n_pages", F.lit(0).cast("long")).alias("n_pages"))


def _choices(row: Column, mode: str) -> Column:
    """Structs (name, pages) of a row of _documents(): of every group, in their order, for name-match; else of those that are named."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    anchors = F.transform(row["groups"], lambda g: F.struct(g["name"].alias("name"), scope.named_pages(row["pages"], g["terms"]).alias("pages")))
    if mode == "name-match":
        return anchors

    def pick(w: Column) -> Column:
        own = F.coalesce(F.get(F.filter(row["groups"], lambda g: g["name"] == w["name"]), 0)["tokens"], F.array().cast("array<string>"))
        chosen = text.let(own, lambda t: scope.select_pages(w, row["pages"], row["n_pages"], t))
        return F.struct(w["name"].alias("name"), chosen.alias("pages"))

    return F.transform(scope.anchor_windows(anchors, row["n_pages"], F.size(F.array_distinct(F.transform(row["groups"], lambda g: g["name"])))), pick)


def chosen_pages(pages: DataFrame, models: DataFrame, fields: DataFrame, mode: str) -> DataFrame:
    """(doc_id, name, pages) for models whose document names them; pages: blocks_with_size()."""
    told = models.select("doc_id", "name", "names").join(fields.select("doc_id", "name", "tokens"), ["doc_id", "name"], "left")
    held = _documents(pages, told, "inner")
    chosen = held.select("doc_id", F.inline_outer(F.transform(text.let(F.struct("pages", "groups", "n_pages"), lambda row: _choices(row, mode)), lambda x: F.struct(x.alias("x")))))
    return chosen.where("x IS NOT NULL AND size(x.pages) > 0").select("doc_id", "x.*")


def _chosen_by_model(row: Column, mode: str) -> Column:
    """The groups of a row of _documents() with chosen, the numbers of their pages; models of one name have the same pages."""

    def choose(found: Column) -> Column:
        of_name = lambda g: F.array_distinct(F.flatten(F.transform(F.filter(found, lambda x: x["name"] == g["name"]), lambda x: x["pages"])))
        once = F.size(F.array_distinct(F.transform(found, lambda x: x["name"]))) == F.size(found)
        numbers = (lambda g, i: F.when(once & g["name"].isNotNull(), F.get(found, i)["pages"]).otherwise(of_name(g))) if mode == "name-match" else (lambda g, i: of_name(g))
        return F.transform(row["groups"], lambda g, i: F.struct(*[g[c].alias(c) for c in ("name", "fields", "flex_fields", "described")], numbers(g, i).alias("chosen")))

    return text.let(_choices(row, mode), choose)


def _own(pages: Column, dense: Column, chosen: Column) -> Column:
    """The pages with the chosen numbers; dense: they are numbered from 1 without gaps, so a number is a place."""
    inside = F.filter(F.array_sort(chosen), lambda p: p.between(1, F.size(pages)))
    return F.when(dense, F.transform(inside, lambda p: F.get(pages, (p - 1).cast("int")))).otherwise(F.filter(pages, lambda x: F.array_contains(chosen, x["page_no"])))


def _texts(pages: Column) -> list[Column]:
    """Joined blocks and tables. The normalised forms are joined as well: a line break has none, and each letter's is its own."""
    tables = F.transform(pages["table_text"], lambda t: F.coalesce(t, F.lit("")))
    return [
        F.array_join(pages["block"], "\n").alias("raw"),
        F.array_join(pages["norm"], "").alias("norm"),
        F.array_join(tables, "\n").alias("table_raw"),
        F.array_join(F.transform(tables, text.normalize_token), "").alias("table_norm"),
    ]


def audit_models(pages: DataFrame, models: DataFrame, datasets: DataFrame, reference: DataFrame | None = None, mode: str = "anchor-window", dealt: bool = False) -> DataFrame:
    """(doc_id, name, status, doc_pages, field_count, missing, suppressed, field_presence): one row for each model.

    pages: blocks_with_size(), with table_text if blocks have tables; models (doc_id, name, names); datasets as for model_fields();
    reference (field): fields of the flex reference, of any number. A field is looked for in the texts and tables of the model's
    pages, or of the whole document where those are empty; a flex field that is not there may be anywhere in the document; a flex
    field that the reference describes is never reported. dealt: for few documents of many models, which then go to all cores, each
    with its own texts; else no text leaves its document's row.
    """
    fields = model_fields(datasets)
    told = models.select("doc_id", "name", "names").join(fields, ["doc_id", "name"], "left")
    none = F.array().cast("array<string>")
    if reference is None:
        told = told.withColumn("described", none)
    else:  # the flex fields of each model that the reference holds
        flexed = fields.select("doc_id", "name", F.explode("flex_fields").alias("__f")).join(reference.select(F.upper("field").alias("__f")).distinct(), "__f", "left_semi")
        told = told.join(flexed.groupBy("doc_id", "name").agg(F.collect_set("__f").alias("described")), ["doc_id", "name"], "left")
    pages = pages if "table_text" in pages.columns else pages.withColumn("table_text", F.lit(None).cast("string"))
    held = _documents(pages, told.withColumns({c: F.coalesce(c, none) for c in ("fields", "flex_fields", "described")}), "left")
    numbers = F.col("pages.page_no")
    dense = (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.coalesce(F.get(numbers, 0), F.lit(1)) == 1) & (F.coalesce(F.array_max(numbers), F.lit(0)) == F.size(numbers))
    found = text.let(F.struct("pages", "groups", "n_pages"), lambda row: _chosen_by_model(row, mode))
    rows = held.select("doc_id", "pages", dense.alias("dense"), F.struct(*_texts(F.col("pages"))).alias("whole"), F.inline(found))
    scoped = text.let(_own(F.col("pages"), F.col("dense"), F.col("chosen")), lambda own: F.struct(F.array_sort(F.array_distinct(own["page_no"])).alias("doc_pages"), *_texts(own)))
    rows = rows.select("doc_id", "name", "fields", "flex_fields", "described", "whole", scoped.alias("own"))
    alone = (F.col("own.raw") == "") | (F.col("own.table_raw") == "") | (F.size("flex_fields") > 0)
    rows = rows.withColumn("whole", F.when(alone, F.col("whole")))
    if dealt:
        rows = rows.repartition(pages.sparkSession.sparkContext.defaultParallelism, "doc_id", "name")
    side = lambda raw, norm: F.when(F.col(f"own.{raw}") != "", F.struct(F.col(f"own.{raw}").alias("raw"), F.col(f"own.{norm}").alias("norm"))).otherwise(F.struct(F.coalesce(F.col(f"whole.{raw}"), F.lit("")).alias("raw"), F.coalesce(F.col(f"whole.{norm}"), F.lit("")).alias("norm")))
    rows = rows.select(
        "doc_id",
        "name",
        F.col("own.doc_pages").alias("doc_pages"),
        "fields",
        "flex_fields",
        "described",
        side("raw", "norm").alias("scoped"),
        side("table_raw", "table_norm").alias("scoped_tables"),
        F.coalesce("whole.raw", F.lit("")).alias("whole_raw"),
        F.coalesce("whole.norm", F.lit("")).alias("whole_norm"),
    )
    seen = F.struct("scoped", "scoped_tables", "whole_raw", "whole_norm")
    own = lambda f: F.array_contains("flex_fields", F.upper(f))
    inside = lambda t, f: audit.present(t["scoped"]["raw"], t["scoped"]["norm"], f) | audit.present(t["scoped_tables"]["raw"], t["scoped_tables"]["norm"], f)
    absent = text.let(seen, lambda t: F.filter("fields", lambda f: ~inside(t, f) & ~(own(f) & audit.present(t["whole_raw"], t["whole_norm"], f))))

    def judged(gone: Column) -> Column:
        def report(missing: Column) -> Column:
            n, m = F.size("fields").cast("long"), F.size(missing).cast("long")
            shown = F.transform("fields", lambda f: F.struct(f.alias("field"), F.when(F.array_contains(missing, f), "missing").otherwise("present").alias("presence")))
            return F.struct(audit.status(F.size("doc_pages"), m, n).alias("status"), n.alias("field_count"), missing.alias("missing"), F.array_except(gone, missing).alias("suppressed"), shown.alias("field_presence"))

        return text.let(audit.suppress_in_row(gone, F.col("flex_fields"), F.col("described")), report)

    # the outer form keeps the optimizer from making the report a second time, as a filter on its status or missing fields
    rows = rows.select("doc_id", "name", "doc_pages", F.inline_outer(F.array(text.let(absent, judged))))
    return rows.select("doc_id", "name", "status", "doc_pages", "field_count", "missing", "suppressed", "field_presence")


def missing_by_dataset(audits: DataFrame, datasets: DataFrame) -> DataFrame:
    """(doc_id, name, dataset, ord, missing): the missing fields under the first dataset that has them, in its order; datasets without any are left out.

    A model's datasets meet its missing fields in one row, so no row is shuffled for a field.
    """
    held = datasets.groupBy("doc_id", "name").agg(F.collect_list(F.struct("ord", "dataset", "fields")).alias("d"))
    lost = audits.groupBy("doc_id", "name").agg(F.array_distinct(F.flatten(F.collect_list("missing"))).alias("lost"))

    def places(x: Column) -> Column:
        return F.transform(x["fields"], lambda f, i: F.struct(f.alias("field"), x["ord"].alias("ord"), i.alias("place"), x["dataset"].alias("dataset")))

    def first(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ((i == 0) | ~F.get(all_, i - 1)["field"].eqNullSafe(e["field"])) & F.array_contains("lost", e["field"]))

    def parted(kept: Column) -> Column:
        def own(x: Column) -> Column:
            mine = F.filter(kept, lambda e: e["ord"].eqNullSafe(x["ord"]) & e["dataset"].eqNullSafe(x["dataset"]))
            return F.struct(x["dataset"].alias("dataset"), x["ord"].alias("ord"), F.transform(F.array_sort(F.transform(mine, lambda e: F.struct(e["place"], e["field"]))), lambda e: e["field"]).alias("missing"))

        return F.transform(F.array_distinct(F.transform(kept, lambda e: F.struct(e["ord"].alias("ord"), e["dataset"].alias("dataset")))), own)

    fields = F.array_sort(F.flatten(F.transform(F.filter("d", lambda x: x["fields"].isNotNull()), places)))
    return lost.join(held.hint("merge"), ["doc_id", "name"]).select("doc_id", "name", F.inline(text.let(text.let(fields, first), parted))).select("doc_id", "name", "ord", "dataset", "missing")


def card_order(status: Column, n_missing: Column, name: Column) -> list[Column]:
    """Sort keys of report cards: failures first, then most missing fields, then by name in any case."""
    return [F.when(status == "FAIL", 0).otherwise(1).asc(), n_missing.desc(), F.upper(name).asc()]


def unresolved(rows: DataFrame, sample: int = 20) -> DataFrame:
    """(table, n_unresolved, sample) from rows (table, column, description): distinct columns in order that are still blank."""
    left = rows.where(F.coalesce(F.btrim("description"), F.lit("")) == "").groupBy("table").agg(F.array_sort(F.collect_set(F.upper("column"))).alias("c"))
    return left.select("table", F.size("c").cast("long").alias("n_unresolved"), F.slice("c", 1, sample).alias("sample"))
