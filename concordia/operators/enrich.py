"""Enrichment of fields: keyed, substring, prefix and recursive lookups, and HTML metadata tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from concordia.functions import text

BLANK = ["", "N/A"]
MAX_DEPTH = 4
#: Characters of a part of a name in the index of names.
GRAM = 3


def filled(x: Column) -> Column:
    """Null where the value is blank or N/A."""
    return F.when(~F.upper(F.btrim(F.coalesce(x, F.lit("")))).isin(BLANK), x)


def last_wins(rows: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(ord_col)).alias("v"))
    return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def first_wins(rows: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(ord_col)).alias("v"))
    return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def overlay(fields: DataFrame, metadata: DataFrame, key: str = "tag") -> DataFrame:
    """Description and type are overwritten by metadata that is filled; table and column only where blank or N/A."""
    m = metadata.select(F.col(key), *[F.col(c).alias(f"m_{c}") for c in ("description", "data_type", "source_table", "source_column")])
    joined = fields.join(m, key, "left")
    stronger = {c: F.coalesce(F.nullif(f"m_{c}", F.lit("")), F.col(c)) for c in ("description", "data_type")}
    weaker = {c: F.coalesce(filled(F.col(c)), F.nullif(f"m_{c}", F.lit("")), F.col(c)) for c in ("source_table", "source_column")}
    return joined.withColumns(stronger | weaker).drop(*[c for c in joined.columns if c.startswith("m_")])


def grams(value: Column, length: Column) -> Column:
    """Distinct parts of that many characters; none if the value is shorter."""
    starts = F.when(F.length(value) >= length, F.sequence(F.lit(1), F.length(value) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, length)))


def substring_matches(texts: DataFrame, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """(text, column, name) for texts (text, column) that hold a name (name, column) of their column, in any case. Both distinct.

    An inverted index of grams finds the pairs: each name stands under its gram that is rarest in the texts of its column (a
    name shorter than a gram under itself), and a text looks up each of its grams. A name with a gram that no text has is left
    out; pairs that share the rarest gram are tested for the whole name.
    """
    size = F.least(F.length("upper"), F.lit(gram))
    named = names.where("name <> ''").select("name", "column", F.upper("name").alias("upper"))
    lengths = named.agg(F.array_sort(F.collect_set(size)).alias("lengths"))  # one row of at most `gram` numbers
    held = texts.select("text", "column", F.upper("text").alias("in_text")).join(F.broadcast(lengths))
    held = held.select("text", "column", "in_text", F.explode(F.flatten(F.transform("lengths", lambda n: grams(F.col("in_text"), n)))).alias("gram"))
    seen = held.groupBy("column", "gram").agg(F.count(F.lit(1)).alias("texts"))
    parts = named.select("name", "column", "upper", F.explode(grams(F.col("upper"), size)).alias("gram"))
    rarest = parts.join(seen, ["column", "gram"], "left").groupBy("name", "column", "upper").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rare"))
    keys = rarest.where("rare.texts > 0").select("name", "column", "upper", F.col("rare.gram").alias("gram"))
    return held.join(keys, ["column", "gram"]).where(F.contains("in_text", "upper")).select("text", "column", "name")


def substring_update(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Each row (row_id, table_text, column) takes the description of the first table, in order, whose name its text holds
    and that describes the column. tables (name, ord, column, description).

    Equal texts of a column are matched once. Rows are told apart even if they repeat an id.
    """
    told = tables.where("name <> '' AND description <> ''").groupBy("name", "column").agg(F.min(F.struct("ord", "description")).alias("t"))
    texts = rows.where("table_text IS NOT NULL").select(F.col("table_text").alias("text"), "column").distinct()
    hits = substring_matches(texts, told.select("name", "column")).join(told, ["name", "column"])
    best = hits.groupBy("text", "column").agg(F.min(F.struct(F.col("t.ord"), F.col("name").alias("matched_table"), F.col("t.description"))).alias("b"))
    best = best.select(F.col("text").alias("__text"), F.col("column").alias("__column"), "b.matched_table", "b.description")
    return rows.join(best, (F.col("table_text") == F.col("__text")) & (F.col("column") == F.col("__column")), "left").select(*rows.columns, "matched_table", "description")


def prefix_match(tags: DataFrame, keys: DataFrame) -> DataFrame:
    """tags (tag) with key: the tag itself, else the longest key that the tag continues after a '_'.

    A tag's possible keys are its prefixes at '_', so the range join becomes an equal join.
    """
    parts = F.split("tag", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    rows = tags.select("tag", F.explode(prefixes).alias("key")).distinct()
    best = rows.join(keys.select("key").distinct(), "key").groupBy("tag").agg(F.max_by("key", F.length("key")).alias("key"))
    return tags.join(best, "tag", "left")


def describe_recursively(asked: DataFrame, described: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """asked (key) with the description found at it or through its references, depth-first in reference order.

    described (key, description); edges (key, ref_ord, ref). A key that the search of a root has met is not entered
    again, in whatever depth it was met; level is the depth of the description. First each root's reachable keys are found by
    depth joins of distinct (root, key) pairs (no paths, so hubs do not multiply them). The pairs are then sorted by root, and a
    task searches root after root in one pass over its rows, since the order of visits decides.
    """
    kind = to_arrow_type(asked.schema["key"].dataType)
    # All joins merge: the tables grow with the input, and a size guessed from a small file of pages would have the driver broadcast them.
    d = described.where("description <> ''").select(F.col("key").alias("at"), "description").hint("merge")
    # A key with a description ends its branch, so only the others lead on.
    open_edges = edges.select(F.col("key").alias("at"), "ref_ord", "ref").join(d, "at", "left_anti")
    lists = open_edges.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "ref"))), lambda r: r["ref"]).alias("refs")).hint("merge")
    nodes = d.join(lists, "at", "full").hint("merge")
    frontier = reach = asked.where("key IS NOT NULL").select(F.col("key").alias("root"), F.col("key").alias("at")).distinct()
    for _ in range(depth):
        frontier = frontier.join(lists, "at").select("root", F.explode("refs").alias("at")).distinct()
        reach = reach.unionAll(frontier)
    graph = reach.distinct().join(nodes, "at").select("root", "at", "description", "refs")
    width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("root", asked.schema["key"].dataType), T.StructField("description", T.StringType()), T.StructField("level", T.IntegerType())])
    name = lambda k: tuple(k.items()) if isinstance(k, dict) else k

    def search(root: object, known: dict) -> tuple[str, int] | None:
        seen, stack = set(), [(name(root), 0)]
        while stack:
            key, level = stack.pop()
            if key in seen or level > depth:
                continue
            seen.add(key)
            told, refs = known.get(key, (None, ()))
            if told is not None:
                return told, level
            stack += [(name(r), level + 1) for r in reversed(refs or ())]
        return None

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, known, out = None, {}, []

        def made() -> pa.RecordBatch:
            roots, told = [r for r, _ in out], [t for _, t in out]
            return pa.RecordBatch.from_arrays([pa.array(roots, kind), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.int32())], names=["root", "description", "level"])

        for b in batches:
            for of, at, told, refs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if of != root:
                    if known and (hit := search(root, known)):
                        out.append((root, hit))
                    root, known = of, {}
                known[name(at)] = (told, refs)
            yield made()
            out = []
        if known and (hit := search(root, known)):
            out.append((root, hit))
        yield made()

    best = graph.repartition(width, "root").sortWithinPartitions("root").mapInArrow(search_all, schema)
    return asked.join(best.hint("merge"), asked["key"] == best["root"], "left").select("key", "description", "level")


def html_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(..., row_no, cells) of literal table rows of a dashboard, cells with their tags stripped; pages.page_rows() reads any rows."""
    rows = F.regexp_extract_all(F.col(html_col), F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("__tr"), F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: text.normalize_ws(text.strip_tags(c, " ")))
    keep = [c for c in pages.columns if c != html_col]
    return pages.select(*keep, F.posexplode(rows).alias("row_no", "__tr")).select(*keep, "row_no", cells.alias("cells"))


def link_score(link: Column, table_name: Column, marker: str) -> Column:
    low, name = F.lower(link), F.lower(table_name)
    bare = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    return F.when(F.contains(low, F.lit(marker)), 5).otherwise(0) + F.when(F.contains(low, name), 4).otherwise(0) + F.when((bare(name) != "") & F.contains(bare(low), bare(name)), 2).otherwise(0)


def carry_forward(rows: DataFrame, by: str, order: str, is_header: Column, value: Column, out: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(F.when(is_header, value), ignorenulls=True).over(window))


def diagnostics(table_rows: DataFrame) -> DataFrame:
    """One row per table with its status. table_rows (table, url, candidate, parsed, updated): counts per row as 0 or 1."""
    sums = table_rows.groupBy("table").agg(F.max("url").alias("url"), *[F.sum(c).cast("long").alias(c) for c in ("candidate", "parsed", "updated")])
    left = F.col("candidate") - F.col("updated")
    status = (
        F.when(F.col("candidate") == 0, "SKIP_NO_CANDIDATES")
        .when(F.coalesce("url", F.lit("")) == "", "SKIP_NO_URL")
        .when(F.col("parsed") == 0, "WARN_PARSE_EMPTY")
        .when(F.col("updated") == 0, "WARN_NO_COLUMN_MATCH")
        .when(left > 0, "OK_PARTIAL")
        .otherwise("OK_FULL")
    )
    kind = F.when(F.coalesce("url", F.lit("")) == "", "none").when(F.contains("url", F.lit("search")), "search").otherwise("direct")
    return sums.select("table", kind.alias("url_type"), status.alias("status"), "candidate", "updated", left.alias("unresolved"))
