"""Search and try: of the candidate pages of a key, best first, the first that answers counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators import enrich, lineage, pages

#: Pages tried for a key, and the least score of a link that is tried before the others.
TRIES, LEAST_SCORE = 6, 4


def ranked(links: Column, table_name: Column, marker: str, tries: int = TRIES) -> Column:
    """The links to try: the first of the highest score if it reaches LEAST_SCORE, then the others as they were found."""
    distinct = F.array_distinct(F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))
    scores = F.transform(distinct, lambda x: enrich.link_score(x, F.coalesce(table_name, F.lit("")), marker))
    best = F.get(distinct, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    first = F.when(F.array_max(scores) >= LEAST_SCORE, F.concat(F.array(best), F.filter(distinct, lambda x: x != best))).otherwise(distinct)
    return F.slice(first, 1, tries)


def cut(rows: DataFrame) -> DataFrame:
    """rows written to the checkpoint folder, if there is one; else kept by Spark."""
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.persist()


def search_and_try(keys: DataFrame, read: DataFrame, marker: str, tries: int = TRIES) -> DataFrame:
    """(key, description, characteristic, doc_url, matched, provider, tries): one row for each of keys.

    keys (key, table_name, column, links), a row for each key; read (url, html), a row for each page. Each page that some key
    may try is taken apart once, however many keys try it; the tries meet their pages in one join, and the first try of a key with an
    answer counts. A page answers with a description or with a type other than N/A; a page that is not there is a try without
    an answer. provider: http, or not_found after the last.
    """
    dealt = lineage.spread(keys.select("key", "table_name", "column", "links"))
    asked = cut(dealt.select("key", "column", ranked(F.col("links"), F.col("table_name"), marker, tries).alias("links")))
    tried = asked.select("key", "column", F.posexplode("links").alias("i", "url"))
    wanted = read.select("url", "html").join(tried.select("url").distinct().hint("merge"), "url", "left_semi")
    known = wanted.select("url", "html", pages.page_rows(F.col("html")).alias("rows"))
    # All joins merge, since each side grows with the input; equal pages of many keys: the page's side is unique, the keys' side may be split.
    met = tried.join(known.hint("merge"), "url")
    found = pages.column_metadata(met, ["key", "i", "url"], rows_col="rows").withColumns({"d": F.nullif("description", F.lit("")), "c": F.coalesce(F.nullif("data_type", F.lit("")), F.lit("N/A"))})
    # a condition inside the aggregate: as a filter it would be pushed below the metadata, which would then be made twice
    answer = F.when(F.col("d").isNotNull() | (F.col("c") != "N/A"), F.struct("i", "url", "d", "c"))
    best = found.groupBy("key").agg(F.min(answer).alias("a"))
    out = asked.select("key", F.size("links").alias("n")).join(best.hint("merge"), "key", "left")
    return out.select(
        "key",
        F.col("a.d").alias("description"),
        F.coalesce("a.c", F.lit("N/A")).alias("characteristic"),
        F.coalesce("a.url", F.lit("")).alias("doc_url"),
        F.col("a.d").isNotNull().alias("matched"),
        F.when(F.col("a").isNotNull(), "http").otherwise("not_found").alias("provider"),
        F.coalesce(F.col("a.i") + 1, "n").alias("tries"),
    )
