"""What became of each table of a fill run: a fold of its stage events by a table of transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State and event, and the state that follows. A state without a line for an event stays; the last ones are the results.
TRANSITIONS = {
    "START local": "LOCAL", "LOCAL some": "OK_LOCAL_PARTIAL", "LOCAL all": "OK_LOCAL_FULL",
    "START no_rows": "SKIP_NO_CANDIDATES", "START rows": "ROWS", "ROWS no_url": "SKIP_NO_URL", "ROWS url": "URL",
    "URL failed": "ERROR_FETCH", "URL page": "PAGE", "PAGE columns": "COLUMNS", "PAGE no_columns": "BARE",
    "COLUMNS rows_gone": "WARN_NO_CANDIDATES_IN_HTML", "COLUMNS none": "WARN_NO_COLUMN_MATCH", "COLUMNS some": "OK_PARTIAL", "COLUMNS all": "OK_FULL",
    "BARE rows_gone": "WARN_PARSE_EMPTY", "BARE none": "WARN_PARSE_EMPTY", "BARE some": "OK_LINEAGE_FALLBACK", "BARE all": "OK_LINEAGE_FALLBACK",
}
SAMPLE = 20


def work_tables(mapping: DataFrame, tables: str = "", aliases: list[str] | None = None) -> DataFrame:
    """(table, real_table, url) of a mapping (key, url): tables named in the comma list only (all if it is blank).

    aliases: ALIAS=REAL_TABLE; an alias looks up the page of its real table, and its own if that has none. In any case.
    """
    pairs = [a.split("=", 1) for a in aliases or []]
    if bad := [p[0] for p in pairs if len(p) < 2]:
        raise ValueError(f"no '=' in alias: {bad[0]}")
    real = {k.strip().upper(): v.strip().upper() for k, v in pairs}
    wanted = [t.strip().upper() for t in tables.split(",") if t.strip()]
    rows = mapping.select(F.upper("key").alias("table"), "url")
    rows = rows.where(F.col("table").isin(wanted)) if wanted else rows
    renamed = F.create_map(*[F.lit(x) for p in real.items() for x in p])[F.col("table")] if real else F.lit(None).cast("string")
    rows = rows.withColumn("real_table", F.coalesce(renamed, "table"))
    urls = mapping.select(F.upper("key").alias("real_table"), F.nullif(F.btrim("url"), F.lit("")).alias("real_url"))
    return rows.join(urls, "real_table", "left").select("table", "real_table", F.coalesce("real_url", "url").alias("url"))


def url_type(url: Column, local: Column) -> Column:
    return F.when(local, "local_xlsx").when(F.coalesce(url, F.lit("")) == "", "none").when(F.contains(url, F.lit("/search?")), "search").otherwise("direct")


def stage_events(local: Column, before: Column, url: Column, fetched: Column, parsed: Column, met: Column, updated: Column, unresolved: Column) -> Column:
    """The events of a table in order. before, met: its rows with a placeholder when it was looked at, and when it was filled."""
    end = F.when(updated == 0, F.when(met == 0, "rows_gone").otherwise("none")).when(unresolved > 0, "some").otherwise("all")
    own = F.array(F.lit("local"), F.when(unresolved > 0, "some").otherwise("all"))
    web = F.array(
        F.when(before == 0, "no_rows").otherwise("rows"),
        F.when(F.coalesce(url, F.lit("")) == "", "no_url").otherwise("url"),
        F.when(fetched, "page").otherwise("failed"),
        F.when(parsed == 0, "no_columns").otherwise("columns"),
        end,
    )
    return F.when(local, own).otherwise(web)


def fold(events: Column) -> Column:
    """The state after the events."""
    follow = F.create_map(*[F.lit(x) for p in TRANSITIONS.items() for x in p])
    return F.aggregate(events, F.lit("START"), lambda state, e: F.coalesce(follow[F.concat(state, F.lit(" "), e)], state))


def table_diagnostics(tables: DataFrame) -> DataFrame:
    """One row for each table: url_type, status, and its counts as far as the run came.

    tables (table, real_table, url, local, before, fetched, parsed, met, updated, unresolved array of columns).
    """
    left = F.size(F.coalesce("unresolved", F.array().cast("array<string>")))
    status = fold(stage_events(*[F.col(c) for c in ("local", "before", "url", "fetched", "parsed", "met", "updated")], left))
    ended, none = ~F.col("status").isin("SKIP_NO_CANDIDATES", "SKIP_NO_URL", "ERROR_FETCH"), F.lit(0)
    rest = F.when(ended, left).when(F.col("status") == "SKIP_NO_CANDIDATES", none).otherwise(F.col("before"))
    sample = F.when(ended, F.array_join(F.slice(F.array_sort(F.array_distinct("unresolved")), 1, SAMPLE), ", "))
    count = lambda c: F.when(ended, F.col(c)).otherwise(none).cast("long").alias(c)
    return tables.withColumn("status", status).select(
        "table", "real_table", F.coalesce("url", F.lit("")).alias("url"), url_type(F.col("url"), F.col("local")).alias("url_type"), "status",
        F.col("before").cast("long").alias("pre_candidates"), count("parsed"), count("updated"), rest.cast("long").alias("unresolved_after"), F.coalesce(sample, F.lit("")).alias("unresolved_sample"),
    )
