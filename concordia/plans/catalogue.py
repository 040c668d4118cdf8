"""The registered queries: each applies operators to inputs derived from the test tables, beside DuckDB SQL that derives them by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordia.plans import audits, enrichment, lookups, models, round_trips, scopes, sql_text, texts

_PARTS = (texts, scopes, audits, lookups, sql_text, round_trips, models, enrichment)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.q16_status(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in vars(part).items() if name[:1] == "q" and name[1:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
