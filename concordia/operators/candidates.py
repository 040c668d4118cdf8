"""Choice of the authoritative model among versions, backups and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import text

#: Fixed value: normalised name of the one group that is never audited, besides those with the prefix SYN_.
IGNORED_PREFIX, IGNORED_NAMES = "SYN_", ["SALDOEMTRANSITONOMESTRANSFERENCIAINTERORGANIZACAO"]


def classify(files: DataFrame) -> DataFrame:
    """files (file_name, modified, ...) with group_key, version, official, reasons and score."""
    base = text.clean_base(F.col("file_name"))
    rows = files.withColumns({"base": base, "version": text.version(F.col("file_name"))})
    rows = rows.withColumns({"reasons": text.noise_reasons(F.col("base")), "group_key": text.group_key(F.col("base"))})
    official = F.size("reasons") == 0
    return rows.withColumns({"official": official, "score": text.score(official, F.col("version"), F.col("modified"))})


def ranked(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of groups with an official file, with place 1 for the one to use.

    by: columns that set archives apart; ord: the place in the archive, which decides ties.
    """
    rows = candidates.where(~F.upper("group_key").startswith(IGNORED_PREFIX) & ~text.fold_latin(F.col("group_key")).isin(IGNORED_NAMES))
    canonical = F.col("official") & (F.col("version") == 0) & (F.upper("base") == F.upper("group_key"))
    order = Window.partitionBy(*by, "group_key").orderBy(F.desc("official"), canonical.desc(), F.desc("score"), "ord")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("any_official", F.max("official").over(Window.partitionBy(*by, "group_key"))).where("any_official").drop("any_official")


def pick(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(candidates, by).where("place = 1").drop("place")


def rejected(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ranked(candidates, by).where("place > 1").drop("place")
