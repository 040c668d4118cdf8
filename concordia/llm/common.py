"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column, with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, and driver and executors are one process (tests), a local folder is made and used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
    if hadoop.isDefined():
        return hadoop.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="concordia-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/concordia-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def among(rows: DataFrame, wanted: DataFrame, row: str, inside: bool = True) -> DataFrame:
    """The rows of rows whose id (a long column row) is in wanted (a column row), or, without inside, is not; null ids are in nothing.

    Ids become bitmaps, one bit an id, which are broadcast; so rows with their texts stay where they are. Meant for ids of
    monotonically_increasing_id(), which lie close together: 30 million rows are 4 MB at most. Other ids cost up to 4 kB each.
    """
    ids = wanted.select(F.col(row).alias("__id"))
    maps = ids.groupBy(F.bitmap_bucket_number("__id").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("__bits"))
    at = F.bitmap_bit_position(F.col(row))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(F.col(row)) == F.col("__bucket"), "left")
    return met.where(found if inside else ~found).select(*rows.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def likeness64(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit fingerprints."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)).cast("double") / F.lit(64.0)


#: The white space of the word contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    lower() folds other letters too, so it serves only where every character is ASCII.
    """
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


def space_words(text: Column) -> Column:
    """Words between white space; [''] if there are none."""
    return F.split(F.btrim(text, F.lit(SPACE_CHARS)), SPACE)
