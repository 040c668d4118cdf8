"""Running sums along keys of any size: no key is ever held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.common import materialize, partitions


def running_sums(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with columns more: each of sums (a long), added up over the key's rows up to this one, in order.

    Rows are dealt to ranges of (key, order), so a key with very many rows lies in several partitions. Sums run inside a partition;
    what earlier partitions hold of the same key, one row for each key and partition, is added after. Rows equal in all of order
    are told apart by where they stand.
    """
    marked = rows.withColumn("__at", F.monotonically_increasing_id())
    sort = [F.col(key), *order, F.col("__at")]
    placed = marked.repartitionByRange(partitions(rows.sparkSession), *sort).withColumn("__part", F.spark_partition_id())
    local = Window.partitionBy("__part", key).orderBy(*order, "__at").rowsBetween(Window.unboundedPreceding, 0)
    done = materialize(placed.select("*", *[F.sum(value).over(local).alias(f"__sum_{name}") for name, value in sums.items()]), "running")
    parts = done.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(*[F.max(f"__sum_{n}").alias(f"__all_{n}") for n in sums])
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__key", "__of", *[F.coalesce(F.sum(f"__all_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    # only keys that go on in another partition carry anything
    carried = carried.where(" OR ".join(f"__before_{n} <> 0" for n in sums))
    met = done.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")), "left")
    return met.select(*rows.columns, *[(F.col(f"__sum_{n}") + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in sums])
