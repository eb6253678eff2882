"""Row numbers within groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, task_count


def number_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its group from 0, and ``n``, the rows of the group.

    The rows are sorted by a range partitioning over group and order, so a group of a third of all rows lies in a
    third of the partitions; only the counts of groups by partition come together. ``order`` should be total:
    rows that it doesn't tell apart are numbered in any order.
    """
    tasks = task_count(df.sparkSession)
    placed = cut_lineage(df.repartitionByRange(tasks, group, *order).withColumn("_task", F.spark_partition_id()))
    counts = placed.groupBy(group, "_task").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    before = counts.select(
        F.col(group).alias("_g"), F.col("_task").alias("_t"), (F.sum("_c").over(w.orderBy("_task")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n")
    )
    own = F.row_number().over(Window.partitionBy(group, "_task").orderBy(*order)) - 1
    ranked = placed.withColumn("_own", own)
    joined = ranked.join(before, ranked[group].eqNullSafe(before["_g"]) & (ranked["_task"] == before["_t"]))
    return joined.withColumn("pos", F.col("_own") + F.col("_before")).drop("_task", "_own", "_g", "_t", "_before")
