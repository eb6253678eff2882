"""Query history and profiles of a collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import paths as P
from tessera.operators.ranking import number_rows
from tessera.plans.planner import summary_of


def without_repeats(history: DataFrame, user: str, order: list[str], text: str, last: int | None = 200) -> DataFrame:
    """Entries that differ from the one before, the ``last`` of each user; adds ``pos`` from the latest, 1 first."""
    placed = number_rows(history, user, order)
    before = placed.select(F.col(user).alias("_u"), (F.col("pos") + 1).alias("_p"), F.col(text).alias("_b"))
    joined = placed.join(before, placed[user].eqNullSafe(before["_u"]) & (placed["pos"] == before["_p"]), "left")
    kept = joined.filter(F.col("_p").isNull() | ~F.col(text).eqNullSafe(F.col("_b"))).drop("_u", "_p", "_b", "pos", "n")
    if last is None:
        return number_rows(kept, user, order).withColumn("pos", F.col("n") - F.col("pos")).drop("n")
    back = Window.partitionBy(user).orderBy(*[F.desc(c) for c in order])
    return kept.withColumn("pos", F.row_number().over(back)).filter(F.col("pos") <= last)


def median_profile(df: DataFrame, group: str | None, size: Column) -> DataFrame:
    """Count, least, most, mean and median of ``size``."""
    rows = df.select(*([group] if group else []), size.alias("s"))
    g = rows.groupBy(group) if group else rows.groupBy()
    return g.agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"), F.round(F.avg("s"), 6).alias("mean"), F.median("s").alias("median"))


def fixed(decimals: int):
    """A column function: numbers as text of so many decimals, rounded by their exact binary value, exact halves to even; NaN as 'NaN', null as null.

    Java's formats don't go by the exact binary value: DecimalFormat makes 0.0000 of 0.00005, which is above the half.
    """

    @F.pandas_udf(T.StringType())
    def run(scores: pd.Series) -> pd.Series:
        return scores.map(lambda x: "NaN" if x != x else f"{x:.{decimals}f}")

    return lambda c: F.when(c.isNotNull(), run(F.coalesce(c, F.lit(0.0))))


def result_rows(hits: DataFrame, *keys: str) -> DataFrame:
    """Rows of a result export: score as text of four decimals, caption, paths, members; with the columns ``keys`` before them."""
    return hits.select(*keys, fixed(4)(F.col("score")).alias("score"), "caption", "image_path", "folder", "member_count")


def rank_labels(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """Labels such as ``Result 2/20 · 0.43 · a red car``."""
    w = Window.partitionBy(query)
    ranked = hits.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("c", F.count("*").over(w)).withColumn("s", F.coalesce(fixed(2)(F.col("score")), F.lit("")))
    return ranked.select(query, F.col("r").alias("rank"), F.concat(F.lit("Result "), F.col("r").cast("string"), F.lit("/"), F.col("c").cast("string"), F.lit(" · "), "s", F.lit(" · "), F.coalesce("caption", F.lit(""))).alias("label"))


@F.pandas_udf(T.StringType())
def _summary(query: pd.Series, folders: pd.Series, captions: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([summary_of(*x) for x in zip(query, folders, captions, total)], dtype=object)


def summaries(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """A sentence on the results of each query, from its first three hits and their number: (query, summary)."""
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    first = F.when(F.col("r") <= 3, F.struct("r", F.coalesce("folder", F.lit("")).alias("folder"), F.coalesce("caption", F.lit("")).alias("caption")))
    listed = ranked.groupBy(query).agg(F.array_sort(F.collect_list(first)).alias("l"), F.count("*").alias("n"))
    return listed.select(query, _summary(F.col(query).cast("string"), F.transform("l", lambda x: P.slashes(x["folder"])), F.transform("l", lambda x: x["caption"]), "n").alias("summary"))


def first_lines(hits: DataFrame, query: str, order: list[Column], line: Column, n: int, separator: str) -> DataFrame:
    """The first ``n`` hits of each query as one text: (query, text)."""
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("r") <= n).select(query, "r", line.alias("line"))
    listed = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"))
    return listed.select(query, F.array_join(F.transform("l", lambda x: x["line"]), separator).alias("text"))
