"""Incremental indexing: what is new, changed, the same and gone; upserts on snapshots; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status) of both tables (id, change_key), ids unique: new, changed, same or gone. A stored record without key counts as changed."""
    a, b = current.select("id", F.col("change_key").alias("now"), F.lit(True).alias("there")), stored.select("id", F.col("change_key").alias("was"), F.lit(True).alias("kept"))
    both = a.join(b, "id", "full_outer")
    status = F.when(F.col("kept").isNull(), "new").when(F.col("there").isNull(), "gone").when(F.col("was").isNotNull() & (F.col("was") == F.col("now")), "same").otherwise("changed")
    return both.select("id", status.alias("status"))


def build_report(status: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: written, skipped (unchanged), pruned, failed and total of a build."""
    bad = status.join(failed.select("id").distinct(), "id", "left_semi").filter(F.col("status").isin("new", "changed")).agg(F.count("*").alias("failed")) if failed is not None else None
    row = status.agg(
        F.count_if(F.col("status").isin("new", "changed")).alias("to_write"), F.count_if(F.col("status") == "same").alias("skipped"), F.count_if(F.col("status") == "gone").alias("pruned"), F.count_if(F.col("status") != "gone").alias("total")
    )
    row = row.crossJoin(bad) if bad is not None else row.withColumn("failed", F.lit(0).cast("long"))
    return row.select((F.col("to_write") - F.col("failed")).alias("written"), "skipped", "pruned", "failed", "total")


def last_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (nulls first). Rows of a key meet within their task before they are shuffled."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return last.select(*[F.col(key) if c == key else F.col(f"_m.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key. Keys of ``new`` are unique (see :func:`last_by`)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update_columns(old: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``old`` with new values of some columns; a null keeps the old one, keys that aren't there are ignored."""
    fresh = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def split_usable(records: DataFrame, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Records whose vector is finite, and the others as (id, error)."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return records.filter(~F.coalesce(bad, F.lit(True))), records.filter(F.coalesce(bad, F.lit(True))).select("id", F.lit("the vector isn't finite").alias("error"))
