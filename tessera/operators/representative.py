"""Choosing one image to stand for a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import dot, hamming, norm
from tessera.operators.ranking import number_rows


def evenly_spaced(members: DataFrame, group: str, order: list[str], cap: int = 64) -> DataFrame:
    """At most ``cap`` members of each group, evenly spaced in their order: adds ``pos`` (from 0) and ``n``.

    Positions are ``round(i * (n - 1) / (cap - 1))``, halves to even; each once. With a cap of one, the first.
    """
    placed = number_rows(members, group, order)
    if cap == 1:
        return placed.filter("pos = 0")
    step = (F.col("n") - 1) / F.lit(float(cap - 1))
    # the i whose rounded place may be this one lie around pos / step
    near = F.floor(F.col("pos") / step)
    hit = None
    for d in (-1, 0, 1, 2):
        i = near + d
        one = (i >= 0) & (i <= cap - 1) & (F.rint(i * step) == F.col("pos"))
        hit = one if hit is None else hit | one
    return placed.filter((F.col("n") <= cap) | hit)


def middle(members: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The member at place n // 2 of each group."""
    placed = number_rows(members, group, order)
    return placed.filter(F.col("pos") == F.floor(F.col("n") / 2))


def centroid(members: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """The member of each group nearest to the mean vector: (group, key, similarity); ties by key.

    The mean is taken component by component, with partial sums before the shuffle.
    """
    parts = members.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l")).select(group, F.transform("l", lambda s: s["m"]).alias("mean"))
    length = norm(F.col("mean"))
    joined = members.select(group, key, vector).join(means, group)
    scored = joined.select(group, key, F.round(F.when(length > 0, dot(F.col(vector), F.col("mean")) / length).otherwise(0.0), 9).alias("similarity"))
    best = scored.groupBy(group).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(key).alias("k"))).alias("b"))
    return best.select(group, F.col("b.k").alias(key), (-F.col("b.s")).alias("similarity"))


def medoid(sample: DataFrame, group: str, pos: str, bits: str) -> DataFrame:
    """The member of each group whose 64-bit hash is nearest to all others: (group, pos, distance); the first of ties.

    ``sample`` is capped (see :func:`evenly_spaced`), so a group has few pairs. Null hashes are left out.
    """
    mine = sample.filter(F.col(bits).isNotNull()).select(group, F.col(pos).alias("_a"), F.col(bits).alias("_x"))
    others = mine.select(F.col(group).alias("_other"), F.col("_x").alias("_y"))
    sums = mine.join(others, mine[group].eqNullSafe(others["_other"])).groupBy(group, "_a").agg(F.sum(hamming(F.col("_x"), F.col("_y"))).alias("_d"))
    best = sums.groupBy(group).agg(F.min(F.struct("_d", "_a")).alias("_b"))
    return best.select(group, F.col("_b._a").alias(pos), F.col("_b._d").alias("distance"))


def representatives(members: DataFrame, group: str, key: str, order: list[str], vector: str | None = None, bits: str | None = None, cap: int = 64) -> DataFrame:
    """One member for each group: (group, key, member_count, method).

    A single member is taken as it is; else the one nearest to the mean vector, else the medoid of the hashes,
    else the one in the middle. Members without vector or hash don't take part in that choice.
    """
    sample = evenly_spaced(members, group, order, cap)
    size = members.groupBy(group).agg(F.count("*").alias("member_count"), F.min(key).alias("_any"))
    # the middle is that of the sample
    mid = Window.partitionBy(group)
    found = size.join(
        sample.withColumn("r", F.row_number().over(mid.orderBy("pos")) - 1).withColumn("m", F.count("*").over(mid)).filter(F.col("r") == F.floor(F.col("m") / 2)).select(group, F.col(key).alias("_middle")), group, "left"
    )
    if vector:
        found = found.join(centroid(sample.filter(F.col(vector).isNotNull()), group, key, vector).select(group, F.col(key).alias("_center")), group, "left")
    else:
        found = found.withColumn("_center", F.lit(None))
    if bits:
        hashed = medoid(sample, group, "pos", bits).select(group, "pos").join(sample.select(group, "pos", F.col(key).alias("_medoid")), [group, "pos"]).drop("pos")
        found = found.join(hashed, group, "left")
    else:
        found = found.withColumn("_medoid", F.lit(None))
    method = F.when(F.col("member_count") == 1, "only").when(F.col("_center").isNotNull(), "centroid").when(F.col("_medoid").isNotNull(), "dhash-medoid").otherwise("middle")
    chosen = F.when(F.col("member_count") == 1, F.col("_any")).otherwise(F.coalesce("_center", "_medoid", "_middle"))
    return found.select(group, chosen.alias(key), "member_count", method.alias("method"))
