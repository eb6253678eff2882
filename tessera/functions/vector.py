"""Vector functions as column expressions, and exact nearest neighbours of a stated query set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import topk
from tessera.functions.text import features_of, hash_bucket, tokenize, with_form
from tessera.session import task_count


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def truncate_dim(a: Column, dim: int) -> Column:
    """The first ``dim`` components at length one; an error if there are fewer."""
    return F.when(F.size(a) < dim, F.raise_error(F.lit(f"vector is narrower than {dim}"))).otherwise(l2_normalize(F.slice(a, 1, dim)))


def is_usable(a: Column, dim: int | None = None) -> Column:
    """Whether all components are finite numbers, one isn't zero and there are ``dim`` of them."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    length = (F.size(a) == dim) if dim else (F.size(a) > 0)
    return F.coalesce(a.isNotNull() & length & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clamp_score(score: Column) -> Column:
    """A similarity as a score: NaN and infinities become 0, negatives too."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(0.0)).otherwise(F.greatest(s, F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hashed_features(df: DataFrame, id_col: str, text_col: str, dim: int = 512) -> DataFrame:
    """Unit-length hashed feature vectors in sparse form: (id, bucket, weight).

    Features that share a bucket add up. A text without features has its raw text as the one feature, so no
    vector is empty. Null ids are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    # texts go to their place before they become tokens: what follows needs no other shuffle, and equal tokens count once
    rows = rows.repartition(task_count(df.sparkSession), "id").select("id", "text", tokenize(F.col("text")).alias("t"))
    tokens = rows.select("id", F.explode("t").alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    found = with_form(tokens).select("id", "n", F.explode(features_of(F.col("form"))).alias("f")).select("id", "f.feature", (F.col("n") * F.col("f.weight")).alias("w"))
    raw = F.concat(F.lit("raw:"), F.when(F.coalesce("text", F.lit("")) == "", F.lit("∅")).otherwise(F.col("text")))
    found = found.unionByName(rows.filter(F.size("t") == 0).select("id", raw.alias("feature"), F.lit(1.0).alias("w")))
    summed = found.groupBy("id", hash_bucket(F.col("feature"), dim).alias("bucket")).agg(F.sum("w").alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return summed.select("id", "bucket", (F.col("w") / length).alias("weight"))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, dim: int = 64, exclude_self: bool = False, block_rows: int = 20_000) -> DataFrame:
    """Exact nearest rows of every query: (query_id, id, score), at most ``k`` for each.

    Both tables have ``id`` and ``vector``; unusable vectors are left out. ``score`` is the cosine; of equal
    scores the lower id comes first. ``exclude_self`` drops rows with the query's id. The queries are a stated set:
    they go to the tasks in blocks of ``block_rows`` at most (a bounded size), each block a pass over the rows in which
    every task keeps its best ``k`` of each query; many queries make more blocks of fewer tasks (:func:`topk.layout`), so
    what is shuffled doesn't depend on how many parts the rows have. Cosines are worked out in single precision first, and
    exactly for what may be among the best. Each block reads the rows again: cut what is costly to make. Query ids must
    be unique. Rows and queries aren't deduplicated.
    """
    spark = rows.sparkSession
    q_type, r_type = dict(queries.dtypes)["id"], dict(rows.dtypes)["id"]
    asked = queries.select("id", "vector").filter(is_usable(F.col("vector"), dim) & F.col("id").isNotNull())
    known = dict(rows.dtypes)["vector"] in ("array<float>", "array<double>")
    held = rows.select("id", F.col("vector") if known else F.col("vector").cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    first = asked.limit(block_rows + 1).toArrow()  # one job where the queries are few
    count = first.num_rows if first.num_rows <= block_rows else asked.count()
    groups, tasks = topk.layout(count, k, spark.sparkContext.defaultParallelism)
    schema = f"query_id {q_type}, id {r_type}, score double"
    found = None
    if count == first.num_rows:
        step = max(1, -(-count // groups))
        blocks = (first.slice(at, step) for at in range(0, count, step))
    else:
        groups = max(groups, -(-count // block_rows))
        blocks = (asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == n).toArrow() for n in range(groups))
    for own in blocks:
        if not own.num_rows:
            continue
        q_ids = own.column("id").combine_chunks()
        q = _matrix(own.column("vector").combine_chunks(), dim)
        q = q / np.linalg.norm(q, axis=1)[:, None]

        def best(batches, q=q, q_ids=q_ids):
            rough = q.astype(np.float32)
            slack = np.full(len(q), (dim + 8) * 2e-7)
            top = topk.Best(len(q), k)
            for part in topk.small_batches(batches):
                part = part.filter(pc.equal(pc.list_value_length(part.column("vector")), dim))
                v = _matrix(part.column("vector"), dim)
                good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                v = v[good] / np.linalg.norm(v[good], axis=1)[:, None]
                ids = part.column("id").filter(pa.array(good))
                top.begin(ids)
                own = pc.index_in(ids.cast(q_ids.type), value_set=q_ids).fill_null(-1).to_numpy() if exclude_self else np.full(len(ids), -1)
                turned = np.ascontiguousarray(v.astype(np.float32).T)

                def exact(query, row, v=v):
                    return np.round(np.einsum("ij,ij->i", q[query], v[row]), 12), np.zeros(len(row), np.int32)

                for a in range(0, len(q), topk.QUERY_ROWS):
                    near = rough[a : a + topk.QUERY_ROWS] @ turned
                    mine = np.flatnonzero((own >= a) & (own < a + len(near)))
                    near[own[mine] - a, mine] = -np.inf
                    top.scan(near, a, slack, -3.0, exact)
            yield from top.batches_of(q_ids, ["query_id", "id", "score"])

        one = held.coalesce(max(2, tasks) if found is None else tasks).mapInArrow(best, schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` components; nulls are NaN."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
