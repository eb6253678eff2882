"""Composite retrieval: vector, keyword and hybrid search, search by example, filters by objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import display_caption
from tessera.functions.vector import clamp_score, cosine, nearest, norm
from tessera.operators.lexical import LexicalIndex, bm25
from tessera.session import cut_lineage

RRF = 60


def fan_out(k: int) -> int:
    """How many candidates each arm brings for ``k`` results."""
    return max(3 * k, 50)


def fuse(arms: list[DataFrame], constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of arms (query_id, id, rank from 1): (query_id, id, fused)."""
    votes = None
    for arm in arms:
        one = arm.select("query_id", "id", (F.lit(1.0) / (constant + F.col("rank"))).alias("v"))
        votes = one if votes is None else votes.unionByName(one)
    return votes.groupBy("query_id", "id").agg(F.round(F.sum("v"), 12).alias("fused"))


def provenance(in_vector: Column, in_keyword: Column) -> Column:
    return F.when(in_vector & in_keyword, "both").when(in_vector, "vector").otherwise("keyword")


def _top(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "id"))).filter(F.col("rank") <= k)


HIT = ("folder", "image_path", "caption", "document", "member_count", "sidecar_text")


def _as_hits(joined: DataFrame) -> DataFrame:
    return joined.withColumn("caption", display_caption(F.col("caption"), F.col("document"))).drop("document")


def _with_hits(ranked: DataFrame, store: DataFrame) -> DataFrame:
    """Records of the ranked ids; ids that the store doesn't have drop out."""
    return _as_hits(ranked.join(store.select("id", *HIT), "id"))


def vector_search(queries: DataFrame, store: DataFrame, k: int = 24, dim: int = 64) -> DataFrame:
    """Hits by vector: score the clamped cosine, fused score 0. ``queries`` has (query_id, vector)."""
    found = nearest(queries.select(F.col("query_id").alias("id"), "vector"), store.select("id", "vector"), max(1, k), dim)
    return _with_hits(found.select("query_id", "id", clamp_score(F.col("score")).alias("score"), F.lit(0.0).alias("fused"), F.lit("vector").alias("match"), "rank"), store)


def _true_cosine() -> Column:
    """The score in any mode: the cosine with the query's vector, at least 0; 0 without a usable vector."""
    fine = F.size("vector") == F.size("q_vector")
    return clamp_score(F.when(fine & (norm(F.col("vector")) > 0) & (norm(F.col("q_vector")) > 0), cosine(F.col("vector"), F.col("q_vector"))).otherwise(F.lit(0.0)))


def keyword_search(queries: DataFrame, store: DataFrame, index: LexicalIndex, k: int = 24) -> DataFrame:
    """Hits by BM25 rank; fused score 1 / (60 + rank), score the true cosine. ``queries`` has (query_id, text, vector)."""
    arm = bm25(index, queries, fan_out(k))
    ranked = _top(arm.select("query_id", "id", (F.lit(1.0) / (RRF + F.col("rank"))).alias("fused")), k)
    return _scored(ranked.withColumn("match", F.lit("keyword")), queries, store)


def hybrid_search(queries: DataFrame, store: DataFrame, index: LexicalIndex, k: int = 24, dim: int = 64) -> DataFrame:
    """Both arms, fused by reciprocal ranks: (query_id, id, rank, fused, score, match and the hit's columns).

    ``queries`` has (query_id, text, vector), ``store`` (id, vector, document, caption, folder, image_path,
    member_count, sidecar_text).
    """
    fan = fan_out(k)
    vectors = nearest(queries.select(F.col("query_id").alias("id"), "vector"), store.select("id", "vector"), fan, dim).select("query_id", "id", F.col("rank").alias("rank_v"), F.col("score").alias("known"))
    words = bm25(index, queries, fan).select("query_id", "id", F.col("rank").alias("rank_k"))
    vote = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused = vectors.join(words, ["query_id", "id"], "full_outer").select(
        "query_id", "id", F.round(vote("rank_v") + vote("rank_k"), 12).alias("fused"), F.col("rank_v").isNotNull().alias("in_v"), F.col("rank_k").isNotNull().alias("in_k"), "known"
    )
    return _scored(_top(fused, k).withColumn("match", provenance(F.col("in_v"), F.col("in_k"))).drop("in_v", "in_k"), queries, store)


def _scored(ranked: DataFrame, queries: DataFrame, store: DataFrame) -> DataFrame:
    """Hits with their cosines, those that the vector arm knows (``known``) and the others."""
    known = F.col("known") if "known" in ranked.columns else F.lit(None).cast("double")
    ranked = ranked.withColumn("known", known)
    own = F.when(F.col("known").isNull(), F.col("vector"))  # what is known needs no vectors
    asked = queries.select("query_id", F.col("vector").alias("q_vector"))
    joined = ranked.join(store.select("id", *HIT, "vector"), "id").withColumn("vector", own).join(asked, "query_id")
    scored = joined.withColumn("score", F.when(F.col("known").isNotNull(), clamp_score(F.col("known"))).otherwise(_true_cosine()))
    return _as_hits(scored.drop("known", "vector", "q_vector"))


def by_example(ids: DataFrame, store: DataFrame, k: int = 24, dim: int = 64) -> DataFrame:
    """Hits like stored records, without the record itself: (query_id, id, score, rank). Ids without a usable vector have none."""
    asked = store.join(ids.select("id").distinct(), "id", "left_semi").select("id", "vector")
    return nearest(asked, store.select("id", "vector"), k, dim, exclude_self=True)


def filter_by_objects(hits: DataFrame, store: DataFrame, queries: DataFrame, required: DataFrame | None, excluded: DataFrame | None, k: int = 24, dim: int = 64) -> DataFrame:
    """Hits that keep to objects: all ``required`` ids pass, ``excluded`` ids don't: (query_id, id, score, fused, match, rank).

    ``required`` and ``excluded`` are tables of ids; None skips the filter, an empty table of required ids lets nothing pass.
    Records of required ids that the search didn't bring are added to each query, with their cosine and match 'graph', and
    the order is then by score; otherwise it stays by fused score.
    """
    kept = hits.select("query_id", "id", "score", "fused", "match")
    order = [F.desc("fused"), F.col("id")]
    if required is not None:
        ids = required.select("id").distinct()
        kept = kept.join(ids, "id", "left_semi")
        pool = store.select("id", "vector").join(ids, "id", "left_semi")
        if excluded is not None:
            pool = pool.join(excluded.select("id").distinct(), "id", "left_anti")
        pool = cut_lineage(pool)  # each group of queries reads it
        # of the records that qualify, those with the highest cosine are enough, as the order will be by score
        near = nearest(queries.select(F.col("query_id").alias("id"), "vector"), pool, k, dim).select("query_id", "id", clamp_score(F.col("score")).alias("score"), F.lit(0.0).alias("fused"), F.lit("graph").alias("match"))
        more = near.join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti")
        kept = kept.unionByName(more)
        added = F.max((F.col("match") == "graph").cast("int")).over(Window.partitionBy("query_id"))
        kept = kept.withColumn("added", added)
        order = [F.desc(F.when(F.col("added") == 1, F.round("score", 9)).otherwise(F.col("fused"))), F.col("id")]
    if excluded is not None:
        kept = kept.join(excluded.select("id").distinct(), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "fused", "match", "rank")
