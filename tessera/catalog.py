"""The queries over the test tables, and SQL that DuckDB runs on the same tables.

Scores are rounded to six decimals on both sides. Search queries take every row whose id is divisible by 50.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import graph, history, indexing, labels, lexical, representative, retrieval
from tessera.session import cut_lineage, shared_folder, spread
from tessera.session import read_table as table

QUERIES: dict = {}
SQL: dict = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def six(c: Column) -> Column:
    return F.round(c, 6)


# tables that several queries begin with


def store_rows(spark, d) -> DataFrame:
    """The current record of each id: the one indexed last."""
    rows = table(spark, d, "store_rows").filter("id is not null")
    return indexing.last_by(rows, "id", ["indexed_at", "caption", "document"])


CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, caption DESC NULLS LAST, document DESC NULLS LAST) AS r
  FROM store_rows WHERE id IS NOT NULL) WHERE r = 1)"""


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def store_hits(spark, d) -> DataFrame:
    return store_rows(spark, d).select(
        "id", F.col("embedding").alias("vector"), "document", "caption", F.col("leaf_folder").alias("folder"), F.col("representative_image").alias("image_path"), "member_count", "sidecar_text"
    )


def search_store(spark, d) -> DataFrame:
    """The store as searches read it, made once: they read it several times."""
    return cut_lineage(store_hits(spark, d))


def search_queries(spark, d, store: DataFrame) -> DataFrame:
    """Queries made of hits: their captions as text and the vectors of their images."""
    hits = table(spark, d, "folder_hits").filter("hit_id % 50 = 0").select(F.col("hit_id").alias("query_id"), "caption", "image_path").distinct()
    hits = hits.groupBy("query_id").agg(F.min("caption").alias("text"), F.min("image_path").alias("image_path"))
    return cut_lineage(hits.join(store.select("image_path", "vector"), "image_path", "left").select("query_id", "text", "vector"))


USABLE = "v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
QUERYSET = """asked0 AS (SELECT hit_id AS query_id, min(caption) AS text, min(image_path) AS image_path FROM folder_hits WHERE hit_id % 50 = 0 GROUP BY 1),
asked AS (SELECT query_id, text, embedding AS v FROM asked0 LEFT JOIN cur ON cur.representative_image = asked0.image_path)"""
NEAREST = f"""good AS (SELECT id, embedding::DOUBLE[] AS v FROM (SELECT id, embedding, embedding AS v FROM cur) WHERE {USABLE}),
goodq AS (SELECT query_id, v::DOUBLE[] AS v FROM asked WHERE {USABLE}),
sims AS (SELECT query_id, id, round(list_cosine_similarity(q.v, g.v), 12) AS s FROM goodq q, good g),
arm_v AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sims QUALIFY rank <= {{k}})"""


def clean_edges(spark, d) -> DataFrame:
    names = F.transform("classes", lambda x: F.lower(F.trim(x)))
    return graph.edges_of(table(spark, d, "graph_records"), F.lower(P.slashes(F.col("image_path"))), names)


EDGES = r"""edges AS (SELECT DISTINCT image, lower(trim(c)) AS class FROM (SELECT lower(replace(image_path, '\', '/')) AS image, unnest(classes) AS c FROM graph_records WHERE image_path IS NOT NULL)
  WHERE c IS NOT NULL AND trim(c) <> '')"""


# text as SQL
def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


TOKENS = rf"list_filter(list_transform(regexp_extract_all(coalesce({{t}}, ''), '{X.TOKEN}'), lambda t: CASE WHEN regexp_full_match(t, '[0-9A-Za-z]+') THEN lower(t) ELSE t END), lambda t: t NOT IN ({_list(X.STOPWORDS)}))"
STEM_SQL = rf"regexp_replace({{t}}, '{X.STEM}', '\1')"
_PAIRS = ", ".join(f"('{k}', '{v}')" for k, vs in X.TRANSLATIONS.items() for v in vs)
SYNONYMS = f"syn AS (SELECT * FROM (VALUES {_PAIRS}) s(ko, en))"


def lexical_sql(source: str, out: str) -> str:
    """CTEs from ``source`` (id, text) to ``out`` (id, term), a row for each token."""
    return f"""{out}_tok AS (SELECT id, unnest({TOKENS.format(t='text')}) AS tok FROM {source}),
{out}_stem AS (SELECT id, tok, {STEM_SQL.format(t='tok')} AS stem FROM {out}_tok),
{out} AS (SELECT id, tok AS term FROM {out}_stem UNION ALL SELECT id, stem FROM {out}_stem WHERE stem <> tok
  UNION ALL SELECT id, en FROM {out}_stem JOIN syn ON ko = tok UNION ALL SELECT id, en FROM {out}_stem JOIN syn ON ko = stem)"""


def bm25_sql(k: int | str) -> str:
    """CTEs from docs (id, text) and asked (query_id, text) to arm_k (query_id, id, s, overlap, rank)."""
    return f"""{lexical_sql('docs', 'terms0')},
terms AS (SELECT * FROM terms0 UNION ALL SELECT id, '∅' FROM docs WHERE id NOT IN (SELECT id FROM terms0)),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
dl AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, nd GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
askeds AS (SELECT query_id AS id, text FROM asked),
{lexical_sql('askeds', 'qterms')},
qtf AS (SELECT id AS query_id, term, count(*) AS qtf FROM qterms GROUP BY 1, 2),
scored AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS s, count(*) AS overlap
  FROM tf JOIN qtf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, nd GROUP BY 1, 2),
arm_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, overlap DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


DOCS = "docs AS (SELECT id, coalesce(document, '') AS text FROM cur)"


# vectors


@query(f"WITH {CURRENT}, {QUERYSET}, {NEAREST.format(k=24)} SELECT query_id, id, rank::INT AS rank, round(greatest(s, 0), 6) AS score FROM arm_v")
def vector_topk(spark, d):
    """Vector search: the 24 nearest records of each query."""
    store = search_store(spark, d)
    hits = retrieval.vector_search(search_queries(spark, d, store), store, 24, DIM)
    return hits.select("query_id", "id", F.col("rank").cast("int").alias("rank"), six(F.col("score")).alias("score"))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v FROM (SELECT vec_id, embedding, embedding AS v FROM embeddings) WHERE {USABLE}),
s AS (SELECT a.id AS query_id, b.id, round(array_cosine_similarity(a.v, b.v), 12) AS s FROM e a, e b WHERE a.id % 50 = 0 AND a.id <> b.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank, round(s, 6) AS score FROM s QUALIFY rank <= 10""")
def query_by_example(spark, d):
    """Search by stored vectors, without the vector itself."""
    store = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.by_example(store.filter("id % 50 = 0"), store, 10, DIM)
    return found.select("query_id", "id", F.col("rank").cast("int").alias("rank"), six(F.col("score")).alias("score"))


@query("SELECT hit_id, CASE WHEN score IS NULL OR score::VARCHAR = 'nan' OR score::VARCHAR IN ('inf', '-inf') THEN 0 ELSE greatest(score, 0) END AS score FROM (SELECT DISTINCT hit_id, score FROM folder_hits)")
def vector_score_clamp(spark, d):
    return table(spark, d, "folder_hits").select("hit_id", "score").distinct().select("hit_id", V.clamp_score(F.col("score")).alias("score"))


@query(f"""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length,
round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)) / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS kept FROM embeddings""")
def vector_truncate(spark, d):
    """Vectors cut to 16 components at length one: the length before, and the inner product of the old and the new."""
    e = table(spark, d, "embeddings")
    short = V.truncate_dim(F.col("embedding"), 16)
    return e.select("vec_id", six(V.norm(F.col("embedding"))).alias("length"), six(V.dot(F.slice("embedding", 1, 16), short)).alias("kept"))


# keyword and hybrid search


@query(f"WITH docs0 AS (SELECT doc_id AS id, text FROM documents), {SYNONYMS}, {lexical_sql('docs0', 't')} SELECT term, count(DISTINCT id) AS df, count(*) AS uses FROM t GROUP BY 1")
def tokenize_df(spark, d):
    """Document frequency and uses of the tokens of all documents, forms and translations included."""
    counts = lexical.term_counts(documents(spark, d), "doc_id", "text").filter(F.col("term") != X.EMPTY)
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


@query(f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 50 = 0), {SYNONYMS}, {bm25_sql(10)}
SELECT term, df, round(idf, 6) AS idf FROM idf""")
def bm25_idf(spark, d):
    idf = lexical.term_idf(cut_lineage(lexical.term_counts(documents(spark, d), "doc_id", "text")))
    return idf.select("term", "df", six(F.col("idf")).alias("idf"))


@query(f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 50 = 0), {SYNONYMS}, {bm25_sql(50)}
SELECT query_id, id AS doc_id, rank::INT AS rank, round(s, 6) AS score, overlap FROM arm_k""")
def bm25_topk(spark, d):
    """The 50 best documents for each question by BM25."""
    index = lexical.build_index(documents(spark, d), "doc_id", "text")
    q = table(spark, d, "eval_items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25(index, q, 50).select("query_id", F.col("id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), six(F.col("score")).alias("score"), "overlap")


COSINE = "round(CASE WHEN g.id IS NULL OR q.query_id IS NULL THEN 0 ELSE greatest(list_cosine_similarity(q.v, g.v), 0) END, 6)"


@query(f"""WITH {CURRENT}, {QUERYSET}, {NEAREST.format(k=1)}, {DOCS}, {SYNONYMS}, {bm25_sql(72)},
top AS (SELECT query_id, id, 1.0 / (60 + rank) AS fused, rank FROM arm_k WHERE rank <= 24)
SELECT top.query_id, top.id, rank::INT AS rank, round(fused, 6) AS fused, {COSINE} AS score FROM top LEFT JOIN good g ON g.id = top.id LEFT JOIN goodq q ON q.query_id = top.query_id""")
def keyword_search(spark, d):
    """Keyword search with true cosines as scores."""
    store = search_store(spark, d)
    hits = retrieval.keyword_search(search_queries(spark, d, store), store, lexical.build_index(store, "id", "document"), 24)
    return hits.select("query_id", "id", F.col("rank").cast("int").alias("rank"), six(F.col("fused")).alias("fused"), six(F.col("score")).alias("score"))


def hybrid_sql(k: int) -> str:
    """CTEs up to shown (query_id, id, rank, fused, match, score)."""
    fan = retrieval.fan_out(k)
    return f"""WITH {CURRENT}, {QUERYSET}, {NEAREST.format(k=fan)}, {DOCS}, {SYNONYMS}, {bm25_sql(fan)},
votes AS (SELECT query_id, id, rank, 'v' AS arm FROM arm_v UNION ALL SELECT query_id, id, rank, 'k' FROM arm_k),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS fused, bool_or(arm = 'v') AS in_v, bool_or(arm = 'k') AS in_k FROM votes GROUP BY 1, 2),
hits AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM fused f QUALIFY rank <= {k}),
shown AS (SELECT hits.query_id, hits.id, rank::INT AS rank, fused, CASE WHEN in_v AND in_k THEN 'both' WHEN in_v THEN 'vector' ELSE 'keyword' END AS match, {COSINE} AS score
  FROM hits LEFT JOIN good g ON g.id = hits.id LEFT JOIN goodq q ON q.query_id = hits.query_id)"""


def hybrid(spark, d, k: int) -> DataFrame:
    store = search_store(spark, d)
    return retrieval.hybrid_search(search_queries(spark, d, store), store, lexical.build_index(store, "id", "document"), k, DIM)


@query(hybrid_sql(24) + " SELECT query_id, id, rank, round(fused, 6) AS fused, match, score FROM shown")
def rrf_hybrid(spark, d):
    """Hybrid search: both arms, fused by reciprocal ranks, with provenance and cosines."""
    return hybrid(spark, d, 24).select("query_id", "id", F.col("rank").cast("int").alias("rank"), six(F.col("fused")).alias("fused"), "match", six(F.col("score")).alias("score"))


@query(hybrid_sql(24) + " SELECT match, CASE match WHEN 'vector' THEN 'V' WHEN 'keyword' THEN 'K' ELSE 'V+K' END AS badge, count(*) AS n FROM shown GROUP BY 1, 2")
def hybrid_provenance(spark, d):
    """How many hits each arm brings."""
    return hybrid(spark, d, 24).groupBy("match", P.badge(F.col("match")).alias("badge")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT hit_id, query_id, score, match FROM folder_hits WHERE (score IS NOT NULL AND NOT score::VARCHAR = 'nan' AND score >= 0.5) OR match = 'graph'")
def score_threshold(spark, d):
    """Hits to show: score 0.5 or more, or from the graph."""
    hits = table(spark, d, "folder_hits").select("hit_id", "query_id", "score", "match").distinct()
    return hits.filter(P.passes_threshold(F.col("score"), F.col("match"), 0.5))


NAMED = ("doorway", "shadow")


@query(hybrid_sql(72) + rf""", {EDGES},
req AS (SELECT image FROM edges WHERE class IN ('doorway', 'shadow') GROUP BY 1 HAVING count(*) = 2), exc AS (SELECT image FROM edges WHERE class = 'pavement'),
ids AS (SELECT id, lower(replace(representative_image, '\', '/')) AS image FROM cur), reqids AS (SELECT id FROM ids WHERE image IN (SELECT image FROM req)), excids AS (SELECT id FROM ids WHERE image IN (SELECT image FROM exc)),
kept AS (SELECT query_id, id, score, fused, match FROM shown WHERE id IN (SELECT id FROM reqids)),
pool AS (SELECT query_id, s.id, s.s, row_number() OVER (PARTITION BY query_id ORDER BY s.s DESC, s.id) AS r FROM sims s WHERE s.id IN (SELECT id FROM reqids) AND s.id NOT IN (SELECT id FROM excids) QUALIFY r <= 24),
more AS (SELECT query_id, id, round(greatest(s, 0), 6) AS score, 0.0 AS fused, 'graph' AS match FROM pool WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM kept)),
both_ AS (SELECT * FROM kept UNION ALL SELECT * FROM more), marked AS (SELECT *, max(CASE WHEN match = 'graph' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS added FROM both_)
SELECT query_id, id, score, match, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN added = 1 THEN score ELSE fused END DESC, id)::INT AS rank FROM marked WHERE id NOT IN (SELECT id FROM excids) QUALIFY rank <= 24""")
def agentic_filter(spark, d):
    """Hybrid search, then only images with a doorway and a shadow and without pavement, those that qualify added."""
    store = search_store(spark, d)
    asked = search_queries(spark, d, store)
    edges = clean_edges(spark, d)
    ids = store.select("id", F.lower(P.slashes(F.col("image_path"))).alias("image"))
    required = ids.join(graph.images_with_all(edges, list(NAMED)), "image", "left_semi").select("id")
    excluded = ids.join(graph.images_with_any(edges, ["pavement"]), "image", "left_semi").select("id")
    found = retrieval.hybrid_search(asked, store, lexical.build_index(store, "id", "document"), 72, DIM)
    found = cut_lineage(found.select("query_id", "id", six(F.col("score")).alias("score"), "fused", "match"))
    kept = retrieval.filter_by_objects(found, store, asked, required, excluded, 24, DIM)
    return kept.select("query_id", "id", six(F.col("score")).alias("score"), "match", F.col("rank").cast("int").alias("rank"))


# the graph


@query(f"WITH {EDGES} SELECT count(DISTINCT image) AS n_images FROM edges")
def graph_count(spark, d):
    return graph.image_count(clean_edges(spark, d))


@query(f"WITH {EDGES} SELECT class, count(*) AS n FROM edges GROUP BY 1")
def class_counts(spark, d):
    return graph.class_counts(clean_edges(spark, d))


@query(f"WITH {EDGES} SELECT b.class, count(*) AS n FROM edges a JOIN edges b USING (image) WHERE a.class = 'figure' AND b.class <> 'figure' GROUP BY 1 ORDER BY n DESC, class LIMIT 20")
def cooccurring(spark, d):
    """The 20 labels that share most images with 'figure'."""
    return graph.cooccurring(clean_edges(spark, d), "figure", 20)


@query(f"WITH {EDGES} SELECT a.class AS class_a, b.class AS class_b, count(*) AS n FROM edges a JOIN edges b ON a.image = b.image AND a.class < b.class GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50")
def edges(spark, d):
    """The 50 pairs of labels that most images show."""
    return graph.top_pairs(clean_edges(spark, d), 50)


@query(f"WITH {EDGES} SELECT image FROM edges WHERE class IN ('figure', 'shadow') GROUP BY 1 HAVING count(*) = 2")
def images_with_all(spark, d):
    return graph.images_with_all(clean_edges(spark, d), ["figure", "shadow", "figure"])


@query(f"WITH {EDGES} SELECT DISTINCT image FROM edges WHERE class IN ('doorway', 'wall')")
def images_with_any(spark, d):
    return graph.images_with_any(clean_edges(spark, d), ["doorway", "wall"])


@query(rf"""WITH {CURRENT}, {EDGES}, m AS (SELECT image FROM edges WHERE class IN ('figure', 'shadow') GROUP BY 1 HAVING count(*) = 2)
SELECT id, representative_image AS image_path, 0.0::DOUBLE AS score, 'graph' AS match FROM cur WHERE lower(replace(representative_image, '\', '/')) IN (SELECT image FROM m)""")
def graph_gallery(spark, d):
    """Records of the images that show a figure and a shadow."""
    found = graph.images_with_all(clean_edges(spark, d), ["figure", "shadow"]).select(P.image_id(F.col("image")).alias("key"))
    rows = store_hits(spark, d).withColumn("key", P.image_id(F.col("image_path")))
    return rows.join(found, "key", "left_semi").select("id", "image_path", F.lit(0.0).alias("score"), F.lit("graph").alias("match"))


# labels; the lines of orders stand in for boxes


def boxes(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 600).cast("int").alias("cid"), (F.col("l_quantity") / 50).alias("w"), (F.col("l_discount") * 10).alias("h"), F.col("l_tax").alias("cx"), F.lit(0.5).alias("cy"))


def class_names(spark, d) -> DataFrame:
    return table(spark, d, "class_map").select(F.col("class_id").alias("cid"), "name")


BOXES = "boxes AS (SELECT l_orderkey AS image, l_linenumber AS seq, (l_partkey % 600)::INT AS cid, l_quantity / 50 AS w, l_discount * 10 AS h, l_tax AS cx, 0.5 AS cy FROM lineitem)"
NAMED_BOXES = f"{BOXES}, named AS (SELECT boxes.*, coalesce(nullif(name, ''), '#' || cid) AS name FROM boxes LEFT JOIN class_map ON class_id = cid)"


@query(f"""WITH {NAMED_BOXES}, c AS (SELECT image, name, count(*) AS n FROM named GROUP BY 1, 2)
SELECT image, 'Objects: ' || string_agg(CASE WHEN n > 1 THEN name || '×' || n ELSE name END, ', ' ORDER BY n DESC, name) AS caption FROM c GROUP BY 1""")
def caption_from_boxes(spark, d):
    """Captions of the objects in each image; class ids of the same name count together."""
    return labels.object_captions(labels.named(boxes(spark, d), class_names(spark, d)))


@query(f"WITH {BOXES} SELECT cid, count(*) AS n FROM boxes GROUP BY 1")
def class_histogram(spark, d):
    return labels.class_histogram(boxes(spark, d))


@query(f"WITH {NAMED_BOXES}, f AS (SELECT image, name, min(seq) AS first_ FROM named GROUP BY 1, 2) SELECT image, string_agg(name, '|' ORDER BY first_, name) AS names FROM f GROUP BY 1")
def names_in(spark, d):
    """The different names of each image in order."""
    listed = labels.names_in_order(labels.named(boxes(spark, d), class_names(spark, d)))
    return listed.select("image", F.array_join("names", "|").alias("names"))


@query(f"""WITH {BOXES}, f AS (SELECT cid, count(*) AS n FROM boxes GROUP BY 1)
SELECT coalesce(f.cid, class_id) AS cid, coalesce(n, 0) AS n, coalesce(name, '') AS name FROM f FULL JOIN class_map ON class_id = f.cid""")
def class_list(spark, d):
    """Class ids found in boxes and those that have a name."""
    return labels.class_list(labels.class_histogram(boxes(spark, d)), class_names(spark, d))


@query(f"""WITH {BOXES}, s AS (SELECT *, w * h AS area FROM boxes WHERE w * h <= 0.88),
i AS (SELECT *, row_number() OVER (PARTITION BY cid, image ORDER BY area DESC, image, seq) AS r FROM s QUALIFY r <= 2)
SELECT cid, image, seq, round(area, 6) AS area, row_number() OVER (PARTITION BY cid ORDER BY area DESC, image, seq)::INT AS rank FROM i QUALIFY rank <= 16""")
def top_boxes_per_class(spark, d):
    """The 16 largest boxes of each class, at most two of an image."""
    return labels.top_boxes(boxes(spark, d)).select("cid", "image", "seq", six(F.col("area")).alias("area"), F.col("rank").cast("int").alias("rank"))


@query(f"WITH {BOXES} SELECT cid, count(*) AS n, round(median(w * h), 6) AS median_area, round(median(CASE WHEN h > 0 THEN w / h ELSE 0 END), 6) AS median_ratio FROM boxes GROUP BY 1")
def box_stats(spark, d):
    return labels.box_stats(boxes(spark, d)).select("cid", "n", six(F.col("median_area")).alias("median_area"), six(F.col("median_ratio")).alias("median_ratio"))


@query(f"""WITH {BOXES} SELECT image, seq, (cid * 57) % 360 AS hue, greatest(0, trunc((cx - w / 2) * 640 - w * 640 * 0.02)::INT) AS x1, greatest(0, trunc((cy - h / 2) * 480 - h * 480 * 0.02)::INT) AS y1,
least(640, trunc((cx + w / 2) * 640 + w * 640 * 0.02)::INT) AS x2, least(480, trunc((cy + h / 2) * 480 + h * 480 * 0.02)::INT) AS y2 FROM boxes""")
def crop_rects(spark, d):
    """Pixel rectangles of boxes, padded by two percent, and the colours of their classes."""
    size = [F.lit(640.0), F.lit(480.0)]
    return boxes(spark, d).select("image", "seq", labels.class_hue(F.col("cid")).alias("hue"), *labels.pixel_rect(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), *size, pad=0.02))


@query("SELECT l_orderkey AS image, count(*) AS n, sum((l_partkey % 600)::INT)::BIGINT AS cids, round(sum(l_quantity), 4) AS w FROM lineitem GROUP BY 1")
def yolo_roundtrip(spark, d):
    """Label texts written from boxes and parsed again."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"), "l_linenumber", F.concat_ws(" ", (F.col("l_partkey") % 600).cast("string"), F.lit("0.5"), F.lit("0.5"), F.col("l_quantity").cast("string"), F.lit("0.25"), F.lit("extra")).alias("line")
    )
    written = rows.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return labels.parse_boxes(written, "image", "text").groupBy("image").agg(F.count("*").alias("n"), F.sum("cid").alias("cids"), F.round(F.sum("w"), 4).alias("w"))


# representatives


@query("""WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
mm AS (SELECT label, list(m ORDER BY i)::DOUBLE[64] AS v FROM m GROUP BY 1),
s AS (SELECT label, vec_id, round(array_inner_product(embedding::DOUBLE[64], v) / sqrt(array_inner_product(v, v)), 9) AS s FROM embeddings JOIN mm USING (label))
SELECT label, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) = 1""")
def centroid_representative(spark, d):
    found = representative.centroid(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return found.select("label", "vec_id", six(F.col("similarity")).alias("similarity"))


MEMBERS = r"""members AS (SELECT DISTINCT folder, image_path FROM graph_records WHERE image_path IS NOT NULL AND folder IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY lower(image_path), image_path) - 1 AS pos, count(*) OVER (PARTITION BY folder) AS n FROM members)"""


def members(spark, d) -> DataFrame:
    rows = table(spark, d, "graph_records").filter("image_path is not null and folder is not null").select("folder", "image_path").distinct()
    return rows.withColumn("lower", F.lower("image_path"))


@query(f"""WITH {MEMBERS}, picks AS (SELECT DISTINCT folder, round_even(i * (n - 1) / 15.0, 0)::BIGINT AS pos FROM (SELECT DISTINCT folder, n FROM placed WHERE n > 16), range(16) t(i))
SELECT folder, image_path, pos, n FROM placed WHERE n <= 16 OR (folder, pos) IN (SELECT (folder, pos) FROM picks)""")
def evenly_spaced_sample(spark, d):
    """At most 16 evenly spaced images of each folder."""
    return representative.evenly_spaced(members(spark, d), "folder", ["lower", "image_path"], 16).select("folder", "image_path", F.col("pos").cast("long").alias("pos"), "n")


@query(f"WITH {MEMBERS} SELECT folder, image_path, n FROM placed WHERE pos = n // 2")
def middle_pick(spark, d):
    return representative.middle(members(spark, d), "folder", ["lower", "image_path"]).select("folder", "image_path", "n")


def hashed_members(spark, d) -> DataFrame:
    sample = representative.evenly_spaced(members(spark, d), "folder", ["lower", "image_path"], 16)
    # no pixels here: 60 bits of a digest of the path stand in for the perceptual hash
    return sample.withColumn("bits", F.conv(F.substring(F.md5(F.col("image_path").cast("binary")), 1, 15), 16, 10).cast("long"))


@query(f"""WITH {MEMBERS}, picks AS (SELECT DISTINCT folder, round_even(i * (n - 1) / 15.0, 0)::BIGINT AS pos FROM (SELECT DISTINCT folder, n FROM placed WHERE n > 16), range(16) t(i)),
s AS (SELECT folder, pos, ('0x' || substr(md5(image_path), 1, 15))::BIGINT AS bits FROM placed WHERE n <= 16 OR (folder, pos) IN (SELECT (folder, pos) FROM picks)),
dd AS (SELECT a.folder, a.pos, sum(bit_count(xor(a.bits, b.bits)))::BIGINT AS distance FROM s a JOIN s b USING (folder) GROUP BY 1, 2)
SELECT folder, pos, distance FROM dd QUALIFY row_number() OVER (PARTITION BY folder ORDER BY distance, pos) = 1""")
def dhash_medoid(spark, d):
    return representative.medoid(hashed_members(spark, d), "folder", "pos", "bits").select("folder", F.col("pos").cast("long").alias("pos"), F.col("distance").cast("long").alias("distance"))


# indexing; the rows of the store indexed by the middle of the time are the old snapshot


def snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "store_rows").filter("id is not null").select("id", "caption", "document", "mtime", "indexed_at")
    old = indexing.last_by(rows.filter("indexed_at < timestamp_ntz'2023-07-01 00:00:00'"), "id", ["indexed_at", "caption", "document"])
    new = indexing.last_by(rows.filter("indexed_at >= timestamp_ntz'2023-04-01 00:00:00'"), "id", ["indexed_at", "caption", "document"])
    return old.drop("indexed_at"), new.drop("indexed_at")


_LAST = "row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, caption DESC NULLS LAST, document DESC NULLS LAST) = 1"
SNAPSHOTS = f"""old AS (SELECT id, caption, document, mtime FROM store_rows WHERE id IS NOT NULL AND indexed_at < TIMESTAMP '2023-07-01' QUALIFY {_LAST}),
new AS (SELECT id, caption, document, mtime FROM store_rows WHERE id IS NOT NULL AND indexed_at >= TIMESTAMP '2023-04-01' QUALIFY {_LAST})"""
STATUS = f"""{SNAPSHOTS}, status AS (SELECT coalesce(new.id, old.id) AS id, CASE WHEN old.id IS NULL THEN 'new' WHEN new.id IS NULL THEN 'gone' WHEN old.mtime = new.mtime THEN 'same' ELSE 'changed' END AS status
  FROM new FULL JOIN old ON old.id = new.id)"""


def status(spark, d) -> DataFrame:
    old, new = snapshots(spark, d)
    return indexing.classify(new.select("id", F.col("mtime").alias("change_key")), old.select("id", F.col("mtime").alias("change_key")))


@query(f"WITH {STATUS} SELECT id, status FROM status")
def index_diff(spark, d):
    """What is new, changed, the same and gone between two snapshots."""
    return status(spark, d)


@query(f"""WITH {STATUS} SELECT count(*) FILTER (status IN ('new', 'changed')) AS written, count(*) FILTER (status = 'same') AS skipped, count(*) FILTER (status = 'gone') AS pruned, 0::BIGINT AS failed,
count(*) FILTER (status <> 'gone') AS total FROM status""")
def build_report(spark, d):
    return indexing.build_report(status(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_snapshot(spark, d):
    old, new = snapshots(spark, d)
    return indexing.upsert(old, new)


@query(f"WITH {SNAPSHOTS} SELECT old.id, coalesce(new.caption, old.caption) AS caption, coalesce(new.document, old.document) AS document, old.mtime FROM old LEFT JOIN new ON new.id = old.id")
def update_meta(spark, d):
    """New captions and documents on the old records, their change keys staying."""
    old, new = snapshots(spark, d)
    return indexing.update_columns(old, new, ["caption", "document"])


@query(f"WITH {SNAPSHOTS} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def delete_ids(spark, d):
    old, new = snapshots(spark, d)
    return indexing.delete(old, new)


@query(rf"SELECT DISTINCT leaf_folder FROM store_rows WHERE leaf_folder IS NOT NULL AND lower(rtrim(replace(leaf_folder, '\', '/'), '/')) NOT IN (SELECT lower(rtrim(replace(path, '\', '/'), '/')) FROM leaf_folders WHERE path IS NOT NULL AND scanned_at < TIMESTAMP '2023-07-01')")
def prune_missing(spark, d):
    """Folders of the store that the tree didn't have by the middle of the time."""
    kept = table(spark, d, "store_rows").filter("leaf_folder is not null").select("leaf_folder").distinct().withColumn("id", P.folder_id(F.col("leaf_folder")))
    there = table(spark, d, "leaf_folders").filter("path is not null and scanned_at < timestamp_ntz'2023-07-01 00:00:00'").select(P.folder_id(F.col("path")).alias("id")).distinct()
    return indexing.delete(kept, there).select("leaf_folder")


@query(f"WITH {CURRENT} SELECT id, mtime, coalesce(document, '') AS document FROM cur WHERE mtime IS NOT NULL")
def existing_mtimes(spark, d):
    return store_rows(spark, d).filter("mtime is not null").select("id", "mtime", F.coalesce("document", F.lit("")).alias("document"))


@query(f"WITH {CURRENT} SELECT DISTINCT hit_id, cur.id, coalesce(nullif(cur.caption, ''), document, '') AS caption FROM folder_hits JOIN cur ON cur.representative_image = folder_hits.image_path")
def fetch_hits(spark, d):
    """Records of the images of all hits; images that the store doesn't have drop out."""
    hits = table(spark, d, "folder_hits").select("hit_id", "image_path").distinct()
    return hits.join(store_hits(spark, d), "image_path").select("hit_id", "id", P.display_caption(F.col("caption"), F.col("document")).alias("caption")).distinct()


# keys and documents


@query(r"""SELECT DISTINCT image_path, sha1(lower(replace(image_path, '\', '/'))) AS image_id, sha1(regexp_replace(lower(replace(folder, '\', '/')), '/+$', '')) AS folder_id,
regexp_extract(replace(image_path, '\', '/'), '([^/]*)/*$', 1) AS name FROM graph_records WHERE image_path IS NOT NULL""")
def path_keys(spark, d):
    rows = table(spark, d, "graph_records").filter("image_path is not null")
    p = F.col("image_path")
    return rows.select("image_path", P.image_id(p).alias("image_id"), P.folder_id(F.col("folder")).alias("folder_id"), P.basename(p).alias("name")).distinct()


@query("""SELECT DISTINCT record_id, CASE WHEN loaded_at IS NULL THEN epoch_us(scanned_at)::VARCHAR WHEN scanned_at IS NULL THEN epoch_us(loaded_at)::VARCHAR ELSE epoch_us(scanned_at) || '|' || epoch_us(loaded_at) END AS key FROM graph_records""")
def composite_keys(spark, d):
    """Keys of two times, either of which may be missing."""
    rows = table(spark, d, "graph_records")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string")
    return rows.select("record_id", P.composite_key(micros("scanned_at"), micros("loaded_at")).alias("key")).distinct()


@query(r"""SELECT DISTINCT folder_id, coalesce(nullif(regexp_replace(coalesce(sidecar_text, ''), '^\s+|\s+$', '', 'g'), ''), path) AS document, left(coalesce(sidecar_text, ''), 400) AS shown FROM leaf_folders""")
def folder_documents(spark, d):
    rows = table(spark, d, "leaf_folders")
    return rows.select("folder_id", P.folder_document(F.lit(None), F.col("sidecar_text"), F.col("path")).alias("document"), F.left(F.coalesce("sidecar_text", F.lit("")), F.lit(400)).alias("shown")).distinct()


# features


@query(rf"""WITH c AS (SELECT DISTINCT caption FROM folder_hits WHERE caption IS NOT NULL), t AS (SELECT unnest({TOKENS.format(t='caption')}) AS tok FROM c),
g AS (SELECT unnest(list_transform(range(1, len(tok)), lambda i: substr(tok, i, 2))) AS gram FROM t WHERE len(tok) >= 2 UNION ALL SELECT unnest(list_transform(range(1, len(tok) - 1), lambda i: substr(tok, i, 3))) FROM t WHERE len(tok) >= 3)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def ngram_features(spark, d):
    """Uses of the bigrams and trigrams of all different captions."""
    t = table(spark, d, "folder_hits").filter("caption is not null").select("caption").distinct().select(F.explode(X.tokenize(F.col("caption"))).alias("tok"))
    grams = t.select(F.explode(F.concat(X.char_ngrams(F.col("tok"), 2), X.char_ngrams(F.col("tok"), 3))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query(rf"""WITH {CURRENT}, {SYNONYMS}, docs AS (SELECT id, caption AS text FROM cur),
tok AS (SELECT id, unnest({TOKENS.format(t='text')}) AS tok FROM docs), st AS (SELECT id, tok, {STEM_SQL.format(t='tok')} AS stem FROM tok),
f AS (SELECT id, 'w:' || tok AS feature, 3.0 AS weight FROM st UNION ALL SELECT id, 'w:' || stem, 2.0 FROM st WHERE stem <> tok UNION ALL SELECT id, 'w:' || en, 2.0 FROM st JOIN syn ON ko = tok UNION ALL SELECT id, 'w:' || en, 2.0 FROM st JOIN syn ON ko = stem
  UNION ALL SELECT id, 'g2:' || unnest(list_transform(range(1, len(tok)), lambda i: substr(tok, i, 2))), 1.0 FROM st WHERE len(tok) >= 2 UNION ALL SELECT id, 'g3:' || unnest(list_transform(range(1, len(tok) - 1), lambda i: substr(tok, i, 3))), 0.7 FROM st WHERE len(tok) >= 3),
ff AS (SELECT * FROM f UNION ALL SELECT id, 'raw:' || coalesce(nullif(text, ''), '∅'), 1.0 FROM docs WHERE id NOT IN (SELECT id FROM f)),
b AS (SELECT id, ((('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT) % 512)::INT AS bucket, sum(weight)::DOUBLE AS w FROM (SELECT id, md5(feature) AS h, weight FROM ff) GROUP BY 1, 2)
SELECT id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM b""")
def feature_hash_vectors(spark, d):
    """Hashed feature vectors of the captions of the store."""
    found = V.hashed_features(store_rows(spark, d), "id", "caption", 512)
    return found.select("id", "bucket", six(F.col("weight")).alias("weight"))


@query(rf"""WITH q AS (SELECT DISTINCT hit_id, caption FROM folder_hits WHERE caption IS NOT NULL), {SYNONYMS}, s1 AS (SELECT ko, list(en) AS l FROM syn GROUP BY 1),
t AS (SELECT hit_id, caption, unnest({TOKENS.format(t='caption')}) AS tok, generate_subscripts({TOKENS.format(t='caption')}, 1) AS pos FROM q), st AS (SELECT *, {STEM_SQL.format(t='tok')} AS stem FROM t),
x AS (SELECT hit_id, caption, pos, 0 AS part, 0 AS sub, tok AS term FROM st UNION ALL SELECT hit_id, caption, pos, 1, 0, stem FROM st
  UNION ALL SELECT hit_id, caption, pos, 2, generate_subscripts(l, 1), unnest(l) FROM st JOIN s1 ON ko = tok UNION ALL SELECT hit_id, caption, pos, 3, generate_subscripts(l, 1), unnest(l) FROM st JOIN s1 ON ko = stem),
u AS (SELECT hit_id, caption, term, min((pos, part, sub)) AS first_ FROM x GROUP BY 1, 2, 3), e AS (SELECT hit_id, caption, string_agg(term, ' ' ORDER BY first_) AS expanded FROM u GROUP BY 1, 2)
SELECT q.hit_id, coalesce(expanded, q.caption) AS expanded FROM q LEFT JOIN e USING (hit_id, caption)""")
def expand_queries(spark, d):
    """Captions as queries, expanded."""
    rows = table(spark, d, "folder_hits").filter("caption is not null").select("hit_id", "caption").distinct()
    return rows.select("hit_id", X.expand_query(F.col("caption")).alias("expanded"))


_CONCEPTS = ", ".join(f"('{k}', '{v}')" for k, v in X.CONCEPTS.items())


@query(rf"""WITH con AS (SELECT * FROM (VALUES {_CONCEPTS}) s(word, concept)), q AS (SELECT DISTINCT doc_id, text FROM documents),
t AS (SELECT doc_id, unnest({TOKENS.format(t='text')}) AS tok FROM q), st AS (SELECT doc_id, tok, {STEM_SQL.format(t='tok')} AS stem FROM t),
c AS (SELECT DISTINCT doc_id, coalesce(a.concept, b.concept) AS concept FROM st LEFT JOIN con a ON a.word = tok LEFT JOIN con b ON b.word = stem)
SELECT concept, count(*) AS n_docs FROM c WHERE concept IS NOT NULL GROUP BY 1""")
def concept_counts(spark, d):
    """Documents that name each concept."""
    rows = documents(spark, d).select("doc_id", F.explode(X.concept_hints(F.col("text"))).alias("concept"))
    return rows.groupBy("concept").agg(F.count("*").alias("n_docs"))


# results, history, profiles


@query("SELECT DISTINCT hit_id, query_id, CASE WHEN score::VARCHAR = 'nan' THEN 'NaN' ELSE printf('%.4f', score) END AS score, caption, image_path, folder, member_count FROM folder_hits WHERE score::VARCHAR = 'nan' OR abs(score * 10000 - floor(score * 10000) - 0.5) > 1e-6")
def result_export(spark, d):
    """All rows of a result export; scores are rounded by their exact binary value, exact halves to even, and null scores stay null."""
    rows = table(spark, d, "folder_hits").select("hit_id", "query_id", "score", "caption", "image_path", "folder", "member_count").distinct()
    return history.result_rows(rows, "hit_id", "query_id")


HITS = "h AS (SELECT DISTINCT hit_id, query_id, folder, image_path, caption, fused_score FROM folder_hits), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, hit_id, caption NULLS FIRST) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM h)"


def ranked_hits(spark, d) -> DataFrame:
    return table(spark, d, "folder_hits").select("hit_id", "query_id", "folder", "image_path", "caption", "fused_score").distinct()


def _order() -> list[Column]:
    return [F.desc("fused_score"), F.col("hit_id"), F.col("caption").asc_nulls_first()]


@query(f"WITH {HITS} SELECT query_id, string_agg('- ' || coalesce(folder, '') || ': ' || coalesce(caption, ''), chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 8 GROUP BY 1")
def prompt_context(spark, d):
    """The first eight hits of each query as lines for a model."""
    line = F.concat(F.lit("- "), F.coalesce("folder", F.lit("")), F.lit(": "), F.coalesce("caption", F.lit("")))
    return history.first_lines(ranked_hits(spark, d), "query_id", _order(), line, 8, "\n").withColumnRenamed("text", "context")


@query(f"WITH {HITS} SELECT query_id, string_agg(image_path, chr(10) ORDER BY rank) AS paths FROM r GROUP BY 1")
def path_lists(spark, d):
    """The image paths of each query, in order."""
    return history.first_lines(ranked_hits(spark, d), "query_id", _order(), F.col("image_path"), 2**31 - 1, "\n").withColumnRenamed("text", "paths")


@query("""WITH k AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR event_type IS DISTINCT FROM b)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS pos FROM k QUALIFY pos <= 200""")
def history_dedupe(spark, d):
    """Entries of each user that differ from the one before, the last 200."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return history.without_repeats(rows, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", F.col("pos").cast("int").alias("pos"))


@query("SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents GROUP BY 1")
def dataset_profile(spark, d):
    """Sizes of the documents of each folder."""
    return history.median_profile(table(spark, d, "documents"), "source", F.col("n_chars"))


@query("SELECT len(string_split(trim(replace(path, '\\', '/'), '/'), '/')) AS depth, count(*) AS n, count(*) FILTER (sidecar_text IS NOT NULL AND sidecar_text <> '') AS with_text, sum(len(image_paths))::BIGINT AS images FROM (SELECT DISTINCT * FROM leaf_folders) WHERE path IS NOT NULL GROUP BY 1".replace("\\\\", "\\"))
def depth_histogram(spark, d):
    """Folders by depth: how many, how many with text, images."""
    rows = table(spark, d, "leaf_folders").distinct().filter("path is not null")
    depth = F.size(F.split(F.regexp_replace(P.slashes(F.col("path")), "^/+|/+$", ""), "/"))
    return rows.groupBy(depth.alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.col("sidecar_text").isNotNull() & (F.col("sidecar_text") != "")).alias("with_text"), F.sum(F.size("image_paths")).alias("images"))


@query("SELECT date_trunc('day', hit_at) AS start, match, count(*) AS n FROM folder_hits WHERE hit_at IS NOT NULL GROUP BY 1, 2")
def stream_hits_by_day(spark, d):
    """Hits by day and provenance, read as a stream to its end."""
    from tessera.streaming.ingest import windowed_counts

    path = f"{d}/folder_hits.parquet"
    schema = spark.read.parquet(path).schema
    source = os.path.dirname(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", "folder_hits.parquet").parquet(source)
    counted = windowed_counts(stream.filter("hit_at is not null").withColumn("hit_at", F.col("hit_at").cast("timestamp")), "hit_at", "1 day", ["match"], "30 days")
    at = f"{shared_folder(spark).rstrip('/')}/hits-by-day-{os.urandom(6).hex()}"
    # the counts so far replace those before, in files: none of them pass the driver
    write = lambda counts, _: counts.write.mode("overwrite").parquet(f"{at}/counts")
    run = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "match", "n")
