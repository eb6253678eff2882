import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import topk
from tessera.operators import graph, history, indexing, labels, lexical, ranking, representative, retrieval

RECORDS = [("a", "f", ["사람", "오토바이"]), ("b", "f", ["사람", "차"]), ("c", "g", ["사람", "오토바이", "차"]), ("d", "g", ["휴대폰"]), ("e", "g", []), (None, "g", ["차"]), ("d", "g", ["휴대폰", None, " "])]


def edges(spark):
    return graph.edges_of(spark.createDataFrame(RECORDS, "image_path string, folder string, classes array<string>"))


def test_graph(spark):
    e = edges(spark)
    assert graph.image_count(e).head()[0] == 4
    assert {tuple(r) for r in graph.class_counts(e).collect()} == {("사람", 3), ("오토바이", 2), ("차", 2), ("휴대폰", 1)}
    assert {tuple(r) for r in graph.top_pairs(e).collect()} == {("사람", "오토바이", 2), ("사람", "차", 2), ("오토바이", "차", 1)}
    assert [tuple(r) for r in graph.cooccurring(e, "사람").collect()] == [("오토바이", 2), ("차", 2)]
    assert {r[0] for r in graph.images_with_all(e, ["사람", "오토바이", "사람"]).collect()} == {"a", "c"}
    assert graph.images_with_all(e, []).count() == 0 and graph.images_with_any(e, []).count() == 0
    assert {r[0] for r in graph.images_with_any(e, ["휴대폰", "차"]).collect()} == {"b", "c", "d"}


def test_bm25(spark):
    docs = spark.createDataFrame([("x", "빨간 자동차가 도로에"), ("y", "고양이 두 마리"), ("z", "도로 위의 고양이"), ("n", None), ("s", "the of")], "id string, text string")
    index = lexical.build_index(docs, "id", "text", version=3).keep()
    assert index.version == 3 and {r[0] for r in index.postings.filter("term = '∅'").select("id").collect()} == {"n", "s"}
    q = spark.createDataFrame([(1, "고양이"), (2, "없는낱말"), (3, "car")], "query_id int, text string")
    got = [(r["query_id"], r["id"]) for r in lexical.bm25(index, q, 5).orderBy("query_id", "rank").collect()]
    assert {x for x in got if x[0] == 1} == {(1, "y"), (1, "z")} and not [x for x in got if x[0] == 2] and (3, "x") in got
    assert lexical.bm25(index, q, 0).filter("query_id = 1").count() == 1
    index.drop()
    empty = lexical.build_index(docs.limit(0), "id", "text")
    assert lexical.bm25(empty, q).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.permutations("abcdef").map(lambda p: p[:4]), min_size=1, max_size=3))
def test_fusion(spark, lists):
    arms = [spark.createDataFrame([(1, x, r + 1) for r, x in enumerate(arm)], "query_id int, id string, rank int") for arm in lists]
    got = {r["id"]: r["fused"] for r in retrieval.fuse(arms).collect()}
    want = {x: sum(1 / (61 + arm.index(x)) for arm in lists if x in arm) for arm in lists for x in arm}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def search(spark):
    rows = [("i1", [1.0, 0.0], "red car", "red car", "f1"), ("i2", [0.9, 0.1], "blue car", None, "f2"), ("i3", [0.0, 1.0], "red bus", "", "f3"), ("i4", [-1.0, 0.0], "nothing", "x", "f4"), ("i5", None, "red", "red", "f5")]
    store = spark.createDataFrame([(a, v, d, c, f, a, 1, "") for a, v, d, c, f in rows], "id string, vector array<double>, document string, caption string, folder string, image_path string, member_count int, sidecar_text string")
    return store, spark.createDataFrame([(1, "red", [1.0, 0.0])], "query_id int, text string, vector array<double>")


def test_search_modes(spark):
    store, q = search(spark)
    index = lexical.build_index(store, "id", "document")
    v = retrieval.vector_search(q, store, 3, 2).orderBy("rank").collect()
    assert [r["id"] for r in v] == ["i1", "i2", "i3"] and all(r["match"] == "vector" and r["fused"] == 0 for r in v)
    assert v[1]["caption"] == "blue car"  # the document stands in
    k = {r["id"]: r for r in retrieval.keyword_search(q, store, index, 5).collect()}
    assert k.keys() == {"i1", "i3", "i5"} and k["i1"]["score"] == 1.0 and k["i5"]["score"] == 0.0
    h = {r["id"]: r for r in retrieval.hybrid_search(q, store, index, 10, 2).collect()}
    assert {x: r["match"] for x, r in h.items()} == {"i1": "both", "i2": "vector", "i3": "both", "i4": "vector", "i5": "keyword"}
    assert all(0 <= r["score"] <= 1 for r in h.values())
    like = retrieval.by_example(spark.createDataFrame([("i1",), ("i5",), ("zz",)], "id string"), store, 2, 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in like] == [("i1", "i2"), ("i1", "i3")]


def test_object_filter(spark):
    store, q = search(spark)
    hits = retrieval.vector_search(q, store, 2, 2)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    names = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert names(retrieval.filter_by_objects(hits, store, q, ids("i1", "i3"), None, 5, 2)) == ["i1", "i3"]
    assert names(retrieval.filter_by_objects(hits, store, q, None, ids("i1"), 5, 2)) == ["i2"]
    assert names(retrieval.filter_by_objects(hits, store, q, ids().limit(0), None, 5, 2)) == []
    assert names(retrieval.filter_by_objects(hits, store, q, None, None, 5, 2)) == ["i1", "i2"]


def test_boxes(spark):
    texts = [("a", "0 .5 .5 .2 .3\n1 0.5 0.5 0.1 0.1 9\nbad line\n0 1 2 3"), ("b", "2.0 1e-1 .5 .5 .5\ninf 1 1 1 1\nnan 1 1 1 1\n-1 0 0 1 1"), ("c", ""), ("d", None)]
    df = spark.createDataFrame(texts, "image string, text string")
    boxes = labels.parse_boxes(df, "image", "text")
    assert {(r["image"], r["seq"], r["cid"]) for r in boxes.collect()} == {("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 3, -1)}
    assert [r[0] for r in spark.createDataFrame([("0 1 2 3 4\n\n",), ("0 1 2 3 4\nhello",), ("",), (None,), ("0 1 2 3",)], "t string").select(labels.is_yolo_text(F.col("t"))).collect()] == [True, False, False, False, False]
    names = spark.createDataFrame([(0, "car"), (1, "car"), (2, "")], "cid int, name string")
    got = {r["image"]: r["caption"] for r in labels.object_captions(labels.named(boxes, names)).collect()}
    assert got == {"a": "Objects: car×2", "b": "Objects: #-1, #2"}
    assert {r["image"]: r["names"] for r in labels.names_in_order(labels.named(boxes, names)).collect()} == {"a": ["car"], "b": ["#2", "#-1"]}


def test_evenly_spaced(spark):
    import numpy as np

    rows = [(g, i) for g, n in (("a", 100), ("b", 3), ("c", 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    for cap in (1, 2, 5, 16):
        got = representative.evenly_spaced(df, "g", ["i"], cap).collect()
        for g, n in (("a", 100), ("b", 3), ("c", 17)):
            want = set(range(n)) if n <= cap else {int(x) for x in np.linspace(0, n - 1, cap).round()}
            assert {r["i"] for r in got if r["g"] == g} == want, (cap, g)
    assert {(r["g"], r["i"]) for r in representative.middle(df, "g", ["i"]).collect()} == {("a", 50), ("b", 1), ("c", 8)}


def test_representatives(spark):
    rows = [("a", "1", [1.0, 0.0], 0), ("a", "2", [0.7, 0.7], 1), ("a", "3", [0.0, 1.0], 3), ("b", "4", None, 7), ("b", "5", None, 7), ("b", "6", None, 0), ("c", "7", None, None), ("d", "8", None, None), ("d", "9", None, None)]
    df = spark.createDataFrame(rows, "g string, k string, v array<double>, h long")
    got = {r["g"]: (r["k"], r["member_count"], r["method"]) for r in representative.representatives(df, "g", "k", ["k"], "v", "h").collect()}
    assert got == {"a": ("2", 3, "centroid"), "b": ("4", 3, "dhash-medoid"), "c": ("7", 1, "only"), "d": ("9", 2, "middle")}


def test_indexing(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], "id string, change_key string")
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "4"), ("e", None)], "id string, change_key string")
    status = indexing.classify(now, was)
    assert {tuple(r) for r in status.collect()} == {("a", "same"), ("b", "changed"), ("c", "new"), ("d", "gone"), ("e", "changed")}
    bad = spark.createDataFrame([("c", "x")], "id string, error string")
    assert tuple(indexing.build_report(status, bad).head()) == (2, 1, 1, 1, 4)
    rows = spark.createDataFrame([("a", [1.0]), ("b", [math.nan]), ("c", None)], "id string, vector array<double>")
    good, wrong = indexing.split_usable(rows)
    assert [r[0] for r in good.collect()] == ["a"] and {r[0] for r in wrong.collect()} == {"b", "c"}


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 9)), st.dictionaries(st.sampled_from("abcd"), st.integers(0, 9)))
def test_upsert_and_delete(spark, old, new):
    table = lambda d: spark.createDataFrame(list(d.items()), "id string, x int")
    assert dict(indexing.upsert(table(old), table(new)).collect()) == old | new
    assert dict(indexing.upsert(indexing.upsert(table(old), table(new)), table(new)).collect()) == old | new
    assert dict(indexing.delete(table(old), table(new)).collect()) == {k: v for k, v in old.items() if k not in new}
    assert dict(indexing.update_columns(table(old), table(new), ["x"]).collect()) == {k: new.get(k, v) for k, v in old.items()}


def test_history(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbbac")] + [(2, 0, "z"), (2, 1, None), (2, 2, None)], "u int, i int, t string")
    got = sorted((r["u"], r["i"], r["pos"]) for r in history.without_repeats(df, "u", ["i"], "t", 3).collect())
    assert got == [(1, 2, 3), (1, 5, 2), (1, 6, 1), (2, 0, 2), (2, 1, 1)]


def test_numbers_within_groups(spark):
    df = spark.createDataFrame([("big" if i % 3 else None, i) for i in range(500)] + [("small", 1)], "g string, i int")
    got = ranking.number_rows(df, "g", ["i"]).collect()
    for g in ("big", None, "small"):
        rows = sorted((r["i"], r["pos"], r["n"]) for r in got if r["g"] == g)
        assert [p for _, p, _ in rows] == list(range(len(rows))) and {n for *_, n in rows} == {len(rows)}


def test_bm25_of_many_queries(spark, monkeypatch):
    """Groups of queries, terms in a table or searched for, and weights of zero or less give what the join of all pairs gives; pairs of query and document don't become rows."""
    words = ["red", "car", "bus", "road", "도로", "도로에", "고양이", "night", "rain", "fog"]
    text = lambda i, n: " ".join(words[(i * j + i // 7 + j) % len(words)] for j in range(n))
    docs = spark.createDataFrame([(f"d{i:03}", text(i, 1 + i % 6)) for i in range(400)], "id string, text string").repartition(8)
    asked = spark.createDataFrame([(i, text(i * 3, 1 + i % 4)) for i in range(60)] + [(99, "nothing")], "query_id long, text string")
    index = lexical.build_index(docs)
    signed = lexical.LexicalIndex(index.docs, index.idf.withColumn("idf", F.when(F.col("term") == "car", 0.0).when(F.col("term") == "bus", -0.5).otherwise(F.col("idf"))), index.mean_length)
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    for of, table in ((index, lexical.TABLE), (index, 0), (signed, lexical.TABLE)):
        monkeypatch.setattr(lexical, "TABLE", table)
        all_pairs = lexical.bm25(of, asked, None).filter("rank <= 7")
        want = {(r["query_id"], r["id"], r["overlap"], r["rank"], round(r["score"], 7)) for r in all_pairs.collect()}
        found = lexical.bm25(of, asked, 7)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["query_id"], r["id"], r["overlap"], r["rank"], round(r["score"], 7)) for r in found.collect()} == want and len(want) > 300


def test_bm25_of_long_queries(spark, monkeypatch):
    """A task looks up a bounded number of tokens at a time, however long the queries are."""
    words = [f"w{i}" for i in range(200)]
    text = lambda i, n: " ".join(words[(i * 7 + j * (1 + i % 3)) % 200] for j in range(n))
    docs = spark.createDataFrame([(f"d{i:03}", text(i, 1 + i % 9)) for i in range(300)], "id string, text string")
    asked = spark.createDataFrame([(i, text(i, 150)) for i in range(12)] + [(90, "w3"), (91, "nothing")], "query_id long, text string")
    index = lexical.build_index(docs)
    want = {(r["query_id"], r["id"], r["overlap"], r["rank"], round(r["score"], 7)) for r in lexical.bm25(index, asked, None).filter("rank <= 7").collect()}
    seen, finder = [], lexical._Block._finder

    def counted(self, *args):
        find = finder(self, *args)
        return lambda row, t: (seen.append(len(t)), find(row, t))[1]

    weighted = asked.select("query_id", F.explode(F.split("text", " ")).alias("term")).groupBy("query_id", "term").count().join(index.idf, "term")
    weighted = weighted.select("query_id", "term", (F.col("count") * F.col("idf")).alias("weight")).toArrow()
    monkeypatch.setattr(lexical, "PAIR_TOKENS", 1000, raising=False)
    monkeypatch.setattr(lexical._Block, "_finder", counted)
    block = lexical._Block(weighted, 7, 1.5, 0.75, index.mean_length)
    found = [r for b in block(index.docs.toArrow().to_batches()) for r in b.to_pylist()]
    assert max(seen) <= 1000
    order = sorted(found, key=lambda r: (r["query_id"], -r["score"], -r["overlap"], r["id"]))
    ranks = [(r, sum(1 for o in order[:i] if o["query_id"] == r["query_id"]) + 1) for i, r in enumerate(order)]
    assert {(r["query_id"], r["id"], r["overlap"], n, round(r["score"], 7)) for r, n in ranks if n <= 7} == want and len(want) == 13 * 7 - 7 + sum(1 for x in want if x[0] == 90)
