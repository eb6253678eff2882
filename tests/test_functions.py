import hashlib
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import embedding, paths, text, topk, vector
from tessera.plans import planner


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).head()[0]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.col("t")), t="Find the RED 오토바이, B급 photo 7") == ["red", "오토바이", "B급", "7"]
    assert one(spark, text.tokenize(F.col("t")), t="The Car가 AB") == ["Car가", "ab"]
    assert one(spark, text.tokenize(F.col("t")), t=None) == []


def test_particles_and_translations(spark):
    assert one(spark, text.strip_particle(F.col("t")), t="공원에서는") == "공원"
    assert one(spark, text.strip_particle(F.col("t")), t="는") == "는"
    assert one(spark, text.lexical_tokens(F.col("t")), t="고양이가") == ["고양이가", "고양이", "cat"]
    # the translations come twice where nothing is stripped
    assert one(spark, text.lexical_tokens(F.col("t")), t="버스") == ["버스", "bus", "bus"]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab가나는을밤에서 Z9,", max_size=20))
def test_driver_and_column_agree(spark, t):
    assert one(spark, text.expand_query(F.col("t")), t=t) == planner.expand(t)


def test_features_and_buckets(spark):
    found = one(spark, text.feature_tokens(F.col("t")), t="밤에")
    assert [(f["feature"], f["weight"]) for f in found][:2] == [("w:밤에", 3.0), ("w:밤", 2.0)]
    assert ("w:night", 2.0) in [tuple(f) for f in found] and ("g2:밤에", 1.0) in [tuple(f) for f in found]
    want = int.from_bytes(hashlib.md5("w:밤".encode()).digest()[:4], "little") % 512
    assert one(spark, text.hash_bucket(F.col("t"), 512), t="w:밤") == want


def test_sparse_and_dense_features_agree(spark):
    docs = ["red car at night", "밤에 오토바이가", "", None]
    rows = vector.hashed_features(spark.createDataFrame(list(enumerate(docs)), "id int, text string"), "id", "text", 64).collect()
    for i, t in enumerate(docs):
        dense = np.zeros(64)
        for r in rows:
            if r["id"] == i:
                dense[r["bucket"]] = r["weight"]
        assert np.allclose(dense, embedding.text_vector(t or "", 64), atol=1e-6)


def test_negation(spark):
    assert one(spark, text.negated(F.col("q"), F.col("n")), q="오토바이 없는 거리", n="오토바이") is True
    assert one(spark, text.negated(F.col("q"), F.col("n")), q="street without car", n="car") is True
    assert one(spark, text.negated(F.col("q"), F.col("n")), q="car street", n="car") is False
    assert one(spark, text.negated(F.col("q"), F.col("n")), q="street", n="car") is None


def test_concepts_and_white_space(spark):
    assert one(spark, text.concept_hints(F.col("t")), t="Night 화재가 fire") == ["night", "fire"]
    assert one(spark, text.collapse(F.col("t")), t="  a\n b\t c ") == "a b c"


def test_scores(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-0.5,), (0.25,), (None,)], "s double")
    assert [r[0] for r in rows.select(vector.clamp_score(F.col("s"))).collect()] == [0, 0, 0, 0.25, 0]
    shown = rows.select(paths.passes_threshold(F.col("s"), F.lit("vector"), 0.2)).collect()
    assert [r[0] for r in shown] == [False, True, False, True, False]
    assert one(spark, paths.passes_threshold(F.lit(0.0), F.col("m"), 0.5), m="graph") is True


def test_paths(spark):
    assert one(spark, paths.image_id(F.col("p")), p="A\\B/C.JPG") == hashlib.sha1(b"a/b/c.jpg").hexdigest()
    assert one(spark, paths.folder_id(F.col("p")), p="/A/b//") == hashlib.sha1(b"/a/b").hexdigest()
    assert one(spark, paths.path_text(F.col("p")), p="/x/y/zoo/cat.tar.gz") == "y zoo cat.tar"
    assert one(spark, paths.stem(F.col("p")), p="/x/.hidden") == ".hidden"
    assert one(spark, paths.change_key(F.col("s")), s=1.5) == "1.500"
    assert one(spark, paths.composite_key(F.lit("1.000"), F.col("b")), b=None) == "1.000"
    assert one(spark, paths.folder_document(F.col("c"), F.lit(" "), F.lit("/p")), c=None) == "/p"
    assert one(spark, paths.image_document(F.col("c"), F.lit("/p/a.jpg")), c=" ") == "a.jpg"


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[10] = x[11]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [math.nan] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for block in (7, 1000):
        got = vector.nearest(df.filter("id % 50 = 0"), df, 5, 8, exclude_self=True, block_rows=block).collect()
        u = x / np.linalg.norm(x, axis=1)[:, None]
        for q in range(0, 300, 50):
            order = sorted((i for i in range(300) if i != q), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:5]
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == order
    assert vector.nearest(df.limit(0), df, 5, 8).count() == 0
    assert vector.nearest(df.filter("id = 1"), df.limit(0), 5, 8).count() == 0


def test_images_without_libraries():
    image = np.zeros((20, 30, 3), np.uint8)
    image[:, 15:] = (200, 100, 50)
    assert (embedding._bmp(embedding.write_bmp(image)) == image).all()
    assert embedding._bmp(b"BMxx") is None
    v = embedding.visual_descriptor(image, "p")
    assert v.shape == (304,) and abs(v[256:].sum() - 1) < 1e-5
    assert (embedding.visual_descriptor(None, "p") == embedding.visual_descriptor(None, "p")).all()
    assert embedding.dhash(image) != embedding.dhash(image[:, ::-1])


def test_nearest_of_many_queries(spark, monkeypatch):
    """Many queries go in groups of fewer tasks; rows that tie with the last one go by id, however many they are."""
    assert topk.layout(1, 24, 6)[0] == 1 and topk.layout(29_250, 72, 6) == (6, 1) and topk.layout(29_250, 24, 6) == (3, 2)
    monkeypatch.setattr(topk, "CANDIDATES", 500)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 8))
    x[200:260] = x[100]
    rows = spark.createDataFrame([(f"r{i:03}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, vector array<float>").repartition(16)
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:120])], "id long, vector array<double>")
    found = vector.nearest(asked, rows, 5, 8)
    assert sum(1 for line in found._jdf.queryExecution().toString().split("== Physical")[0].splitlines() if "MapInArrow" in line) > 1
    x32 = x.astype(np.float32).astype(np.float64)
    s = np.round((x[:120] / np.linalg.norm(x[:120], axis=1)[:, None]) @ (x32 / np.linalg.norm(x32, axis=1)[:, None]).T, 12)
    want = {(q, f"r{i:03}", n + 1) for q in range(120) for n, i in enumerate(np.lexsort((np.arange(900), -s[q]))[:5])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == want


def test_a_task_holds_few_results_however_many_the_queries():
    for n, k in ((29_250, 72), (29_250, 216), (292_500, 72), (3_000_000, 24)):
        groups, tasks = topk.layout(n, k, 6)
        assert groups * 1_000_000 >= n * k and groups * tasks % 6 == 0
    assert topk.layout(1, 10**9, 6)[0] == 1


def test_best_keeps_few_rows_of_a_tie():
    top = topk.Best(2, 3)
    for at in range(5, 0, -1):
        top.begin(pa.array([f"{at}{i:04}" for i in range(400)]))
        near = np.ones((2, 400), np.float32)
        top.scan(near, 0, np.full(2, 1e-6), -3.0, lambda q, row: (np.ones(len(q)), np.zeros(len(q), np.int32)))
        top.settle()
        assert len(top.found[0]) <= 12 and top.held <= 12
    got = pa.Table.from_batches(top.batches_of(pa.array([7, 8]), ["q", "id", "score"])).to_pydict()
    assert set(zip(got["q"], got["id"])) == {(q, f"1{i:04}") for q in (7, 8) for i in range(3)}
