import numpy as np

from tessera.functions.embedding import HashEmbedder, pixels, write_bmp
from tessera.operators import labels
from tessera.operators.store import SnapshotStore
from tessera.plans import settings as S
from tessera.plans.build import IndexSettings, build_index
from tessera.sources import files, pictures


def test_settings(tmp_path):
    at = str(tmp_path / "a/settings.json")
    S.Settings(top_k=7, class_names={"0": "사람"}, degraded="x").save(at)
    assert S.Settings.load(at) == S.Settings(top_k=7, class_names={"0": "사람"})
    S.save_json(at, {"top_k": 9, "unknown": 1, "degraded": "y"})
    assert S.Settings.load(at).top_k == 9 and S.Settings.load(at).degraded == ""
    (tmp_path / "bad.json").write_text("{")
    assert S.Settings.load(str(tmp_path / "bad.json")) == S.Settings() == S.Settings.load(str(tmp_path / "none.json"))
    meta = S.index_meta({"written": 3}, "/Data/X/", ("m", 8, "image"), 1.234)
    assert S.mismatch(meta, "\\data\\x") == "" and "built from" in S.mismatch(meta, "/other") and "another model" in S.mismatch(meta, "/data/x", ("m", 9, "image")) and S.mismatch(None, "/x") == ""
    assert S.remember(["a"], "a") == ["a"] and len(S.remember([str(i) for i in range(200)], "x")) == 200
    assert S.name_pairs(["007=a b", "x = y", "bad", "=z"]) == {"7": "a b", "x": "y"}
    assert S.data_paths("/h")["store"] == "/h/store"
    S.log_to(str(tmp_path / "l/x.log")).info("hello")
    assert "hello" in (tmp_path / "l/x.log").read_text()


def test_sample_tree_from_end_to_end(spark, tmp_path):
    root = str(tmp_path / "tree")
    assert pictures.sample_tree(root, 3) == 24
    store = SnapshotStore(spark, str(tmp_path / "store"))
    report, _ = build_index(spark, root, store, HashEmbedder(64), IndexSettings("folder"))
    assert report.head()["written"] == 8 and {r["rep_method"] for r in store.records().collect()} == {"middle"}
    words = {r["leaf_folder"].rsplit("/", 1)[1]: r["document"] for r in store.records().collect()}
    assert "A tram stops in fresh snow (frame 1/3)" in words["tram_in_snow"]
    split = labels.label_file_split(files.texts(spark, root)).head()
    assert tuple(split) == (0, 24, 0)


def test_pictures(spark, tmp_path):
    image = np.zeros((40, 80, 3), np.uint8)
    image[10:30, 20:60] = (200, 10, 10)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bmp").write_bytes(write_bmp(image))
    (tmp_path / "in/b.bmp").write_bytes(b"no image")
    thumbs = pictures.thumbnails(spark, str(tmp_path / "in"), "*.bmp", 20)
    found = {r["path"][-5:]: r["picture"] for r in thumbs.collect()}
    assert found["b.bmp"] is None and pixels(bytes(found["a.bmp"])).shape == (10, 20, 3)
    pictures.save_pictures(thumbs, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 1
    assert pictures.data_url(write_bmp(image)).startswith("data:image/") and pictures.data_url(b"x") is None
    boxes = spark.createDataFrame([("a", 0, 3, 0.5, 0.5, 0.5, 0.5), ("a", 1, 3, 0.5, 0.5, 1.0, 1.0)], "image string, seq int, cid int, cx double, cy double, w double, h double")
    content = spark.createDataFrame([("a", bytearray(write_bmp(image)))], "image string, content binary")
    crop = pictures.class_crops(boxes, content, pad=0.0).collect()
    assert len(crop) == 1 and (pixels(bytes(crop[0]["picture"])) == (200, 10, 10)).all()
    assert tuple(pictures.viewer_rects(boxes, 80, 40).orderBy("seq").select("x1", "y1", "x2", "y2").head()) == (20, 10, 60, 30)
