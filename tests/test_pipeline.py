import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.embedding import HashEmbedder, embed_images, image_dhash, mean_brightness, write_bmp
from tessera.operators.store import SnapshotStore
from tessera.plans import planner
from tessera.plans.build import IndexSettings, build_index, graph_edges, refresh_captions
from tessera.sources import files
from tessera.streaming.ingest import record_stream, sync_store

NAMES = {"0": "사람", "1": "오토바이"}


def tree(root):
    rng = np.random.default_rng(1)
    for folder, count in (("night street", 3), ("day/beach", 2), (".hidden", 1), ("__pycache__", 1)):
        at = root / folder
        at.mkdir(parents=True)
        for i in range(count):
            (at / f"im{i}.bmp").write_bytes(write_bmp(rng.integers(0, 255, (12, 16, 3)).astype(np.uint8)))
    (root / "night street" / "im0.txt").write_text("0 0.5 0.5 0.3 0.3\n1 0.5 0.5 0.1 0.1\n0 0.1 0.1 0.1 0.1")
    (root / "night street" / "im1.txt").write_text("A street at night")
    (root / "day/beach" / "im0.json").write_text('{"n": 5, "caption": "sea and sand"}')
    (root / "day/beach" / "im1.json").write_text('{"n": 5, "a": "x", "b": "y"}')
    (root / "day/beach" / "readme.txt").write_text("beach   notes")


def test_scan_and_sidecars(spark, tmp_path):
    tree(tmp_path)
    found = files.images(files.scan_files(spark, str(tmp_path)))
    assert {(os.path.basename(r["folder"]), r["n_images"]) for r in files.leaf_folders(found).collect()} == {("night street", 3), ("beach", 2)}
    side = files.sidecar_texts(files.texts(spark, str(tmp_path)))
    with_text = files.with_sidecar(found, side)
    assert {(os.path.basename(r["folder"]) + "/" + r["stem"], r["sidecar"]) for r in with_text.collect()} == {("night street/im0", ""), ("night street/im1", "A street at night"), ("night street/im2", ""), ("beach/im0", "sea and sand"), ("beach/im1", "x y")}
    assert {r["sidecar_text"] for r in files.folder_texts(with_text, side).collect()} == {"A street at night", "beach notes sea and sand x y"}
    assert files.dataset_profile(found).head()["images"] == 5
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bmp").load(str(tmp_path)).select(mean_brightness("content").alias("b"), image_dhash("content").alias("h"))
    assert all(r["b"] is not None and r["h"] is not None for r in content.collect())


def test_class_names():
    assert files.class_names("names:\n  - a\n  - b\n") == {"0": "a", "1": "b"}
    assert files.class_names("names:\n  0: a\n  3: b\n") == {"0": "a", "3": "b"}
    assert files.class_names("0: a\n") == {"0": "a"}
    assert files.class_names("just text") == {}


def test_incremental_build(spark, tmp_path):
    root, at = tmp_path / "tree", tmp_path / "store"
    root.mkdir()
    tree(root)
    store = SnapshotStore(spark, str(at))
    settings = IndexSettings(class_names=NAMES)
    report, bad = build_index(spark, str(root), store, HashEmbedder(32), settings)
    assert tuple(report.head()) == (5, 0, 0, 0, 5) and bad.count() == 0 and store.count() == 5
    assert store.signature == ("hash", 32, "image")
    captions = {r["caption"] for r in store.records().collect()}
    assert "Objects: 사람×2, 오토바이" in captions and "A street at night" in captions
    before = {r["id"]: r["embedding"] for r in store.records().collect()}
    report, _ = build_index(spark, str(root), store, HashEmbedder(32), settings)
    assert tuple(report.head()) == (0, 5, 0, 0, 5)
    os.remove(root / "night street" / "im2.bmp")
    (root / "day/beach" / "new.bmp").write_bytes(write_bmp(np.full((4, 4, 3), 9, np.uint8)))
    report, _ = build_index(spark, str(root), store, HashEmbedder(32), settings)
    assert tuple(report.head()) == (1, 4, 1, 0, 5)
    version = store.version
    assert refresh_captions(spark, str(root), store, {"0": "person", "1": "bike"}) == 1
    assert store.version == version + 1 and "Objects: person×2, bike" in {r["caption"] for r in store.records().collect()}
    assert all(before[r["id"]] == r["embedding"] for r in store.records().collect() if r["id"] in before)
    assert {tuple(r) for r in graph_edges(spark, str(root), NAMES).select("class").collect()} == {("사람",), ("오토바이",)}
    folders = SnapshotStore(spark, str(tmp_path / "folders"))
    report, _ = build_index(spark, str(root), folders, HashEmbedder(32), IndexSettings("folder", NAMES))
    assert report.head()["written"] == 2 and {r["member_count"] for r in folders.records().collect()} == {2, 3}
    assert refresh_captions(spark, str(root), folders, NAMES) == 0


class Flaky:
    name, dim = "flaky", 4

    def embed_image(self, paths):
        if len(paths) > 1 and any("bad" in p for p in paths):
            raise RuntimeError("batch")
        return np.stack([np.full(4, np.nan if "bad" in p else 0.5) for p in paths]).astype(np.float32)


def test_failed_rows_are_retried_alone(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "path string").coalesce(1)
    got = {r["path"]: r["embedding"] for r in embed_images(df, Flaky()).collect()}
    assert got["bad"] is None and got["a"] == got["c"] == [0.5] * 4


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.count() == 0 and store.version == 0 and store.signature is None
    rows = spark.createDataFrame([("a", [1.0], "doc", "1"), ("b", [2.0], None, None), ("b", [3.0], "later", "2"), (None, [1.0], "", "")], "id string, embedding array<float>, document string, mtime string")
    store.upsert(rows)
    store.upsert(rows.limit(0))
    assert store.version == 1 and {(r["id"], r["document"]) for r in store.all_documents().collect()} == {("a", "doc"), ("b", "later")}
    reader = store.records()
    store.update_meta(spark.createDataFrame([("a", "cap"), ("zz", "cap")], "id string, caption string"))
    store.delete(spark.createDataFrame([("b",), ("zz",)], "id string"))
    assert {(r["id"], r["caption"], r["embedding"][0]) for r in store.records().collect()} == {("a", "cap", 1.0)}
    assert reader.count() == 2  # goes on reading its snapshot
    assert [r["id"] for r in store.fetch(spark.createDataFrame([("a",), ("q",)], "id string")).collect()] == ["a"]
    store.clear()
    store.vacuum()
    assert store.count() == 0 and store.version == 4
    assert SnapshotStore(spark, str(tmp_path / "s")).version == 4


def written(root):
    return {p: sum(f.stat().st_size for f in (root / p).iterdir()) for p in os.listdir(root) if not p.startswith((".", "manifest"))}


def test_changes_write_what_changes(spark, tmp_path):
    at = tmp_path / "s"
    store = SnapshotStore(spark, str(at))
    big = spark.range(4000).select(F.col("id").cast("string"), F.array([F.rand(n).cast("float") for n in range(64)]).alias("embedding"), F.lit("1").alias("mtime"))
    assert store.upsert(big) and store.version == 1
    before = written(at)
    assert store.upsert(spark.createDataFrame([("7", "new"), ("x", "added")], "id string, caption string")) and store.delete(spark.createDataFrame([("8",), ("zz",)], "id string"))
    new = {p: n for p, n in written(at).items() if p not in before}
    assert all(p.startswith("layer") for p in new) and sum(new.values()) < 0.05 * sum(before.values())
    assert store.version == 3 and store.count() == 4000
    assert {r["id"]: r["caption"] for r in store.records().filter("id in ('7', '8', '9', 'x')").collect()} == {"7": "new", "9": None, "x": "added"}
    # nothing changes: no version
    assert not store.delete(spark.createDataFrame([("8",), ("zz",)], "id string")) and not store.update_meta(spark.createDataFrame([("zz", "c")], "id string, caption string")) and not store.upsert(big.limit(0))
    assert store.version == 3
    for n in range(20):
        store.upsert(spark.createDataFrame([(f"y{n}", "z")], "id string, caption string"))
    assert store.count() == 4020 and len(store._manifest()["layers"]) <= store.MANY
    store.vacuum()
    assert store.count() == 4020 and len([n for n in os.listdir(at) if n.startswith("manifest")]) == 1


def test_a_crash_between_any_steps_loses_nothing(spark, tmp_path, monkeypatch):
    at = tmp_path / "s"
    store = SnapshotStore(spark, str(at))
    store.upsert(spark.createDataFrame([("a", "1"), ("b", "1")], "id string, mtime string"))
    monkeypatch.setattr(SnapshotStore, "_publish", lambda self, m: 1 / 0)  # after the data, before the manifest
    with pytest.raises(ZeroDivisionError):
        store.upsert(spark.createDataFrame([("c", "1")], "id string, mtime string"))
    monkeypatch.undo()
    assert store.version == 1 and store.count() == 2
    (at / "manifest-0000000002.json").write_text('{"version": 2, "ba')  # half a file
    assert store.version == 1 and store.count() == 2
    with pytest.raises(RuntimeError):
        store.delete(spark.createDataFrame([("a",)], "id string"))  # another writer took the number
    os.remove(at / "manifest-0000000002.json")
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in SnapshotStore(spark, str(at)).records().collect()] == ["b"]


def test_stream_into_store(spark, tmp_path):
    source, store = tmp_path / "in", SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, document string")
    rows.write.parquet(str(source))
    run = lambda: sync_store(record_stream(spark, str(source), rows.schema), store, str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([("b", "new")], "id string, document string").write.mode("append").parquet(str(source))
    run()
    assert {(r["id"], r["document"]) for r in store.all_documents().collect()} == {("a", "one"), ("b", "new")}


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("0.5000", "a, b", "/x/1.jpg", "/x", 2)], "score string, caption string, image_path string, folder string, member_count int")
    assert files.export_csv(rows, str(tmp_path / "out.csv")) == 1
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfscore,caption,image_path,folder,member_count")
    assert files.path_list(rows) == "/x/1.jpg"


def test_planner():
    plan = planner.rule_plan("오토바이 없는 사람 사진, without car", ["사람", "오토바이", "car", "dog"])
    assert plan.required == ["사람"] and plan.excluded == ["오토바이", "car"]
    assert planner.read_plan('```json\n{"semantic": "x"}\n```') == {"semantic": "x"} and planner.read_plan("[1]") == {} and planner.read_plan("{bad}") == {}
    model = lambda q, n: {"semantic": "s", "required_objects": ["car", "ghost"], "excluded_objects": ["car"]}
    assert planner.make_plan("q", ["car"], model) == planner.Plan("s", ["car"], ["car"])
    assert planner.make_plan("car", ["car"], lambda q, n: 1 / 0).required == ["car"]
    assert planner.make_plan("car", ["car"], lambda q, n: {"semantic": " "}).required == ["car"]
    assert planner.refine("q", lambda q: " ") == "q" and planner.refine("q", lambda q: 1 / 0) == "q"
    assert planner.summarize("q", []) .startswith("No images") and planner.summarize("q", [], enabled=False) == ""
    assert planner.summarize("q", [{"folder": "/a/b/", "caption": "c"}]) == "Found 1 matching folders for 'q'. Most similar: b. Top caption: c"
    assert planner.effective_k(0) == 24 and planner.effective_mode("x") == "vector" and planner.graph_filter(0, 5) == "skip"


def test_rule_caption(spark):
    from tessera.functions.embedding import rule_caption

    df = spark.createDataFrame([("/d/night/fire.jpg", 30.0, " a  note "), ("/d/x/y.jpg", None, None)], "p string, b double, c string")
    assert [r[0] for r in df.select(rule_caption(F.col("p"), F.col("b"), F.col("c"))).collect()] == ["dark (night) photo — night, fire (folder: night). note: a note", "unknown-lighting photo (folder: x)"]
