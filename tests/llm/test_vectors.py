import math

import numpy as np
import pytest

from tessera.llm.vectors import hilbert_keys, p1_found, similar_vectors
from tessera.session import read_table


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * d), axis=-1).reshape(-1, d)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(2 ** (bits * d)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "image string, vec array<float>, seen int, curve string, key string, id string")


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("block", [64, 1536])
def test_recall_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((150, 16))
    x = np.repeat(centers, 8, axis=0) + 0.25 * rng.standard_normal((1200, 16))
    df = frame(spark, [(f"i{i:04d}", [float(v) for v in r], 1, "c", "k", "other") for i, r in enumerate(x)])
    got = similar_vectors(df, "image", "vec", k=5, dim=16, axes=8, block=block, version_col="seen").collect()
    near, s = exact(x, 5)
    found = {(int(r["id"][1:]), int(r["neighbor"][1:])) for r in got}
    wanted = {(i, int(j)) for i in range(len(x)) for j in near[i]}
    assert len(found & wanted) >= 0.9 * len(wanted)
    for r in got:
        assert abs(r["similarity"] - s[int(r["id"][1:]), int(r["neighbor"][1:])]) < 1e-3
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["similarity"]))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by.values())


def test_odd_rows(spark):
    good = [1.0] + [0.0] * 15
    rows = [
        ("a", good, 1, None, None, None),
        ("a", [0.0] * 15 + [1.0], 0, None, None, None),  # an older row of the same image
        ("a", good, 1, None, None, None),
        ("b", [5.0] + [0.0] * 15, 1, None, None, None),
        ("c", [1.0, 0.1] + [0.0] * 14, None, None, None, None),
        ("n", None, 1, None, None, None),
        ("e", [], 1, None, None, None),
        ("s", [1.0], 1, None, None, None),
        ("z", [0.0] * 16, 1, None, None, None),
        ("x", [math.nan] + good[1:], 1, None, None, None),
        ("y", [math.inf] + good[1:], 1, None, None, None),
        ("w", [None] + good[1:], 1, None, None, None),
        (None, good, 1, None, None, None),
    ]
    got = {(r["id"], r["neighbor"], r["rank"]) for r in similar_vectors(frame(spark, rows), "image", "vec", k=2, dim=16, axes=8, version_col="seen").collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)}
    assert similar_vectors(frame(spark, rows).limit(0), "image", "vec", dim=16).count() == 0
    assert similar_vectors(frame(spark, rows[:1]), "image", "vec", dim=16).count() == 0


def test_a_group_of_copies(spark):
    same = [1.0] * 16
    rows = [(f"i{i:03d}", same, 1, None, None, None) for i in range(400)] + [(f"o{i}", [float((i >> b) & 1) - 0.5 for b in range(16)], 1, None, None, None) for i in range(50)]
    got = similar_vectors(frame(spark, rows), "image", "vec", k=4, dim=16, axes=8, block=64, min_similarity=0.9).collect()
    n = {}
    for r in got:
        n[r["id"]] = n.get(r["id"], 0) + 1
    assert all(n[f"i{i:03d}"] == 4 for i in range(400))


def test_pairs_of_the_test_table(spark, data):
    rows = read_table(spark, data, "store_rows").select("representative_image", "embedding").collect()
    vec = {r[0]: np.array(r[1], dtype=float) for r in rows if r[1] and len(r[1]) == 64 and np.isfinite(np.array(r[1], dtype=float)).all() and any(r[1])}
    ids = sorted(vec)
    near, s = exact(np.stack([vec[i] for i in ids]), 10)
    wanted = {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in near[i] if s[i, j] >= 0.92}
    assert {tuple(r) for r in p1_found(spark, data).collect()} == wanted


def test_no_link_is_lost_between_partitions(spark, data):
    """The pairs don't hang on the number of partitions, nor does recall with partitions of few blocks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((300, 16)), 8, axis=0) + 0.25 * rng.standard_normal((2400, 16))
    df = frame(spark, [(f"i{i:04d}", [float(v) for v in r], 1, "c", "k", "o") for i, r in enumerate(x)])
    near, _ = exact(x, 5)
    wanted = {(i, int(j)) for i in range(len(x)) for j in near[i]}
    pairs, recall = [], []
    try:
        for n in (1, 4, 64, 200, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pairs.append({tuple(r) for r in p1_found(spark, data).collect()})
            if n in (1, 64):
                got = similar_vectors(df, "image", "vec", k=5, dim=16, axes=8, curves=4, block=64).collect()
                recall.append(len({(int(r["id"][1:]), int(r["neighbor"][1:])) for r in got} & wanted) / len(wanted))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(p == pairs[0] for p in pairs)
    assert recall[1] >= recall[0] - 0.01, recall
