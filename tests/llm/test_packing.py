import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_item_once(counts):
    c = np.zeros(61, dtype=np.int64)
    for n, k in counts.items():
        c[n] = k
    placed = np.zeros(61, dtype=np.int64)
    for way, times in packing.plan_containers(c, 60):
        assert times > 0 and sum(way) <= 60
        for x in way:
            placed[x] += times
    assert (placed == c).all()


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    for low, high in ((1, 400), (200, 900), (30, 2048)):
        c = np.bincount(rng.integers(low, high, 20_000), minlength=2049)
        total = int((c * np.arange(2049)).sum())
        used = sum(t for _, t in packing.plan_containers(c, 2048))
        assert used <= total / 2048 * (1.002 if high < 1000 else 1.06) + 1, (low, high)


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(packing.VOCABULARY):
        pytest.skip("no tokenizer")
    return packing.VOCABULARY


def test_texts(spark, vocabulary):
    texts = ["word " * n for n in (1, 5, 40, 100, 7, 7, 7)] + ["", None, "x " * 333, "같은 글 " * 20, "🙂" * 50]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "lost", "c", 1), (5, texts[5], "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id string, part int")
    got = packing.pack_texts(df, capacity=50, vocabulary=vocabulary).collect()
    size = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, vocabulary=vocabulary).collect()}
    fill = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert r["first_token"] == r["part"] * 50
    assert max(fill.values()) <= 50
    for i, n in size.items():
        parts = sorted((r["part"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        copies = 2 if i == 5 else 1
        want = [] if n is None else [(0, 0)] if n == 0 else [(p, min(50, n - 50 * p)) for p in range(-(-n // 50))]
        assert parts == sorted(want * copies), i
    assert not [r for r in got if r["doc_id"] is None]
    assert packing.pack_texts(df.limit(0), vocabulary=vocabulary).count() == 0


def test_a_length_of_many(spark, vocabulary):
    df = spark.range(2000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('a b ', 10) else repeat('c ', 1 + cast(id % 97 as int)) end as text")
    got = packing.pack_texts(df, capacity=128, vocabulary=vocabulary)
    assert got.select("doc_id").distinct().count() == got.count() == 2000
    fill = got.groupBy("container_id").sum("n_tokens").collect()
    assert max(r[1] for r in fill) <= 128 and len(fill) <= sum(r[1] for r in fill) / 128 * 1.01 + 1
    assert sorted(r[0] for r in fill) == list(range(len(fill)))
