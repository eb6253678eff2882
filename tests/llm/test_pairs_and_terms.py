from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.pairs import cooccurring_items
from tessera.llm.terms import caption_terms, count_terms, term_frequencies
from tests.oracle import check, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    check(queries.QUERIES[name](spark, data), connect(data), queries.SQL[name])


def baskets(seed=0, n=3000, hot=0):
    rng = np.random.default_rng(seed)
    items = [f"h{i}" for i in range(8)] + [f"r{i}" for i in range(300)]
    p = np.array([6.0] * 8 + [1 / (i + 3) for i in range(300)])
    rows = [(f"b{rng.integers(n // 2)}", [str(x) for x in rng.choice(items, rng.integers(0, 7), p=p / p.sum())]) for _ in range(n)]
    rows += [("hot", [items[i % 308], items[(i * 7) % 308]]) for i in range(hot)]
    return rows + [(None, ["h0", "h1"]), ("b1", None), ("only", [None, "h0"]), ("bare", []), ("b2", ["", "h0"])]


def expected(rows):
    by = defaultdict(set)
    for b, items in rows:
        if b is not None:
            by[b] |= {x for x in items or [] if x is not None}
    single, pair = Counter(), Counter()
    for s in by.values():
        single.update(s)
        pair.update(combinations(sorted(s), 2))
    return {(a, b): (n, single[a], single[b], len(by)) for (a, b), n in pair.items()}


@pytest.mark.parametrize("options", [{}, {"flush": 50}, {"density": 0.2}, {"density": 2.0}, {"density": 0.0, "max_heavy": 5}, {"max_heavy": 0}])
def test_pairs_against_brute_force(spark, options):
    rows = baskets(hot=1500)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "basket string, items array<string>, rec string, a int")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_records"]) for r in cooccurring_items(df, "basket", "items", **options).collect()}
    assert got == expected(rows)


def test_pairs_by_lift(spark):
    rows = baskets(3)
    df = spark.createDataFrame(rows, "basket string, items array<string>")
    got = cooccurring_items(df, "basket", "items", min_count=3, min_lift=1.5).collect()
    assert {(r["item_a"], r["item_b"]) for r in got} == {k for k, (n, a, b, N) in expected(rows).items() if n >= 3 and n * N >= 1.5 * a * b}
    assert all(abs(r["lift"] - r["n_ab"] * r["n_records"] / (r["n_a"] * r["n_b"])) < 1e-9 for r in got)
    assert cooccurring_items(df.limit(0), "basket", "items").count() == 0
    assert cooccurring_items(df.filter("basket is null"), "basket", "items").count() == 0


@pytest.mark.parametrize("options", [{}, {"flush": 40, "buckets": 1}, {"flush": 40, "buckets": 256}])
def test_terms_against_brute_force(spark, options):
    rows = baskets(5) + [("b3", ["h0", "h0", "h5"])] * 20
    df = spark.createDataFrame([(*r, "x") for r in rows], "basket string, items array<string>, field string")
    words = spark.createDataFrame([(1, "Red car, RED"), (1, "Red car, RED"), (2, None), (3, "차 car2"), (None, "lost")], "id long, text string")
    from pyspark.sql import functions as F

    got = {(r["field"], r["term"]): (r["uses"], r["records"], r["n_records"], r["mark"]) for r in count_terms(term_frequencies(df, "basket", "items", "items"), term_frequencies(words, "id", caption_terms(F.col("text")), "words"), **options).collect()}
    uses, records, ids = Counter(), defaultdict(set), set()
    for b, items in {(b, tuple(i or ())) for b, i in rows}:
        if b is None:
            continue
        ids.add(b)
        for x in items:
            if x is not None:
                uses[x] += 1
                records[x].add(b)
    mark = lambda n: "rare" if n < 3 else "common" if 5 * n > len(ids) else None
    assert {t: v for (f, t), v in got.items() if f == "items"} == {x: (uses[x], len(records[x]), len(ids), mark(len(records[x]))) for x in uses}
    assert {t: v for (f, t), v in got.items() if f == "words"} == {"red": (2, 1, 3, "rare"), "car": (1, 1, 3, "rare"), "차": (1, 1, 3, "rare"), "car2": (1, 1, 3, "rare")}
    assert count_terms(term_frequencies(df.limit(0), "basket", "items")).count() == 0
