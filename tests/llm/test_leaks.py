from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.leaks import leaked_items, shard_matches, suffix_array, without_leaks, words_of, Items
from tessera.session import read_table

ITEM = "Nine gramophones hang behind that mossy cloister, yet only the frayed mangle faces the glazier. 열두 개의 등불이 새장터 벽면에 걸려 있다."


def test_words():
    assert words_of("It&rsquo;s <b>wo</b>rd_one, W​O­RD **two** &amp; th**ree**") == ["it", "s", "word", "one", "word", "two", "three"]
    assert words_of("a<br>b<p>c</p>d<!-- e --> 3 < 4 > 2 &#44032;가") == ["a", "b", "c", "d", "3", "4", "2", "가가"]
    assert words_of("") == [] and words_of("...") == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_suffix_array(text, depth):
    x = np.array([*text, 0])
    sa = suffix_array(x, np.arange(len(x)), depth)

    def suffix(i):
        s = list(x[i : i + depth])
        return s[: s.index(0)] if 0 in s else s

    assert sorted(sa) == list(range(len(x)))
    assert all(suffix(a) <= suffix(b) for a, b in zip(sa, sa[1:]))


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        w = words_of(t or "")
        for i, q in items:
            v = words_of(q or "")
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=10), max_size=3), st.integers(2, 4))
def test_shards_against_brute_force(docs, items, least):
    members = Items([(i, " ".join(t)) for i, t in enumerate(items)], least)
    doc, item, n, at, of = shard_matches([list(d) for d in docs], members, chunk=7)
    assert {(int(d), int(i)): int(k) for d, i, k in zip(doc, item, n)} == brute([(i, " ".join(t)) for i, t in enumerate(docs)], [(i, " ".join(t)) for i, t in enumerate(items)], least)
    for d, i, k, a, b in zip(doc, item, n, at, of):
        assert docs[d][a : a + k] == items[i][b : b + k]


def test_table(spark):
    words = words_of(ITEM)
    cases = {
        1: ITEM.upper(),
        2: "before " + " ".join(words[3:13]) + " after",
        3: "before " + " ".join(words[3:12]) + " after",  # nine words
        4: " ".join(words[:5]) + " gap " + " ".join(words[5:12]),
        5: "<p>" + "</b> <b>".join(words[2:14]) + "</p>",
        6: "_".join(words[1:12]).replace("a", "a⁠"),
        7: None,
        8: "",
        9: "filler " * 20_000 + ITEM,
    }
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in cases.items()] + [(1, cases[1], 0, "x"), (None, ITEM, 0, "x")], "doc_id long, text string, n_words int, item_id string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short"), (9, None), (None, ITEM), (10, "")], "item_id long, text string")
    for options in ({}, {"shard_words": 10, "block_chars": 5}):
        got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["doc_word"], r["item_word"]) for r in leaked_items(docs, items, **options).collect()}
        assert got == {(1, 7): (len(words), 0, 0), (2, 7): (10, 1, 3), (5, 7): (12, 0, 2), (6, 7): (11, 0, 1), (9, 7): (len(words), 20_000, 0)}
    assert {r["doc_id"] for r in without_leaks(docs, leaked_items(docs, items)).collect()} >= {3, 4, 7, 8}
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_test_table_against_brute_force(spark, data):
    docs, items = read_table(spark, data, "documents"), read_table(spark, data, "eval_items")
    grams = defaultdict(set)
    for r in items.collect():
        w = words_of(r["text"])
        for k in range(len(w) - 9):
            grams[tuple(w[k : k + 10])].add(r["item_id"])
    wanted = set()
    for r in docs.collect():
        w = words_of(r["text"] or "")
        for k in range(len(w) - 9):
            wanted |= {(r["doc_id"], i) for i in grams.get(tuple(w[k : k + 10]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, items).collect()}
    assert got == wanted and got
