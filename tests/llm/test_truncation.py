import random

import numpy as np

from pyspark.sql import functions as F

from tessera.llm.truncation import Wanted, contexts, describe, run_keys, texts_of_collection, tokens_of, truncated_texts, truncation_by_source
from tessera.session import read_table


def test_describe():
    assert describe("A dog runs.")[:2] == (False, False) and describe("A dog runs")[:2] == (False, True)
    assert describe("A dog ru…")[:3] == (True, True, "A dog ru") and describe("A dog runs. …")[:2] == (True, False)
    assert describe("A dog [more]")[:2] == (True, True) and describe("(frame 3/4)")[:2] == (False, False)
    assert describe("…")[1] is False and describe("  ")[1] is False


SUBJECTS = ["The guard", "A painter", "One rider", "The vendor", "A porter"]
THINGS = ["crane", "ladder", "tricycle", "hosepipe", "umbrella", "mirror", "signboard", "backpack"]
PLACES = ["mill pond", "boat shed", "salt barn", "north gate", "market hall", "quarry road"]


def corpus(n=3000):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(f"{rng.choice(SUBJECTS)} carries the {rng.choice(THINGS)} past the {rng.choice(PLACES)} while the {rng.choice(THINGS)} stays dry." for _ in range(rng.randint(1, 3)))
        source = ("long", "free", "limit", "notes", None)[i % 5]
        if source == "free" and i % 7 == 0:
            text = text[: rng.randint(20, len(text) - 2)].rstrip()
            if not text.endswith("."):
                cut.add(i)
        elif source == "limit" and len(text) > 120:
            text = text[:120]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif source == "notes":
            text = f"{rng.choice(THINGS)} by the {rng.choice(PLACES)}"
        elif source == "long" and i % 11 == 0:
            text = text[:-9] + "…"
            cut.add(i)
        rows.append((i, source, text))
    return rows, cut


def test_recall_and_precision(spark):
    rows, cut = corpus()
    extra = [(9000, "free", None), (9001, "free", ""), (9002, None, "   "), (None, "free", "A dog"), rows[0]]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + extra], "row_id long, source string, text string, field string, body string")
    got = {r["row_id"]: r["reason"] for r in truncated_texts(df, "notes", "row_id", "text", "source").collect()}
    assert len(cut & set(got)) >= 0.97 * len(cut)
    assert len(set(got) - cut) <= 0.02 * len(cut)
    assert {"copy", "prefix"} <= set(got.values())
    shares = {r["source"]: (r["n_values"], r["share"]) for r in truncation_by_source(df.withColumn("field", F.lit("notes")), truncated_texts(df, "notes", "row_id", "text", "source")).collect()}
    assert shares["notes"][1] == 0 and shares["limit"][1] > 0.3
    assert truncated_texts(df.limit(0), "notes", "row_id", "text", "source").count() == 0


def test_cuts_made_in_the_test_table(spark, data):
    """Held-out accuracy: closed captions of a source that closes them, some cut here."""
    hits = read_table(spark, data.replace("sf0.001", "sf0.01"), "folder_hits").filter("caption_source = 'vlm_base'").select("hit_id", "caption").distinct().dropDuplicates(["hit_id"]).orderBy("hit_id").collect()
    rng = random.Random(1)
    rows, cut, whole = [], set(), set()
    for r in hits:
        t = r["caption"]
        if t and t.rstrip().endswith(".") and rng.random() < 0.15:
            t = t[: rng.randint(8, max(9, len(t) - 3))].rstrip()
            (cut if not t.endswith(".") else whole).add(r["hit_id"])
        elif t and t.rstrip().endswith("."):
            whole.add(r["hit_id"])
        rows.append((r["hit_id"], "s", t))
    got = {r["row_id"] for r in truncated_texts(spark.createDataFrame(rows, "row_id long, source string, text string"), "c", "row_id", "text", "source").collect()}
    assert len(cut & got) >= 0.95 * len(cut) and not whole & got


def test_collection(spark, data):
    assert texts_of_collection(spark, data).columns == ["field", "row_id", "source", "text"]


def test_longer_copies_of_an_unpunctuated_source(spark):
    """No value is closed, the last words are rare, and some values are stored whole as well as cut."""
    rng = random.Random(7)
    rows, cut = [], set()
    for i in range(210):
        word = "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(5))
        text = f"{'wet ' * rng.randint(0, 30)}{SUBJECTS[i % 3]} carries the {word}"
        rows.append((i, text))
        if i % 7 == 0:
            rows.append((1000 + i, text[:-4]))  # within the word
            cut.add(1000 + i)
        if i % 70 == 1:
            rows.append((1000 + i, text[: -len(word) - 1]))  # after "the"
            cut.add(1000 + i)
            rows.append((2000 + i, f"{text}. {text}"))  # goes on with another sentence: whole
    df = spark.createDataFrame([(i, "manual", t) for i, t in rows], "row_id long, source string, text string")
    got = {r["row_id"]: r["reason"] for r in truncated_texts(df, "c", "row_id", "text", "source").collect() if r["reason"] != "limit"}
    assert {i: got.get(i) for i in set(got) ^ cut} == {} and set(got.values()) <= {"copy", "prefix"}


def test_copies_across_tasks_and_after_spaces(spark):
    """A value meets all its continuations, not only the next in order, wherever the tasks' ranges end."""
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = ["seen the trik", "seen the trik at dusk", "seen the trikola"] + [f"seen the trik at dusk {w}" for w in words] + [f"{'so ' * (n % 40)}{w} lies flat" for n, w in enumerate(words)]
    df = spark.createDataFrame([(i, "manual", t) for i, t in enumerate(rows)], "row_id long, source string, text string")
    got = {r["row_id"]: r["reason"] for r in truncated_texts(df, "c", "row_id", "text", "source").collect()}
    assert got.get(0) == "copy"


def test_lists_of_an_open_source(spark):
    """A list may end after any item, but not after what leads to the next one."""
    rng = random.Random(9)
    rows, cut = [], set()
    for i in range(1500):
        text = f"{', '.join(rng.choices(THINGS, k=rng.randint(2, 9)))}, {rng.choice(THINGS)} and {rng.choice(THINGS)} near the {rng.choice(PLACES)}"
        if i % 3 == 0:
            text = text.split(" and ")[0]
        elif i == 1:
            text = text[: text.index(" and ") + 4]
            cut.add(i)
        elif i in (7, 700):
            text = text[: text.index(" near the ") + 9]
            cut.add(i)
        rows.append((i, "bench", text))
    rows += [(5000 + i, "prose", f"One rider carries the {rng.choice(THINGS)} and the {rng.choice(THINGS)} near the {rng.choice(PLACES)}.") for i in range(3000)]
    got = {r["row_id"]: r["reason"] for r in truncated_texts(spark.createDataFrame(rows, "row_id long, source string, text string"), "c", "row_id", "text", "source").collect()}
    assert cut <= set(got) and {i for i, why in got.items() if why != "limit"} <= cut


def test_ends_on_rare_runs_and_at_any_size(spark):
    """Runs that go on 40 times, or 400 times and end in 1 % of them, are known to go on."""
    rng = random.Random(3)
    rows = [(i, "notes", f"{'wet ' * rng.randint(0, 20)}{rng.choice(THINGS)} by the {rng.choice(PLACES)}") for i in range(600)]
    rows += [(1000 + i, "prose", f"{'wet ' * rng.randint(0, 20)}the zebrafish swims near the {rng.choice(PLACES)}.") for i in range(40)]
    rows += [(2000 + i, "prose", f"{'wet ' * rng.randint(0, 20)}{rng.choice(THINGS)} stands upright against the {rng.choice(PLACES)}.") for i in range(400)]
    cut = {9000: "wet lantern by the zebraf", 9001: "the zebrafish swims near the"} | {9010 + i: f"{'so ' * i}stands upright against the" for i in range(4)}
    df = spark.createDataFrame(rows + [(i, "notes", t) for i, t in cut.items()], "row_id long, source string, text string")
    got = {r["row_id"]: r["reason"] for r in truncated_texts(df, "c", "row_id", "text", "source").collect() if r["reason"] != "limit"}
    assert {i: got.get(i) for i in set(got) ^ set(cut)} == {}


def test_reasons_without_a_prefix(spark):
    """Values whose words stand nowhere else: only a mark, a length or the style of the source tells."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "cut", said(30)[:100]) for i in range(40)] + [(100 + i, "cut", said(3 + i % 9)) for i in range(60)]
    rows += [(200 + i, "closed", said(8) + ".") for i in range(40)] + [(300, "closed", said(8)), (301, "other", said(6) + "…"), (302, "other", said(5))]
    got = {r["row_id"]: r["reason"] for r in truncated_texts(spark.createDataFrame(rows, "row_id long, source string, text string"), "notes", "row_id", "text", "source").collect()}
    at_limit = [got.get(i) for i in range(40)]  # a stump may begin a word that is there
    assert set(at_limit) <= {"limit", "prefix"} and at_limit.count("limit") > 20 and got[300] == "unclosed" and got[301] == "mark"
    assert not any(i in got for i in range(100, 160)) and 302 not in got


def test_contexts_count_what_is_wanted():
    texts = ["A dog runs past the gate. It stops", "A dog runs, then the gate closes."]
    keys, counts = contexts(texts)
    by_key = dict(zip(keys.tolist(), counts.T.tolist()))
    ends = {n: run_keys(tokens_of(t)) for n, t in enumerate(("the gate", "it stops", "a do"))}
    on, closed, longer, items = by_key[ends[0][1]]
    assert (on, closed) == (1, 1)
    assert ends[1][1] not in by_key  # the very end of a text that nothing closes
    assert by_key[ends[2][1]][2] == 2  # "a dog" twice goes on from "a do"
    words = np.zeros(1 << (Wanted.BITS - 6), dtype=np.uint64)
    for k in ends[0]:
        place = (k & ((1 << 64) - 1)) >> (64 - Wanted.BITS)
        words[place >> 6] |= np.uint64(1 << (place & 63))
    few, some = contexts(texts, Wanted(words))
    assert set(ends[0]) & set(by_key) <= set(few.tolist()) and all(by_key[k] == c for k, c in zip(few.tolist(), some.T.tolist()))


def test_wanted_keys(spark):
    keys = [3, -5, 2**62 + 11, -(2**63), 2**63 - 1, 0]
    wanted = Wanted.of(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert wanted(np.array(keys, dtype=np.int64).view(np.uint64)).all()
    assert not wanted(np.array([2**50, -(2**55)], dtype=np.int64).view(np.uint64)).any()
    assert Wanted.of(spark.createDataFrame([], "key long")).words.sum() == 0
