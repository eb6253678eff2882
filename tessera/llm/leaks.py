"""Evaluation texts leaking into training text, by suffix arrays over the words of each shard."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, read_table, spread

WORD = re.compile(r"[^\W_]+")
COMMENT = re.compile(r"<!--.*?-->", re.S)
# tags within a line don't end a word, all others do
INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
EMPHASIS = re.compile(r"(?<=\w)(?:\*+|~~|``?)(?=\w)")
# zero-width and formatting characters, fillers and variation selectors
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e01ef]")


def words_of(text: str) -> list[str]:
    """Words of a text: runs of letters and digits, without case, markup and invisible characters."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", COMMENT.sub(" ", text)))
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
        if "<" in text:
            text = TAG.sub(" ", INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFC", INVISIBLE.sub("", text))
    return WORD.findall(EMPHASIS.sub("", text).casefold())


def _pack(word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Word numbers from 1 of all lists in a row, a 0 after each, the start of each list, and the numbering."""
    number: dict[str, int] = {}
    flat: list[int] = []
    starts = []
    for words in word_lists:
        starts.append(len(flat))
        flat += [number.setdefault(w, len(number) + 1) for w in words]
        flat.append(0)
    return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64), number


class Items:
    """The word sequences of the test items that are searched for, and all their suffixes of enough words."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least = least
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        lists = [words_of(t) for _, t in rows]
        self.flat, starts, self.number = _pack(lists)
        self.longest = max(map(len, lists), default=0)
        at = [np.arange(s, s + len(w) - least + 1) for s, w in zip(starts, lists) if len(w) >= least]
        self.suffix = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        self.item = np.concatenate([np.full(len(w) - least + 1, i) for i, w in enumerate(lists) if len(w) >= least]) if at else self.suffix
        self.start = starts


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` of ``text`` in the order of the suffixes that begin there, by their first ``depth`` words or more.

    Prefix doubling: ranks by 2**k words give the ranks by twice as many. Suffixes that agree so far lie in
    the order of their positions. A zero ends a suffix.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-have] = rank[have:]
        ahead[text == 0] = 0
        top = int(rank.max(initial=0)) + 1
        new = np.unique(rank * top + ahead, return_inverse=True)[1].astype(np.int64)
        have *= 2
        if new.max(initial=0) + 1 == top:
            break
        rank = new
    return at[np.argsort(rank[at], kind="stable")]


def _compare(text, positions, pattern, suffixes, depth):
    """Sign of text suffix minus pattern suffix over ``depth`` words, and the number of equal words at their start."""
    n = len(positions)
    sign, equal = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int64)
    live = np.arange(n)
    for d in range(depth):
        a = text[np.minimum(positions[live] + d, len(text) - 1)]
        b = pattern[np.minimum(suffixes[live] + d, len(pattern) - 1)]
        same = (a == b) & (a != 0)
        sign[live[~same]] = np.sign(a - b)[~same]
        live = live[same]
        equal[live] += 1
        if not len(live):
            break
    return sign, equal


def _search(text, sa, pattern, suffixes, depth, right):
    """For each pattern suffix the first place in ``sa`` whose suffix isn't less (``right``: is greater) by ``depth`` words."""
    low, high = np.zeros(len(suffixes), dtype=np.int64), np.full(len(suffixes), len(sa), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        sign, _ = _compare(text, sa[mid], pattern, suffixes[open_], depth)
        up = (sign <= 0) if right else (sign < 0)
        low[open_[up]] = mid[up] + 1
        high[open_[~up]] = mid[~up]


def shard_matches(docs: list[list[str]], items: Items, chunk: int = 4_000_000):
    """Longest match of every (document, item) with one of at least ``items.least`` words: arrays doc, item, words, doc_word, item_word."""
    least, none = items.least, tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if not len(items.suffix) or not docs:
        return none
    # a word that no item has can't be part of a match: it gets one number, and no suffix near it is looked up
    unknown = len(items.number) + 1
    flat, starts = [], []
    for words in docs:
        starts.append(len(flat))
        flat += [items.number.get(w, unknown) for w in words]
        flat.append(0)
    text, starts = np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)
    bad = np.cumsum(np.append(0, (text == 0) | (text == unknown)))
    at = np.arange(max(0, len(text) - least + 1))
    at = at[bad[at + least] == bad[at]]
    if not len(at):
        return none
    # only stretches of known words take part in the sort
    keep = np.zeros(len(text) + 1, dtype=bool)
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    inside = np.cumsum(edge)[: len(text)] > 0
    keep[: len(text)] = inside
    keep[1 : len(text) + 1] |= inside  # and the word or end after each
    place = np.flatnonzero(keep[: len(text)])
    part = np.append(np.where(text[place] == unknown, 0, text[place]), 0)
    at = np.searchsorted(place, at)
    sa = suffix_array(part, at, least)
    low = _search(part, sa, items.flat, items.suffix, least, False)
    high = _search(part, sa, items.flat, items.suffix, least, True)
    found = np.flatnonzero(high > low)
    best: list[tuple] = []
    sizes = high[found] - low[found]
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + chunk, chunk), side="left") if len(found) else []
    for s, e in zip(cuts[:-1], [*cuts[1:-1], len(found)]):
        which = np.repeat(found[s:e], sizes[s:e])
        if not len(which):
            continue
        ends = np.cumsum(sizes[s:e])
        where = sa[np.arange(ends[-1]) - np.repeat(ends - sizes[s:e], sizes[s:e]) + np.repeat(low[found[s:e]], sizes[s:e])]
        _, equal = _compare(part, where, items.flat, items.suffix[which], items.longest)
        position = place[where]
        doc = np.searchsorted(starts, position, side="right") - 1
        item = items.item[which]
        best.append((doc, item, equal, position - starts[doc], items.suffix[which] - items.start[item]))
    if not best:
        return none
    doc, item, equal, word, of = (np.concatenate(x) for x in zip(*best))
    order = np.lexsort((of, word, -equal, item, doc))
    doc, item, equal, word, of = (x[order] for x in (doc, item, equal, word, of))
    first = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) if len(doc) else np.zeros(0, dtype=bool)
    return doc[first], items.ids[item[first]], equal[first], word[first], of[first]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 10, shard_words: int = 2_000_000, block_chars: int = 8_000_000) -> DataFrame:
    """Documents with at least ``least`` consecutive words of a test item: (doc_id, item_id, n_words, doc_word, item_word).

    A row for each document and item: the length of the longest stretch of words they share and where it
    begins in either, counted in words from 0; of equal stretches the first in the document, then in the item.
    Words are runs of letters and digits in any script, without case; punctuation, white space, tags, entities,
    emphasis and invisible characters don't matter.

    A suffix array is built over the words of each shard, that is of up to ``shard_words`` words of a task's
    documents; every suffix of every item is looked up in it by binary search. The items are the stated query
    set: they go to the tasks in blocks of at most ``block_chars`` characters, each a pass over the documents,
    so what a task holds doesn't grow with the number of items. (An item of more characters is a block of its own.)

    Documents with null ids, null and empty texts, and items of fewer words have no rows; neither have empty
    tables. Repeated rows give one row. Ids must be whole numbers. Other columns are ignored, whatever their names.
    """
    schema = "doc_id long, item_id long, n_words long, doc_word long, item_word long"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text <> ''")
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text <> ''").dropDuplicates()
    total = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_chars))

    def passage(members: Items):
        def run(batches):
            held: list[tuple[int, list[str]]] = []
            size = 0

            def out():
                doc, item, n, word, of = shard_matches([w for _, w in held], members)
                ids = np.array([i for i, _ in held], dtype=np.int64)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[doc], item, n, word, of)], names=["doc_id", "item_id", "n_words", "doc_word", "item_word"])

            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    words = words_of(t)
                    if len(words) >= members.least:
                        held.append((i, words))
                        size += len(words)
                    if size >= shard_words:
                        yield out()
                        held, size = [], 0
            if held:
                yield out()

        return run

    found = None
    for k in range(blocks):
        own = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        members = Items([(r["item_id"], r["text"]) for r in own.collect()], least)
        one = rows.mapInArrow(passage(members), schema)
        if blocks > 1:
            one = cut_lineage(one)  # one block of items after the other, so that the driver needn't hold all of them
        found = one if found is None else found.unionByName(one)
    rank = F.struct(F.col("n_words"), -F.col("doc_word"), -F.col("item_word"))
    return found.groupBy("doc_id", "item_id").agg(F.max(rank).alias("m")).select("doc_id", "item_id", F.col("m.n_words").alias("n_words"), (-F.col("m.col2")).alias("doc_word"), (-F.col("m.col3")).alias("item_word"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents of ``leaks``."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Documents that carry at least ten consecutive words of an evaluation item."""
    return leaked_items(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")
