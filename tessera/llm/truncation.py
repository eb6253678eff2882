"""Texts that lost their end, by joining their ends with the prefixes of longer texts."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encoding import KEYS, restorations, text_keys
from tessera.session import cut_lineage, read_table, task_count

# marks that stand in for a lost end
MARK = re.compile(r"\s*(?:…|‥|\.{3,}|(?<![.\w])\.\.|[\[(<](?:more|cont|contd|continued|truncated|cut|cut off|snip|\.\.\.|…|계속|더보기|생략)[^\])>]{0,12}[\])>]?)\s*$", re.I)
CLOSED = re.compile(r"(?:[.!?。！？؟।][\"”’»›」』)\]'*_`]*|[)\]」』>}])$")
TOKEN = re.compile(r"[^\W_]+(?:[’'.:/_-][^\W_]+)*|[^\w\s]|_")
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”’»」』)]*\s+|(?<=[。！？])|\n+")
STOP = ".!?。！？"
COMMAS = frozenset(",;、，")
GO_ON = re.compile(r"[ \t]*(?:[,;:、，&/+–—-]|[^\W_]|[(\[«“‘\"'「『]\w)")  # more of the same sentence
GRAMS = 6
START = "^"  # stands before the first token of a sentence


@functools.lru_cache(maxsize=200_000)
def _token(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "0" if word.isdigit() else "0a"
    return word.lower()


def tokens_of(sentence: str) -> list[str]:
    """Lower-case words and signs; numbers and codes are alike whatever their digits."""
    return list(map(_token, TOKEN.findall(sentence)))


@functools.lru_cache(maxsize=200_000)
def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


@functools.lru_cache(maxsize=50_000)
def stems(token: str) -> np.ndarray:
    """The hashes of all beginnings of a word."""
    return np.array([xxhash.xxh3_64_intdigest(token[:e]) for e in range(1, len(token))], dtype=np.uint64)


BASE, STEP, WORD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (1 << 64) - 1


def run_keys(tokens: list[str]) -> list[int]:
    """Keys of the runs of the last 1, 2, ... tokens: polynomials of the token hashes, so that tasks can compute them in bulk."""
    keys, key, power = [], 0, 1
    for n, token in enumerate(reversed(tokens), 1):
        key = (key + token_hash(token) * power) & WORD
        power = power * BASE & WORD
        keys.append(_signed(key + n * STEP))
    return keys


def _signed(key: int) -> int:
    key &= WORD
    return key - (1 << 64) if key >> 63 else key


def describe(text: str) -> tuple[bool, bool, str, list[str]]:
    """(has a mark for its end, is open, the text without the mark, its last tokens).

    Open is a text whose last sentence isn't closed by punctuation, a bracket or the like.
    """
    m = MARK.search(text)
    body = (text[: m.start()] if m else text).rstrip()
    if not body:
        return bool(m), False, body, []
    lost = body[-1] == "�"
    open_ = lost or not CLOSED.search(body)
    last = [START, *tokens_of(SENTENCE.split(body)[-1].rstrip("�"))]
    return bool(m), open_, body, last[-GRAMS:] if len(last) > 1 else []


def body_key(body: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(body.encode("utf-8", "replace")))


def beginnings(text: str) -> list[int]:
    """The keys of all beginnings of a text, the empty one first and the text itself left out."""
    hasher, keys = xxhash.xxh3_64(), []
    for c in text:
        keys.append(_signed(hasher.intdigest()))
        hasher.update(c.encode("utf-8", "replace"))
    return keys


def common(a: str, b: str, most: int) -> int:
    """How many characters two texts begin alike with, ``most`` at the most."""
    most = min(most, len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 1:
        mid = (low + most) // 2
        low, most = (mid, most) if a[:mid] == b[:mid] else (low, mid)
    return low


def goes_on_with(text: str, end: int) -> str | None:
    """How a text goes on after its first ``end`` characters: within the word, within the phrase, or not within the sentence (None)."""
    if not 0 < end < len(text):
        return None
    if text[end].isalnum():
        return "word"
    m = GO_ON.match(text, end)
    return "phrase" if m else None


class Wanted:
    """A set of keys as a bit for each value of their first ``BITS`` bits: what isn't wanted mostly isn't in it, whatever is wanted is.

    It has a fixed size, so every task can have it; the join that follows leaves only what is wanted.
    """

    BITS = 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> "Wanted":
        """From the column ``key``; at most 2**BITS / 64 numbers come to the driver."""
        place = F.shiftrightunsigned("key", 64 - cls.BITS)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - cls.BITS}) & 63 as int))")
        rows = keys.select(F.shiftrightunsigned(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(1 << (cls.BITS - 6), dtype=np.uint64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which of some unsigned keys may be wanted."""
        place = keys >> np.uint64(64 - self.BITS)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def contexts(bodies: list[str], wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of 1 to GRAMS tokens of some texts, and how often each goes on, ends closed, is cut short of a longer word, or goes on after a comma (which counts as going on, too).

    The very end of a text that nothing closes counts for nothing. Only ``wanted`` keys are counted.
    """
    number: dict[str, int] = {}
    flat: list[int] = []
    place: list[int] = []  # of a token in its sentence, the mark of its start being 0
    kind: list[int] = []  # 0 goes on, 1 ends closed, 2 longer, 3 goes on after a comma, 4 doesn't count
    for body in bodies:
        parts = SENTENCE.split(body)
        for k, sentence in enumerate(parts):
            words = tokens_of(sentence)
            if not words:
                continue
            closed = words[-1] in STOP or k < len(parts) - 1 or bool(CLOSED.search(sentence.rstrip()))
            if words[-1] in STOP:
                words.pop()
            if not words:
                continue
            flat.append(number.setdefault(START, len(number)))
            flat += [number.setdefault(w, len(number)) for w in words]
            place += range(len(words) + 1)
            kind += [4] + [3 if w in COMMAS else 0 for w in words[1:]] + [1 if closed else 4]
    if not flat:
        return np.zeros(0, dtype=np.int64), np.zeros((4, 0), dtype=np.int64)
    names = list(number)
    hashes = np.array([token_hash(w) for w in names], dtype=np.uint64)
    ids, place, kind = np.array(flat), np.array(place), np.array(kind)
    each = hashes[ids]
    keys, kinds, weights = [], [], []

    def add(key, kind_, weight):
        if wanted is not None:
            at = wanted(key)
            key, kind_, weight = key[at], kind_[at], weight[at]
        keys.append(key)
        kinds.append(kind_)
        weights.append(weight)

    with np.errstate(over="ignore"):
        run, power = each.copy(), np.uint64(1)
        for n in range(1, GRAMS + 1):
            at = (kind != 4) & (place >= n - 1)
            add((run + np.uint64(n * STEP & WORD))[at], kind[at], np.ones(int(at.sum()), dtype=np.int64))
            power = np.uint64(int(power) * BASE & WORD)
            run[n:] += each[:-n] * power
        # words that are whole somewhere, alone and after the word before, stand for all their beginnings
        whole = np.flatnonzero(kind != 4)
        pairs, times = np.unique(ids[whole - 1] * len(names) + ids[whole], return_counts=True)
        before, word = pairs // len(names), pairs % len(names)
        parts_ = [stems(w) for w in names]
        lengths = np.array([len(x) for x in parts_])
        starts = np.cumsum(lengths) - lengths
        begun = np.concatenate(parts_)
        count = lengths[word]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(starts[word], count)
        second = hashes[before] * np.uint64(BASE) + np.uint64(2 * STEP & WORD)
        add(begun[at] + np.repeat(second, count), np.full(len(at), 2), np.repeat(times, count))
        alone = np.bincount(word, times, len(names)).astype(np.int64)
        add(begun + np.uint64(STEP), np.full(len(begun), 2), np.repeat(alone, lengths))
    keys, kinds, weights = np.concatenate(keys).view(np.int64), np.concatenate(kinds), np.concatenate(weights)
    found, where = np.unique(keys, return_inverse=True)
    counts = np.bincount(where * 4 + kinds, weights, len(found) * 4).astype(np.int64).reshape(-1, 4).T
    some = counts.sum(axis=0) > 0
    found, counts = found[some], counts[:, some]
    counts[0] += counts[3]  # what goes on after a comma goes on
    return found, counts


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table to join with, sent to every task if it has few rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Followed:
    """Beginnings among sorted texts, and how they go on elsewhere: rows (body_key, next).

    A beginning comes before all that goes on from it. Beginnings that lie with an earlier task are those of this
    task's first text, as far as other texts share them.
    """

    def __init__(self):
        self.first: str | None = None
        self.shared, self.begins = 0, []
        self.said: set[tuple[int, str]] = set()  # of the first text's beginnings, by their length
        self.open_values: list[tuple[str, set[str]]] = []  # those that the last text goes on from, or is

    def add(self, text: str, out: list) -> bool:
        """Takes the next text; whether it differs from the one before."""
        if self.first is None:
            self.first, self.shared, self.begins = text, len(text), beginnings(text)
            out += [(key, kind) for n, key in enumerate(self.begins) if (kind := goes_on_with(text, n))]
        else:
            self.shared = shared = common(self.first, text, self.shared)
            if shared < len(self.first) and (kind := goes_on_with(text, shared)) and (shared, kind) not in self.said:
                self.said.add((shared, kind))
                out.append((self.begins[shared], kind))
        while self.open_values and not text.startswith(self.open_values[-1][0]):
            self.open_values.pop()
        for value, kinds in self.open_values:
            if (kind := goes_on_with(text, len(value))) and kind not in kinds:
                kinds.add(kind)
                out.append((body_key(value), kind))
        if self.open_values and self.open_values[-1][0] == text:
            return False
        self.open_values.append((text, set()))
        return True


def truncated_texts(df: DataFrame, field: str | Column, id_col: str, text_col: str, source_col: str, usual: float = 0.3, sample: int = 20_000) -> DataFrame:
    """Values whose end was lost: (field, row_id, source, reason).

    ``df`` has a row for each value. A value is open if nothing closes its last sentence. Open values are cases
    with the first of these reasons that holds:

    - ``copy``: the value is a strict prefix of a longer value, which goes on within the word, or goes on within the
      sentence after tokens that seldom end anything; that holds for every source, punctuated or not;
    - ``prefix``: its last tokens are a prefix of what stands elsewhere, where they are followed by more, or by
      the rest of the word, and hardly ever end a sentence. In sources whose values usually are closed (less than
      ``usual`` are open), that they don't mostly end there is enough; in the others, an item of a list (a word that
      commas or ends follow often, with a comma shortly before) is an end;
    - ``limit``: many open values of the source have just this length, in characters or in bytes, and few a length near it;
    - ``mark``: a sign such as an ellipsis stands in for the end;
    - ``unclosed``: nothing is known of its last tokens, but its source usually closes its values.

    A value that stops at the end of a sentence is none, nor one whose last tokens mostly end a sentence or an
    open value. All values are sorted, where a prefix is followed by all its continuations; in the same pass the runs
    of up to six tokens that end some open value are counted wherever they stand, and joined by hash. Values read in a
    wrong encoding are repaired first (see :mod:`tessera.llm.encoding`, which ``sample`` is for). Numbers are alike.

    Null ids, null, empty and blank values have no rows; values without source count as one source. Repeated
    rows give one row. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    name = F.lit(field) if isinstance(field, str) else field
    rows = df.select(name.alias("field"), F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    rows = rows.filter("row_id is not null and text <> ''").dropDuplicates()
    repaired = cut_lineage(restorations(rows, "text", sample).select(*KEYS, "original"))
    chars = repaired.agg(F.coalesce(F.sum(F.length("original") + 16), F.lit(0))).head()[0]
    repaired = F.broadcast(repaired) if chars <= 8_000_000 else repaired
    fixed = rows.select("*", *text_keys(F.col("text"))).join(repaired, list(KEYS), "left").withColumn("text", F.coalesce("original", "text"))

    def prepare(batches):
        seen: dict[int, None] = {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                mark, open_, body, last = describe(text)
                key = body_key(body)
                fresh = key not in seen
                seen[key] = None
                if len(seen) > 200_000:
                    seen = {}
                out.append((mark, open_, body if fresh else None, run_keys(last) if open_ else [], not COMMAS.isdisjoint(last[-4:-1]), key))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("field", "source", "row_id", "chars", "bytes", "wide")), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["field", "source", "row_id", "chars", "bytes", "wide", "mark", "open", "body", "keys", "listed", "body_key"],
            )

    # a body is there once for the values of a task that share it
    sized = fixed.select("field", "source", "row_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.right("text", F.lit(12)).rlike("[^\\x00-\\x7f]").alias("wide"), "text")
    values = cut_lineage(sized.mapInArrow(prepare, "field string, source string, row_id long, chars long, bytes long, wide boolean, mark boolean, open boolean, body string, keys array<long>, listed boolean, body_key long"))
    bodies = values.select("body").filter("body <> ''")
    values = values.drop("body").withColumn("src", F.coalesce("source", F.lit("")))
    open_values = values.filter("open")
    plain = open_values.filter("not mark")

    # lengths at which many open values end
    def limits(unit: str) -> DataFrame:
        at = Window.partitionBy("field", "src").orderBy(unit)
        around = F.greatest(F.coalesce(F.max("n").over(at.rangeBetween(1, 6)), F.lit(0)), F.coalesce(F.max("n").over(at.rangeBetween(-10, -4)), F.lit(0)))
        return plain.groupBy("field", "src", unit).agg(F.count("*").alias("n")).withColumn("around", around).filter("n >= 5 and n >= 4 * (around + 1)").select("field", "src", F.col(unit).alias("size"), F.lit(unit).alias("unit"))

    limit = _small(limits("chars").unionByName(limits("bytes")))
    # a cut amid the bytes of a character leaves one to three bytes less
    reach = F.when(F.col("wide"), F.array(*[F.struct((F.col("bytes") + k).alias("size"), F.lit("bytes").alias("unit")) for k in range(4)])).otherwise(F.array(F.struct(F.col("bytes").alias("size"), F.lit("bytes").alias("unit"))))
    sizes = plain.select("field", "src", "row_id", F.explode(F.concat(reach, F.array(F.struct(F.col("chars").alias("size"), F.lit("chars").alias("unit"))))).alias("s")).select("field", "src", "row_id", "s.size", "s.unit")
    at_limit = sizes.join(limit, ["field", "src", "size", "unit"]).select("field", "row_id").distinct().withColumn("at_limit", F.lit(True))
    # a row for each open value, with what is known of its source
    opened = open_values.join(at_limit, ["field", "row_id"], "left").select("field", "source", "src", "row_id", "mark", "keys", "listed", "body_key", F.col("at_limit").isNotNull().alias("at_limit"))
    opened = cut_lineage(opened)
    style = values.groupBy("field", "src").agg(F.count("*").alias("n_all"))
    style = opened.filter("not mark and not at_limit").groupBy("field", "src").agg(F.count("*").alias("n_open")).join(style, ["field", "src"]).select("field", "src", (F.col("n_open") / F.col("n_all")).alias("open_share"))

    # the runs of tokens at the ends of open values, each end once
    ends = opened.groupBy("body_key").agg(F.max(F.col("mark") | F.col("at_limit")).alias("lost"), F.first("keys").alias("keys"))
    ends = ends.select("lost", F.explode("keys").alias("key")).groupBy("key").agg(F.sum(F.when(F.col("lost"), 0).otherwise(1)).alias("ends"))
    ends = cut_lineage(ends)
    wanted = Wanted.of(ends)

    # values that go on elsewhere, and what follows the runs everywhere: one pass over the sorted bodies
    def follow(batches):
        followed = Followed()
        for b in batches:
            out: list[tuple[int, str]] = []
            own = [text for text in b.column("body").to_pylist() if followed.add(text, out)]
            keys, numbers = contexts(own, wanted)
            n, m = len(out), len(keys)
            key = pa.array(np.concatenate([np.array([o[0] for o in out], dtype=np.int64), keys]))
            more = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in numbers]
            yield pa.RecordBatch.from_arrays([key, pa.array([o[1] for o in out] + [None] * m, pa.string()), *more], names=["key", "next", "on", "closed", "longer", "items"])

    ordered = bodies.repartitionByRange(task_count(spark), "body").sortWithinPartitions("body").mapInArrow(follow, "key long, next string, on long, closed long, longer long, items long")
    sums = [F.sum(c).alias(c) for c in ("on", "closed", "longer", "items")]
    # (a copy's key and that of a run are apart: next is null for runs only)
    seen = cut_lineage(ordered.groupBy("key", F.col("next").isNotNull().alias("is_copy")).agg(F.max(F.col("next") == "word").alias("in_word"), F.max(F.col("next") == "phrase").alias("in_phrase"), *sums))
    copies = seen.filter("is_copy").select(F.col("key").alias("body_key"), "in_word", "in_phrase")
    counts = ends.join(seen.filter("not is_copy").drop("is_copy", "in_word", "in_phrase"), "key", "left").na.fill(0)
    stats = opened.select("field", "row_id", F.posexplode("keys").alias("n", "key")).join(counts, "key").filter("on + closed + longer + ends > 1")
    stats = stats.groupBy("field", "row_id").agg(F.array_sort(F.collect_list(F.struct("n", "on", "closed", F.greatest(F.col("ends") - 1, F.lit(0)).alias("ends"), "longer", "items"))).alias("runs"))

    # the longest run that is known elsewhere decides whether the end is a usual one
    def total(r: Column) -> Column:
        return r["on"] + r["closed"] + r["ends"] + r["longer"]

    def most_ends(r: Column) -> Column:
        """Upper bound (Wilson's, 95 %) of the share of a run's occurrences that end a sentence or a value."""
        n, x, z = F.greatest(total(r), F.lit(1)), r["closed"] + r["ends"], 1.645
        share = x / n
        return (share + z * z / (2 * n) + z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    known = F.try_element_at(F.filter("runs", lambda r: total(r) >= 3), F.lit(-1))
    # the last token is no word by itself, and after the word before it stands a longer one
    stump = F.exists("runs", lambda r: (r["n"] == 0) & (r["longer"] >= 0.9 * total(r)))
    part = stump & F.exists("runs", lambda r: (r["n"] == 1) & (r["longer"] >= 10 * (r["on"] + r["closed"] + r["ends"]) + 3))
    complete = F.coalesce(((F.col("known.closed") + F.col("known.ends")) >= 0.5 * total(F.col("known"))) & ~part, F.lit(False))
    goes_on = F.exists("runs", lambda r: (most_ends(r) <= 0.1) & ((r["n"] >= 2) | ((r["n"] == 0) & (r["longer"] >= 0.9 * total(r)))))
    # with a copy that goes on after the word, some run must seldom end
    seldom = F.coalesce(F.exists("runs", lambda r: most_ends(r) <= F.when(r["n"] >= 2, 0.1).otherwise(0.02)), F.lit(False))
    # a list may end after any of its items: after words that commas or ends follow often
    item = F.col("listed") & ~F.coalesce(stump, F.lit(False)) & F.exists("runs", lambda r: (r["n"] == 0) & (r["items"] + r["closed"] + r["ends"] >= 0.1 * total(r)))
    item = F.coalesce(item, F.lit(False))
    never = F.coalesce(goes_on, F.lit(False)) & ~complete & ~item
    judged = opened.select("field", "source", "src", "row_id", "mark", "at_limit", "listed", "body_key").join(stats, ["field", "row_id"], "left").join(_small(style), ["field", "src"], "left").join(copies, "body_key", "left").withColumn("known", known)
    usually_closed = F.coalesce("open_share", F.lit(0.0)) < usual
    reason = (
        F.when(F.col("in_word") & ~complete, "copy")
        .when(F.col("in_phrase") & seldom & ~complete & ~item, "copy")
        .when(never | (usually_closed & ~complete & F.col("known").isNotNull()), "prefix")
        .when(F.col("at_limit"), "limit")
        .when(F.col("mark"), "mark")
        .when(usually_closed & ~complete, "unclosed")
    )
    found = judged.withColumn("reason", reason).filter("reason is not null").select("field", "row_id", "source", "reason")
    # a value that was read twice, in two ways, is one value
    return found.groupBy("field", "row_id").agg(F.min_by(F.struct("source", "reason"), F.struct("reason", "source")).alias("s")).select("field", "row_id", "s.source", "s.reason")


def texts_of_collection(spark, sf_dir: str) -> DataFrame:
    """The sidecar texts of the folders and the captions of the hits, a row for each value: (field, row_id, source, text)."""
    folders = read_table(spark, sf_dir, "leaf_folders").select(F.lit("sidecar_text").alias("field"), F.col("folder_id").alias("row_id"), F.col("sidecar_source").alias("source"), F.col("sidecar_text").alias("text"))
    hits = read_table(spark, sf_dir, "folder_hits").select(F.lit("caption").alias("field"), F.col("hit_id").alias("row_id"), F.col("caption_source").alias("source"), F.col("caption").alias("text"))
    return folders.unionByName(hits)


def truncation_by_source(values: DataFrame, cut: DataFrame) -> DataFrame:
    """How often each source truncates: (field, source, n_values, n_cut, share); values are distinct rows with text."""
    have = values.filter("row_id is not null and text <> ''").groupBy("field", "source").agg(F.countDistinct("row_id").alias("n_values"))
    lost = cut.groupBy("field", "source").agg(F.countDistinct("row_id").alias("n_cut"))
    on = (have["field"] == lost["field"]) & have["source"].eqNullSafe(lost["source"])
    return have.join(lost, on, "left").select(have["field"], have["source"], "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_values"), 6).alias("share"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Sidecar texts and captions that lost their end."""
    return truncated_texts(texts_of_collection(spark, sf_dir), F.col("field"), "row_id", "text", "source").select("field", "row_id")


def p3_sources(spark, sf_dir: str) -> DataFrame:
    """The share of values without their end for each source."""
    values = texts_of_collection(spark, sf_dir)
    return truncation_by_source(values, truncated_texts(values, F.col("field"), "row_id", "text", "source"))
