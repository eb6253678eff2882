"""Garbled text from a wrong character encoding, found and repaired by minimum description length."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, read_table, task_count

# Encodings that bytes are wrongly read in, and what those bytes were. Fixed values.
WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1250", "cp1254", "iso8859-15", "cp949", "cp932", "gbk", "big5")
RIGHT = ("utf-8", "cp949", "cp1251", "cp866", "koi8-r", "cp932", "euc-jp", "cp1252", "mac_roman", "cp1258", "gbk")
SINGLE = {"cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1250", "cp1254", "iso8859-15"}
#: What was taken for UTF-8 goes with any wrong encoding; a single-byte alphabet only with another single-byte one.
CHAINS = [(w, r) for w in WRONG for r in RIGHT if w != r and (r == "utf-8" or w in SINGLE)]
SPACES = re.compile(r"([ \t\r\n]+)")
DIGITS = re.compile("[0-9]+")
LOST = "�"
CONTROLS = re.compile("[\x00-\x1f\x7f\ud800-\udfff\ue000-\uf8ff\ufffe\uffff]")  # those from 80 to 9f may be bytes still to decode
# letters a proper token mixes with nothing else: of one script, or plain signs
SIGNS = "‐-―‘-‟…‰′″€№™−∞×÷°±½¼¾·•→←↑↓★☆«»¿¡§©®²³µ"
PROPER = re.compile(
    rf"(?:[\x21-\x7e{SIGNS}]|[가-힣])*|(?:[\x21-\x7e{SIGNS}]|[ぁ-ヿ々〆一-鿿、。「」『』・ー])*|(?:[\x21-\x7e{SIGNS}]|[А-Яа-яЁё])*|(?:[\x21-\x7e{SIGNS}]|[α-ωΑ-Ω])*"
)
SCRIPT = re.compile("[가-힣ぁ-ヿ]")
LANGUAGES = (("hangul", re.compile("[가-힣]")), ("kana", re.compile("[ぁ-ヿ一-鿿]")), ("cyrillic", re.compile("[А-Яа-я]")), ("vietnamese", re.compile("[ạ-ỹĐđƠơƯư]")), ("latin", re.compile("[À-ž]")), ("ascii", re.compile("")))


def _bytes_as(text: str, wrong: str) -> bytes:
    """The bytes that read as ``text`` in ``wrong``; control characters stand for the bytes the encoding has no sign for."""
    if wrong in SINGLE and wrong != "latin-1":
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(wrong) for c in text)
    return text.encode(wrong)


@functools.lru_cache(maxsize=200_000)
def decodings(token: str) -> tuple[tuple[str, str, str], ...]:
    """(wrong, right, text) of every way in which a token without spaces may have been misread."""
    if LOST in token:
        return ()
    out = {}
    for wrong in WRONG:
        try:
            raw = _bytes_as(token, wrong)
        except UnicodeEncodeError:
            continue
        for right in RIGHT:
            if (wrong, right) not in _ALLOWED:
                continue
            try:
                text = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if text != token and text not in out and not CONTROLS.search(text):
                out[text] = (wrong, right, text)
    return tuple(out.values())


_ALLOWED = set(CHAINS)


PUNCTUATION = " !\"'(),.:;?[]"


def _plain(token: str) -> str:
    return DIGITS.sub("0", token.strip(PUNCTUATION))


def token_key(token: str) -> int:
    """What xxhash64 makes of a string column."""
    key = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), seed=42)
    return key - (1 << 64) if key >> 63 else key


class Lengths:
    """Description lengths of texts: the least number of bytes that a language's dictionary compresses them to.

    ``counts`` says how many texts have a token, by :func:`token_key` of the token without digits and punctuation.
    """

    def __init__(self, dictionaries: dict[str, bytes], counts: dict[int, int] | None = None):
        self.counts = counts or {}
        self.coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for d in dictionaries.values()]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def __call__(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min((len(c.compress(raw)) for c in self.coders), default=len(self.plain.compress(raw)))

    def attested(self, key: int, decoded: int, phrase: bool) -> float:
        """How many times (as a power of two) more often the texts have the one token than the other, by their keys.

        Where words aren't set apart by spaces few tokens recur: a whole ``phrase`` of one script that replaces a
        much longer mixture counts as eight times as often.
        """
        a, b = self.counts.get(decoded, 0), self.counts.get(key, 0)
        b = b if b > 1 else 0  # the text itself
        if phrase and not b and a < 7:
            return 3.0
        return math.log2((1 + a) / (1 + b)) if a or b else 0.0


def _phrase_of_script(raw: str, decoded: str) -> bool:
    return bool(4 <= len(decoded) <= 0.75 * len(raw) and SCRIPT.search(decoded) and PROPER.fullmatch(decoded) and not PROPER.fullmatch(raw))


@functools.lru_cache(maxsize=200_000)
def comparisons(token: str) -> tuple[int, tuple[tuple[tuple[str, str], str, int, bool], ...]]:
    """The key of a token, and (chain, text, key, whether it is a phrase of one script) of each of its decodings."""
    return token_key(_plain(token)), tuple(((w, r), t, token_key(_plain(t)), _phrase_of_script(token, t)) for w, r, t in decodings(token))


def is_strict(chain: tuple[str, str]) -> bool:
    """Whether few texts are valid in the encodings of a chain, so that being valid is evidence."""
    return chain[1] == "utf-8" and chain[0] in SINGLE


def looks_misread(text: str, length: Lengths) -> bool:
    """Whether some decoding of a token of a text is evidence by itself, or occurs more than twice as often as the token."""
    for token in SPACES.split(text)[::2]:
        if not token.isascii():
            key, found = comparisons(token)
            if any(is_strict(chain) or length.attested(key, other, phrase) > 1 for chain, _, other, phrase in found):
                return True
    return False


def repair(text: str, length: Lengths, step_cost: float = 1.0, rounds: int = 3, least_known: float = 2.0) -> tuple[str, list[str], int]:
    """The text as it was before it was misread, the steps taken back (wrong>right), and the bytes of description saved.

    Stretches of tokens that some pair of encodings can explain are tried with each pair, with two tokens on
    either side; the pair with the least description length, each step costing ``step_cost`` bytes, replaces the
    stretch if it beats the text as it is. That is repeated, since texts are misread more than once. Bytes that
    happen to be valid UTF-8 are evidence enough; for other pairs the texts must have the tokens that come out
    2**``least_known`` times as often, in all, as those that go in.
    """
    steps: list[str] = []
    saved = 0
    for _ in range(rounds):
        pieces = SPACES.split(text)
        suspects: dict[int, dict[tuple[str, str], tuple[str, float]]] = {}  # by place and chain: the decoding and how known it is
        for k in range(0, len(pieces), 2):
            if not pieces[k].isascii():
                key, found = comparisons(pieces[k])
                if found:
                    suspects[k] = {chain: (t, length.attested(key, other, phrase)) for chain, t, other, phrase in found}
        runs: list[list[int]] = []
        for k in suspects:
            if runs and k - runs[-1][-1] <= 6:
                runs[-1].append(k)
            else:
                runs.append([k])
        changed = False
        for run in runs:
            todo = run
            while todo:
                by_chain: dict[tuple[str, str], list[int]] = {}
                for k in todo:
                    for chain in suspects[k]:
                        by_chain.setdefault(chain, []).append(k)
                first, last = max(0, todo[0] - 4), min(todo[-1] + 5, len(pieces))
                now = None
                best = (math.inf, None, None)
                for chain, at in sorted(by_chain.items()):
                    known = sum(suspects[k][chain][1] for k in at)
                    strict = is_strict(chain)
                    if not strict:  # few texts aren't valid in these encodings: the words must be known as well
                        at = [k for k in at if suspects[k][chain][1] > 1]
                        if known < least_known or not at:
                            continue
                    if now is None:
                        now = length("".join(pieces[first:last]))
                        best = (now, None, None)
                    new = {k: suspects[k][chain][0] for k in at}
                    size = length("".join(new.get(j, pieces[j]) for j in range(first, last)))
                    size += -0.5 if strict and known >= least_known else step_cost
                    if size < best[0]:
                        best = (size, chain, new)
                if best[1] is None:
                    break
                for k, t in best[2].items():
                    pieces[k] = t
                saved += max(0, now - math.ceil(best[0]))
                name = ">".join(best[1])
                if name not in steps:
                    steps.append(name)
                changed = True
                todo = [k for k in todo if k not in best[2]]
        if not changed:
            break
        text = "".join(pieces)
    return text, steps, saved


def looks_lost(text: str) -> bool:
    """Whether replacement marks show that bytes were read in a wrong encoding. One mark at the very end may be a cut character."""
    marks = text.count(LOST)
    if not marks:
        return False
    return not (marks <= 2 and text.rstrip(LOST).count(LOST) == 0 and marks == len(text) - len(text.rstrip(LOST)))


def count_tokens(texts: list[str]) -> dict[int, int]:
    """How many of some texts have each token beyond ASCII, by its key."""
    counts = Counter(t for text in texts if not text.isascii() for t in {_plain(x) for x in SPACES.split(text)[::2] if not x.isascii()})
    return {token_key(t): n for t, n in counts.items()}


def excerpt(text: str, place: int, most: int) -> list[tuple[str, str]]:
    """(language, sentence) of a text: for each language its sentences from number ``place`` on, going round, of ``most`` characters in all."""
    found: dict[str, list[str]] = {}
    for sentence in re.split(r"(?<=[.!?。])\s+", text):
        for name, has in LANGUAGES:
            if m := has.search(sentence):
                found.setdefault(name, []).append(sentence if len(sentence) <= most else sentence[m.start() : m.start() + most])
                break
    out = []
    for name, sentences in found.items():
        first, have = place % len(sentences), 0
        for s in sentences[first:] + sentences[:first]:
            out.append((name, s))
            if (have := have + len(s)) >= most:
                break
    return out


def train_dictionaries(sentences: list[tuple[str, str]], size: int = 65_536) -> dict[str, bytes]:
    """Content for a dictionary of each language, from (language, sentence) of proper texts."""
    pools: dict[str, list[str]] = {name: [] for name, _ in LANGUAGES}
    for name, sentence in sentences:
        pools[name].append(sentence)
    out = {}
    for name, own in pools.items():
        picked, have = [], 0
        for s in dict.fromkeys(own):
            picked.append(s)
            have += len(s.encode())
            if have >= size:
                break
        if picked:
            out[name] = " ".join(picked).encode()
    return out


KEYS = ("key_a", "key_b")  # 128 bits that stand for a text
COUNTS = "array<struct<key:bigint,n:bigint>>"
SMALL = 1_000_000  # counts (16 bytes each) that may be sent to every task


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(KEYS[0]), F.xxhash64(F.lit(1), text).alias(KEYS[1])]


def distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """The different texts beyond ASCII, with their keys: (key_a, key_b, t)."""
    texts = df.select(F.col(text_col).alias("t")).filter(F.col("t").rlike("[^\\x00-\\x7f]"))
    return texts.select(*text_keys(F.col("t")), "t").dropDuplicates(list(KEYS))


def token_table(texts: DataFrame, rounds: int = 3) -> DataFrame:
    """The tokens that may be misread, and how many of all whole texts have them and what they decode to: (token, counts, live).

    ``token`` is the key of a token, ``counts`` has what comparing it with its decodings, and these with theirs, can
    need. A token is here if a decoding of it occurs in some text, or is evidence by itself (see :func:`repair`); it is
    ``live`` if a decoding is, or occurs more than twice as often. Without a live token no text is changed.
    """
    tasks = task_count(texts.sparkSession)

    def count(batches):
        for b in batches:
            pieces = Counter()
            for text in b.column("t").to_pylist():
                own = {x for x in SPACES.split(text)[::2] if not x.isascii()}
                pieces.update((x, False) for x in own)
                pieces.update((x, True) for x in {_plain(x) for x in own})
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pieces], pa.string()), pa.array([p for _, p in pieces], pa.bool_()), pa.array(list(pieces.values()), pa.int64())], names=["token", "plain", "n"])

    def pairs(batches):
        for b in batches:
            out = set()
            for piece in b.column("token").to_pylist():
                own, seen, todo = token_key(piece), {piece}, [piece]
                for _ in range(rounds):
                    more = []
                    for raw in todo:
                        key, found = comparisons(raw)
                        for chain, text, other, phrase in found:
                            strict = is_strict(chain)
                            out.add((own, key, other, phrase or strict))
                            if phrase:  # goes by the count of what it replaces
                                out.add((own, key, key, True))
                            # what other tokens decode to is read again only where it occurs, and then is a token itself
                            if text not in seen and not text.isascii() and (phrase or strict):
                                seen.add(text)
                                more.append(text)
                    todo = more
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.bool_()])], names=["token", "raw", "decoded", "sure"])

    counted = cut_lineage(texts.select("t").repartition(tasks).mapInArrow(count, "token string, plain boolean, n long").groupBy("token", "plain").agg(F.sum("n").alias("n")))
    known = counted.filter("plain").select(F.xxhash64("token").alias("key"), "n")
    compared = counted.filter("not plain").select("token").repartition(tasks).mapInArrow(pairs, "token long, raw long, decoded long, sure boolean")
    met = compared.join(known.select(F.col("key").alias("decoded"), F.col("n").alias("n_decoded")), "decoded", "left").filter("sure or n_decoded is not null")
    both = met.join(known.select(F.col("key").alias("raw"), F.col("n").alias("n_raw")), "raw", "left")
    entry = lambda key, n: F.when(F.col(n).isNotNull(), F.struct(F.col(key).alias("key"), F.col(n).alias("n")))
    decoded, raw = (F.collect_set(entry(k, n)) for k, n in (("decoded", "n_decoded"), ("raw", "n_raw")))
    live = F.col("sure") | (1 + F.col("n_decoded") > 2 * (1 + F.when(F.col("n_raw") > 1, F.col("n_raw")).otherwise(0)))
    return both.groupBy("token").agg(F.array_union(decoded, raw).cast(COUNTS).alias("counts"), F.max(live).alias("live"))


def with_counts(texts: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """The texts with a live token of the table, and the counts of all their tokens there: (key_a, key_b, counts)."""
    tokens = F.filter(F.array_distinct(F.split("t", "[ \\t\\r\\n]+")), lambda x: x.rlike("[^\\x00-\\x7f]"))
    pieces = texts.select(*KEYS, F.explode(F.transform(tokens, lambda x: F.xxhash64(x))).alias("token"))
    found = pieces.join(F.broadcast(table) if small else table, "token")
    return found.groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_list("counts"))).alias("counts"), F.max("live").alias("live")).filter("live").drop("live")


def fitted(texts: DataFrame, table: DataFrame, small: bool, sample: int = 20_000, size: int = 65_536, stretch: int = 2000) -> dict[str, bytes]:
    """Dictionaries of the languages, from at most ``sample`` texts of the lowest hash, of each and each language at most ``stretch`` characters, which may begin at any sentence.

    The texts are chosen where they are, by a bound on their hash that their number gives, and searched for misread
    tokens whole; only what they give for the dictionaries comes to the driver.
    """
    n = texts.agg(F.count("*")).head()[0]
    bound = int(-(2**63) + 2**64 * min(1.0, (sample + 4 * sample**0.5) / max(n, 1)))
    few = cut_lineage(texts.filter(F.col(KEYS[0]) <= F.lit(min(bound, 2**63 - 1))).orderBy(*KEYS).limit(sample))

    def proper(batches):
        length = Lengths({})
        for b in batches:
            at, out = [], []
            for k, (place, text, counts) in enumerate(zip(b.column(KEYS[1]).to_pylist(), b.column("t").to_pylist(), b.column("counts").to_pylist())):
                length.counts = {c["key"]: c["n"] for c in counts or ()}
                if LOST not in text and not looks_misread(text, length):
                    own = excerpt(text, place, stretch)
                    at += [k] * len(own)
                    out += [(n, *x) for n, x in enumerate(own)]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in KEYS), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=[*KEYS, "n", "language", "sentence"])

    rows = few.join(with_counts(few, table, small), list(KEYS), "left").select(*KEYS, "t", "counts").repartition(task_count(texts.sparkSession))
    kept = rows.mapInArrow(proper, "key_a long, key_b long, n long, language string, sentence string").toArrow()
    kept = kept.sort_by([(c, "ascending") for c in (*KEYS, "n")])
    return train_dictionaries(list(zip(kept.column("language").to_pylist(), kept.column("sentence").to_pylist())), size)


def restorations(df: DataFrame, text_col: str, sample: int = 20_000, size: int = 65_536, stretch: int = 2000, step_cost: float = 1.0) -> DataFrame:
    """The different texts that show bytes read in a wrong encoding: (key_a, key_b, original, steps, bytes_saved, recovered); see :func:`garbled_texts`."""
    texts = cut_lineage(distinct_texts(df, text_col))
    table = cut_lineage(token_table(texts))
    entries = table.agg(F.coalesce(F.sum(F.size("counts") + 1), F.lit(0))).head()[0]
    small = entries <= SMALL
    dictionaries = fitted(texts, table, small, sample, size, stretch)
    # texts without a token to compare can't get shorter; marks of lost bytes show by themselves
    rows = texts.join(with_counts(texts, table, small), list(KEYS), "left").filter(F.col("counts").isNotNull() | F.col("t").contains(LOST))

    def run(batches):
        length = Lengths(dictionaries)
        for b in batches:
            at, out = [], []
            for k, (text, counts) in enumerate(zip(b.column("t").to_pylist(), b.column("counts").to_pylist())):
                length.counts = {c["key"]: c["n"] for c in counts or ()}
                fixed, chain, less = repair(text, length, step_cost)
                if chain or looks_lost(text):
                    at.append(k)
                    out.append((fixed, chain, less, LOST not in fixed))
            cols = list(zip(*out)) if out else [[]] * 4
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in KEYS]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_())))], names=[*KEYS, "original", "steps", "bytes_saved", "recovered"])

    # the work is in the characters, not in the bytes that adaptive execution goes by
    return rows.repartition(task_count(df.sparkSession)).mapInArrow(run, "key_a long, key_b long, original string, steps array<string>, bytes_saved long, recovered boolean")


def garbled_texts(df: DataFrame, id_col: str, text_col: str, sample: int = 20_000, size: int = 65_536, step_cost: float = 1.0, stretch: int = 2000) -> DataFrame:
    """Texts that show bytes read in a wrong encoding: (id, original, steps, bytes_saved, recovered).

    ``original`` is the text as it was before, wherever a chain of misreadings explains it, ``steps`` the
    chain (wrong>right, the last misreading first), ``bytes_saved`` what the description gets shorter.
    ``recovered`` is false where characters were lost, which replacement marks show; ``original`` then has what
    could be restored of the rest. Texts that no chain makes shorter stay as they are and have no row.

    Description lengths come from zstandard with a dictionary for each language, made of a bounded sample of
    the column (``sample`` texts, of each ``stretch`` characters, ``size`` bytes a language); only these come to the
    driver. Tokens are counted over all whole texts, and each text gets the counts of its own tokens by a join, which
    sends the table of tokens to the tasks where it is small. Each different text is repaired once.

    Null ids, null and empty texts have no rows. Repeated rows give one row each time they differ. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    rows = rows.select("id", *text_keys(F.col("text"))).dropDuplicates()
    return rows.join(restorations(df, text_col, sample, size, stretch, step_cost), list(KEYS)).drop(*KEYS)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Folders whose text shows bytes read in a wrong encoding."""
    return garbled_texts(read_table(spark, sf_dir, "leaf_folders"), "folder_id", "sidecar_text").select(F.col("id").alias("folder_id")).distinct()


def p4_restored(spark, sf_dir: str) -> DataFrame:
    """The original texts of the garbled ones."""
    return garbled_texts(read_table(spark, sf_dir, "leaf_folders"), "folder_id", "sidecar_text").select(F.col("id").alias("folder_id"), "original", "steps", "recovered")
