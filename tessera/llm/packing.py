"""Filling containers of fixed capacity with texts, by exact-complement hashing."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, read_table, spread, task_count

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's texts were split into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    """A tokenizer from a file of ranks (.tiktoken; ``pattern`` splits texts into words), of the tokenizers library (.json) or of sentencepiece (.model)."""
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)]
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row with an id; a null text has a null count. The tasks read ``vocabulary`` from their own disk."""

    def count(batches):
        encode = _encoder(vocabulary, pattern)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                piece = b.slice(s, 256)
                texts = piece.column("text").to_pylist()
                sizes = iter(encode([t for t in texts if t is not None]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([None if t is None else next(sizes) for t in texts], pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null").mapInArrow(count, "doc_id long, n_tokens long")


def _exact(free: np.ndarray, gap: int, reach: int) -> list[int] | None:
    """One, two or three lengths, as long as possible, that fill ``gap`` exactly from the lengths in ``free``."""
    if gap <= reach and free[gap] > 0:
        return [gap]
    there = np.flatnonzero(free[: min(gap, reach) + 1] > 0)
    there = there[there > 0][::-1]
    if not len(there):
        return None

    def pair(rest: int, most: np.ndarray) -> list[int] | None:
        other = rest - most
        fine = (other > 0) & (other <= most)
        a, b = most[fine], other[fine]
        fits = free[b] > (a == b)
        at = np.flatnonzero(fits & (free[a] > 0))
        return [int(a[at[0]]), int(b[at[0]])] if len(at) else None

    if found := pair(gap, there):
        return found
    for a in there[there * 3 >= gap]:
        free[a] -= 1
        found = pair(gap - int(a), there[there <= a])
        free[a] += 1
        if found:
            return [int(a), *found]
    return None


def plan_containers(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Ways to fill a container and how often to use each, for ``counts[n]`` items of n units (1 to capacity).

    A container opens with the longest items left, as many as leave a gap that three items may fill; the index
    of single, pair and triple sums then gives lengths that fill the gap exactly. If none do, the longest item that
    fits goes in (best fit) and the rest of the gap is tried again. A way is used as long as its lengths last,
    so the work depends on the number of different lengths, not on the number of items.
    """
    free = np.asarray(counts, dtype=np.int64).copy()
    plan: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        there = np.flatnonzero(free)
        if not len(there):
            return plan
        top = int(there[-1])
        way, gap = [], capacity
        left = free.copy()
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            if way and gap <= 3 * longest and (last := _exact(left, gap, longest)):
                for x in last:
                    left[x] -= 1
                way += last
                gap = 0
                break
            way.append(longest)
            left[longest] -= 1
            gap -= longest
        lengths, each = np.unique(way, return_counts=True)
        times = int((free[lengths] // each).min())
        if gap:  # what doesn't fill up is used once, as other lengths may do better for the next
            times = 1 if len(there) > 1 else times
        free[lengths] -= times * each
        plan.append((way, times))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Containers for the texts: (container_id, doc_id, part, first_token, n_tokens).

    Every text lies whole in one container of ``capacity`` tokens, ``part`` 0; a text of more tokens is cut into
    parts of ``capacity`` tokens and a rest, each in one container. Null texts and null ids have no row; an empty
    text has a row of no tokens in some container (container 0 if there is no other). Rows of the same id and
    text are placed each. An empty table gives no rows. Other columns are ignored, whatever their names.

    The tokens are counted in the tasks. Only how many items there are of each length goes to the driver, at
    most ``capacity`` numbers and one for each partition; it plans the containers by length, and the plan, whose
    size depends on ``capacity`` alone, tells each task where the items of each length go, in the order of a
    range-partitioned sort by length. So a length that a third of all texts have lies in many tasks.
    """
    spark = df.sparkSession
    # range partitioning reads its input twice: the tokens are counted once
    counts = cut_lineage(token_counts(df, id_col, text_col, vocabulary, pattern).filter("n_tokens is not null"))
    parts = F.when(F.col("n_tokens") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity)))
    items = counts.select("doc_id", "n_tokens", F.explode(parts).alias("part")).select(
        "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.col("n_tokens") - F.col("part") * capacity, F.lit(capacity)).cast("long").alias("n_tokens")
    )
    ordered = cut_lineage(items.repartitionByRange(task_count(spark), "n_tokens", F.xxhash64("doc_id", "part")).withColumn("task", F.spark_partition_id()))
    by_task = ordered.groupBy("task", "n_tokens").count().collect()  # as many rows as there are lengths and tasks
    sizes = np.zeros(capacity + 1, dtype=np.int64)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(by_task, key=lambda r: (r["n_tokens"], r["task"])):
        before[r["task"], r["n_tokens"]] = int(sizes[r["n_tokens"]])
        sizes[r["n_tokens"]] += r["count"]
    sizes[0] = 0
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: first item, first container, items in each container
    used = np.zeros(capacity + 1, dtype=np.int64)
    containers = 0
    for way, times in plan_containers(sizes, capacity):
        for length, each in zip(*np.unique(way, return_counts=True)):
            slots.setdefault(int(length), []).append((int(used[length]), containers, int(each)))
            used[length] += int(each) * times
        containers += times
    tables = {n: np.array(x, dtype=np.int64).T for n, x in slots.items()}
    containers = max(containers, 1)

    def assign(batches):
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            task, length = b.column("task").to_numpy(), b.column("n_tokens").to_numpy()
            container = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                for t in np.unique(task[length == n]):
                    at = np.flatnonzero((length == n) & (task == t))
                    first = seen.get((t, n), before[int(t), int(n)])
                    rank = np.arange(first, first + len(at))
                    seen[t, n] = first + len(at)
                    if n == 0:
                        container[at] = rank % containers
                        continue
                    starts, base, each = tables[int(n)]
                    slot = np.searchsorted(starts, rank, side="right") - 1
                    container[at] = base[slot] + (rank - starts[slot]) // each[slot]
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column("doc_id"), b.column("part"), b.column("first_token"), b.column("n_tokens")], names=["container_id", "doc_id", "part", "first_token", "n_tokens"])

    return ordered.mapInArrow(assign, "container_id long, doc_id long, part long, first_token long, n_tokens long")


def p6_packed(spark, sf_dir: str) -> DataFrame:
    """The documents in containers of 2,048 tokens."""
    return pack_texts(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_unused(spark, sf_dir: str) -> DataFrame:
    """How many containers the documents take, the tokens in them and the share that stays unused."""
    used = p6_packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") == 2048).alias("full"), F.round(1 - F.sum("n") / (F.count("*") * 2048), 6).alias("unused_share")
    )
