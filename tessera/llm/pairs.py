"""Items that appear together, by heavy-light decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, read_table, task_count


def clean_labels(labels: Column) -> Column:
    """Stripped, lower-cased labels without nulls and blanks, each once, in order; null stays null."""
    stripped = F.transform(labels, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(stripped, lambda x: x.isNotNull() & (x != ""))))


def image_key(path: Column) -> Column:
    """A path with letter case and the direction of slashes put aside."""
    return F.lower(F.translate(path, "\\", "/"))


PAIRS = 2_000_000  # pairs of light items that are expanded at once


def _expand(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n in ``counts``, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _count_pairs(names: dict[str, int], heavy: int, flush: int, batches):
    """Partial counts (a, b, n) of one partition whose rows come sorted by record.

    The row (a, a, n) counts the records with a, the row (null, null, n) all records. ``names`` numbers the
    heavy items from 0; the light ones are numbered on from there as they come. Among heavy items a pair is
    counted by the popcount of two rows of a bit matrix, among light ones by its number in a table, and between
    the two by probing the bits of the records in a light item's list.
    """
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    order = list(names)
    square = np.zeros((heavy, heavy), dtype=np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []  # keys (a * 2**32 + b) and counts
    held_size = total = 0
    mixed: dict[int, np.ndarray] = {}

    def emit(keys, counts):
        words = pa.array(order, type=pa.string())
        for s in range(0, len(keys), 1 << 16):
            k = keys[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(k >> 32)), words.take(pa.array(k & 0xFFFFFFFF)), pa.array(counts[s : s + (1 << 16)])], schema=schema)

    def compact():
        nonlocal held, held_size
        if held:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            held = [(keys, np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64))]
            held_size = len(keys)

    def drain():
        nonlocal held, held_size, mixed, order, names
        compact()
        for keys, counts in held:
            yield from emit(keys, counts)
        for light, row in mixed.items():
            at = np.flatnonzero(row)
            yield from emit((at.astype(np.int64) << 32) | light, row[at])
        held, held_size, mixed = [], 0, {}
        order = order[:heavy]
        names = {x: i for i, x in enumerate(order)}

    def block(items: pa.ListArray, starts: np.ndarray):
        """``starts`` has the first row of each record of the block, and the number of rows."""
        nonlocal held_size, total
        records = len(starts) - 1
        total += records
        lengths = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = items.flatten().dictionary_encode()
        local = np.empty(len(coded.dictionary), dtype=np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            if (code := names.get(word)) is None:
                code = names[word] = len(order)
                order.append(word)
            local[i] = code
        record = np.repeat(np.repeat(np.arange(records), np.diff(starts)), lengths)
        pairs = np.unique((record << 32) | local[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else record[:0])
        row, code = pairs >> 32, pairs & 0xFFFFFFFF
        strong = code < heavy
        width = -(-records // 64) * 64
        bits = np.zeros((heavy, width), dtype=bool)
        bits[code[strong], row[strong]] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in np.unique(code[strong]):
            square[i, i:] += np.bitwise_count(words[i] & words[i:]).sum(axis=1, dtype=np.int64)
        row, code = row[~strong], code[~strong]
        if not len(code):
            return
        after = np.searchsorted(row, row, side="right") - np.arange(len(row))  # itself and the later ones of its record
        ends = np.cumsum(after)
        at = 0
        while at < len(row):  # so many items at a time that their pairs are few, also those of one record of very many
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(at, end), after[at:end])
            keys, counts = np.unique((code[left] << 32) | code[left + _expand(after[at:end])], return_counts=True)
            held.append((keys, counts))
            held_size += len(keys)
            if held_size > flush:
                compact()
            at = end
        if heavy:
            by = np.argsort(code, kind="stable")
            lists, first = np.unique(code[by], return_index=True)
            bytes_ = np.packbits(bits.T, axis=1)
            for s in range(0, len(lists), 512):
                at = by[first[s] : first[s + 512] if s + 512 < len(lists) else len(by)]
                probe = np.unpackbits(bytes_[row[at]], axis=1, count=heavy)
                sums = np.add.reduceat(probe, first[s : s + 512] - first[s], axis=0, dtype=np.int64)
                for light, more in zip(lists[s : s + 512].tolist(), sums):
                    if (had := mixed.get(light)) is None:
                        mixed[light] = more.copy()
                    else:
                        had += more

    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if carry is None else [carry, b]).combine_chunks()
        rec = t.column("rec").combine_chunks()
        new = np.append(True, pc.not_equal(rec[1:], rec[:-1]).to_numpy(zero_copy_only=False)) if len(rec) > 1 else np.array([True])
        starts = np.flatnonzero(new)
        last = starts[-1]
        if len(starts) > 1:
            block(t.column("items").combine_chunks()[:last], starts)
        carry = _merge(t.slice(last)) if t.num_rows - last > 1 else t.slice(last).to_batches()[0]
        if held_size > flush:
            compact()
        if held_size > flush or len(mixed) * heavy > flush * 2:
            yield from drain()
    if carry is not None:
        t = pa.Table.from_batches([carry])
        block(t.column("items").combine_chunks(), np.array([0, 1]))
    yield from drain()
    a, b = np.nonzero(square)
    yield from emit((a.astype(np.int64) << 32) | b, square[a, b])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([total])], schema=schema)


def _merge(t: pa.Table) -> pa.RecordBatch:
    """One row for the rows of one record, so that a record of very many rows is never held whole."""
    union = pc.unique(t.column("items").combine_chunks().flatten())
    return pa.RecordBatch.from_arrays([t.column("rec").combine_chunks()[:1], pa.array([union.to_pylist()], type=t.schema.field("items").type)], schema=t.schema)


def cooccurring_items(
    df: DataFrame, record_col: str | Column, items_col: str | Column, min_count: int = 1, min_lift: float = 0.0, density: float = 1 / 64, max_heavy: int = 512, flush: int = 1_500_000, sample: int = 100_000
) -> DataFrame:
    """How often each pair of items shares a record: (item_a, item_b, n_ab, n_a, n_b, n_records, lift).

    ``item_a < item_b`` by code point; ``lift`` is n_ab * n_records / (n_a * n_b). A record is all rows with the
    same ``record_col``; its items are those of all its rows, each once. Records without items count in
    n_records. Rows whose record is null are left out, as are null items and null lists. Pairs below
    ``min_count`` or ``min_lift`` don't come out; with the defaults every pair does, exactly. An empty table
    gives no rows. Other columns of ``df`` are ignored, whatever their names.

    Heavy are the items in at least ``density`` of about ``sample`` rows (of all with 0), at most ``max_heavy`` of them;
    only their names travel to the tasks. The choice decides how a pair is counted, never whether: all rows are counted.
    """
    spark = df.sparkSession
    rec = F.col(record_col) if isinstance(record_col, str) else record_col
    items = F.col(items_col) if isinstance(items_col, str) else items_col
    rows = df.select(rec.cast("string").alias("rec"), items.alias("items")).filter("rec is not null")
    # which items are heavy is told by a sample: it decides how a pair is counted, not whether. A null stands for the row itself
    some = rows.sample(min(1.0, sample / max(df.count(), 1)), seed=1) if sample else rows
    usage = some.select(F.explode(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("x")).groupBy("x").count()
    top = usage.orderBy(F.col("x").isNotNull(), F.desc("count"), "x").limit(max_heavy + 1).collect()
    size = top[0]["count"] if top else 0
    names = {r["x"]: i for i, r in enumerate(r for r in top[1:] if r["count"] >= max(2, density * size))}

    # rows repeated within a record are merged before the shuffle by record, so a record of a third of all rows stays small
    spread = rows.withColumn("items", F.array_sort(F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull())))).dropDuplicates(["rec", "items"])
    by_record = spread.repartition(task_count(spark), "rec").sortWithinPartitions("rec")

    def count(batches):
        return _count_pairs(dict(names), len(names), flush, batches)

    partial = by_record.mapInArrow(count, "a string, b string, n long")
    ordered = partial.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
    counts = cut_lineage(ordered.groupBy("a", "b").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | F.col("a").isNull() | (F.col("a") == F.col("b"))))
    n_records = counts.filter("a is null").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    single = counts.filter("a = b")
    pairs = counts.filter("a < b").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"))
    lift = F.col("n_ab") * float(n_records) / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        pairs.join(single.select(F.col("a").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(single.select(F.col("a").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n_records", F.lit(n_records).cast("long"))
        .withColumn("lift", lift)
        .filter(F.lit(min_lift <= 0) | (F.col("n_ab").cast("decimal(38,0)") * int(n_records) >= F.lit(min_lift).cast("decimal(10,4)") * F.col("n_a") * F.col("n_b")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", "lift")
    )


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of labels in at least 10 images together, at least four times as often as by chance."""
    records = read_table(spark, sf_dir, "graph_records")
    found = cooccurring_items(records, image_key(F.col("image_path")), clean_labels(F.col("classes")), min_count=10, min_lift=4.0)
    return found.select(F.col("item_a").alias("class_a"), F.col("item_b").alias("class_b"))
