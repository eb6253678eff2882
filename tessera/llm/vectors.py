"""Most similar vectors for every vector, by shifted space-filling curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import read_table, task_count

SCALE = 32767  # unit components travel as 16-bit fixed point: half the bytes, an error of a cosine near 1e-5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n x d, integers below 2**bits) on the d-dimensional Hilbert curve.

    d * bits must be at most 62. Transforms the axes in place of walking the curve, for all rows at once.
    """
    x = [c.astype(np.int64) for c in cells.T]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[d - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros(len(cells), dtype=np.int64)
    x = [c ^ flip for c in x]
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the usable lists in ``column`` and their unit vectors, in double precision."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dim)
    flat = arr.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dim)
    top = np.abs(rows).max(axis=1, initial=0)
    fine = np.isfinite(rows).all(axis=1) & (top > 0)
    rows, keep = rows[fine], keep[fine]
    rows = rows / top[fine][:, None]
    return keep, rows / np.linalg.norm(rows, axis=1)[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit float64 rows of the 16-bit fixed-point vectors in a binary column."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, dim).astype(np.float64)
    return data / np.linalg.norm(data, axis=1)[:, None]


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 10,
    dim: int = 64,
    min_similarity: float | None = None,
    version_col: str | None = None,
    curves: int = 8,
    axes: int = 12,
    bits: int = 4,
    block: int = 1536,
    seed: int = 11,
) -> DataFrame:
    """For every usable vector its ``k`` most similar others: (id, neighbor, similarity, rank).

    Each of ``curves`` orderings projects the vectors on ``axes`` random orthogonal directions, shifts the grid
    by a random offset and sorts by the Hilbert position; one range-partitioned shuffle sorts all orderings.
    Blocks of ``block`` rows meet the block before and the block after; where a partition ends amid a curve, its last
    ``block`` rows meet the first of the next one. So a vector is compared with ``block`` to ``2 * block``
    neighbours on either side of each curve, if there are as many; partitions are made of eight blocks or more, few
    where the rows are few. What the curves found is merged and reranked. Work is linear in the rows, whatever the sizes
    of the groups of equal or near-equal vectors.
    Results are approximate: a neighbour that is far on every curve is missed. ``min_similarity`` drops weaker
    neighbours early.

    Usable are vectors of ``dim`` finite components that aren't all zero; rows with a null id are left out. Of
    rows with the same id the one with the highest ``version_col`` counts (nulls lowest; without it, or in a
    tie, the one whose vector is greatest). Neighbours of equal similarity rank by id. An empty table, or one
    usable vector, gives no rows. Other columns of ``df`` are ignored, whatever their names.
    """
    spark = df.sparkSession
    rng = np.random.default_rng(seed)
    axes = min(axes, dim)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes] for _ in range(curves)]
    shifts = [rng.uniform(-0.5, 0.5, axes) for _ in range(curves)]
    floor = -2.0 if min_similarity is None else float(min_similarity)

    def encode(batches):
        for b in batches:
            keep, unit = _unit_rows(b.column("v"), dim)
            packed = np.rint(unit * SCALE).astype("<i2")
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 2), len(keep), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("ver").take(at), values], names=["id", "ver", "q"])

    version = F.col(version_col).cast("timestamp" if dict(df.dtypes)[version_col].startswith("timestamp") else "string") if version_col else F.lit(None).cast("string")
    source = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), version.alias("ver"), F.col(vec_col).cast("array<double>").alias("v"))
    ver_type = dict(source.dtypes)["ver"]
    unique = (
        source.mapInArrow(encode, f"id string, ver {ver_type}, q binary")
        .groupBy("id")
        .agg(F.max(F.struct("ver", "q")).alias("m"))
        .select("id", F.col("m.q").alias("q"))
    )

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            unit = _matrix(b.column("q"), dim)
            for c in range(curves):
                spread = (unit @ turns[c]) * np.sqrt(dim) + shifts[c]
                cells = np.clip((spread + 4) * (2**bits / 8), 0, 2**bits - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, c, dtype=np.int32)), pa.array(hilbert_keys(cells, bits)), b.column("id"), b.column("q")], names=["curve", "key", "id", "q"]
                )

    # a partition shorter than a block would leave its rows without neighbours
    parts = max(1, min(task_count(spark), source.count() * curves // (8 * block)))
    ordered = unique.mapInArrow(place, "curve int, key long, id string, q binary").repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")

    def best(rows, around_ids, row_ids, around, own):
        """The k best neighbours of each row of a block, as a batch of lists; the rows themselves begin at place ``own``, if they are there."""
        sims = rows.astype(np.float32) @ around.astype(np.float32).T
        if own is not None:
            sims[np.arange(len(rows)), own + np.arange(len(rows))] = -3  # itself
        if floor <= -2 and sims.shape[1] > k + 1:
            cut = np.partition(sims, sims.shape[1] - k - 1, axis=1)[:, sims.shape[1] - k - 1]
            r, c = np.nonzero(sims >= np.maximum(cut, -2)[:, None])
        else:
            r, c = np.nonzero(sims >= floor - 1e-4)
        s = np.round(np.einsum("ij,ij->i", rows[r], around[c]), 9)
        fine = s >= floor
        r, c, s = r[fine], c[fine], s[fine]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        starts = np.searchsorted(r, np.arange(len(rows) + 1))
        keep = np.arange(len(r)) - starts[r] < k
        r, c, s = r[keep], c[keep], s[keep]
        some = np.unique(r)
        offsets = np.append(np.searchsorted(r, some), len(r)).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(-s), around_ids.take(pa.array(c))], names=["d", "id"])
        return pa.RecordBatch.from_arrays([row_ids.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), near)], names=["id", "near"])

    def windows(batches):
        kept: list[tuple[np.ndarray, pa.Array]] = []  # the block before and the block that waits for the next
        part: list[pa.RecordBatch] = []
        size, curve = 0, None

        def push(done: bool):
            nonlocal part, size, kept
            table = pa.Table.from_batches(part).combine_chunks() if part else None
            part, size = [], 0
            at = 0
            while table is not None and (table.num_rows - at >= block or (done and at < table.num_rows)):
                piece = table.slice(at, block)
                at += piece.num_rows
                kept.append((_matrix(piece.column("q"), dim), piece.column("id").combine_chunks()))
                if len(kept) > 1:
                    yield middle(kept[-3:] if len(kept) > 2 else [None, *kept])
                    kept = kept[-2:]
            if table is not None and at < table.num_rows:
                part, size = table.slice(at).to_batches(), table.num_rows - at
            if done and kept:
                yield middle([kept[-2] if len(kept) > 1 else None, kept[-1], None])
                kept = []

        def middle(three):
            rows, ids = three[1]
            near = [x for x in three if x is not None]
            own = len(three[0][0]) if three[0] is not None else 0
            return best(rows, pa.concat_arrays([x[1] for x in near]), ids, np.concatenate([x[0] for x in near]), own)

        for b in batches:
            at = 0
            numbers = b.column("curve").to_numpy()
            while at < b.num_rows:
                end = int(np.searchsorted(numbers, numbers[at], side="right"))
                if curve is not None and numbers[at] != curve:
                    yield from push(True)
                curve = numbers[at]
                part.append(b.slice(at, end - at))
                size += end - at
                at = end
                if size >= block:
                    yield from push(False)
        yield from push(True)

    def edges(batches):
        """The first rows of a partition for the edge before it (side 1), its last rows for the edge after it (side 0)."""
        number = TaskContext.get().partitionId()

        def side(rows, which, edge):
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.array([edge] * n, pa.int32()), pa.array([which] * n, pa.int32()), rows.column("curve"), rows.column("id"), rows.column("q")], names=["edge", "side", "curve", "id", "q"])

        left, last, have = block, [], 0
        start = None
        for b in batches:
            if not b.num_rows:
                continue
            start = b.column("curve")[0] if start is None else start
            if left:
                head = b.slice(0, left)
                left -= head.num_rows
                yield side(head, 1, number - 1)
            last.append(b)
            have += b.num_rows
            while have - last[0].num_rows >= block:
                have -= last.pop(0).num_rows
        if have > block:
            last[0] = last[0].slice(have - block)
        for b in last:
            yield side(b, 0, number)

    def across(t: pa.Table) -> pa.Table:
        """Neighbours of the rows of one edge beyond it. Rows of other curves than those at the edge aren't neighbours."""
        curve, which = t.column("curve").to_numpy(), t.column("side").to_numpy()
        if which.min() == which.max():
            return pa.Table.from_batches([], near_schema)
        same = curve == curve[which == 0].max()  # curves ascend: the last one before the edge, the first one behind it
        if curve[which == 1].min() != curve[which == 0].max():
            return pa.Table.from_batches([], near_schema)
        ids, rows = [], []
        for s in (0, 1):
            part = t.filter(pa.array(same & (which == s)))
            ids.append(part.column("id").combine_chunks())
            rows.append(_matrix(part.column("q"), dim))
        return pa.Table.from_batches([best(rows[s], ids[1 - s], ids[s], rows[1 - s], None) for s in (0, 1)]).cast(near_schema)

    near_schema = pa.schema([("id", pa.string()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())])))])
    near_type = "id string, near array<struct<d double, id string>>"
    found = ordered.mapInArrow(windows, near_type)
    if parts > 1:
        beyond = ordered.mapInArrow(edges, "edge int, side int, curve int, id string, q binary").groupBy("edge").applyInArrow(across, near_type)
        found = found.unionByName(beyond)
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return merged.select("id", F.posexplode("near").alias("pos", "n")).select(
        "id", F.col("n.id").alias("neighbor"), (-F.col("n.d")).alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank")
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of images with a cosine of 0.92 or more, one among the 10 most similar of the other."""
    near = similar_vectors(read_table(spark, sf_dir, "store_rows"), "representative_image", "embedding", k=10, dim=64, min_similarity=0.92, version_col="indexed_at")
    return near.select(F.least("id", "neighbor").alias("image_a"), F.greatest("id", "neighbor").alias("image_b")).distinct()
