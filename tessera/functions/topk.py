"""The best rows of many queries, kept by a task while its rows pass by in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
QUERY_ROWS = 1024  # queries that meet a batch of rows at a time
CANDIDATES = 2_000_000  # results of single tasks, over all tasks, that one pass should shuffle
RESULTS = 1_000_000  # results that a task holds


def layout(n: int, k: int, cores: int) -> tuple[int, int]:
    """Into how many groups ``n`` queries go, and the tasks over the rows of each group.

    A task sends its best ``k`` of each query on, so what is shuffled is queries x ``k`` x tasks. Few queries have a task
    for each part of the rows; of many, groups run beside each other instead, each over fewer and longer parts. Of still
    more, each core has several groups one after the other, so that no task holds more than :data:`RESULTS`.
    The first group should have two tasks at least: Spark 4.1 makes one task of a union of single partitions only.
    """
    tasks = max(1, CANDIDATES // max(1, n * k))
    groups = -(-cores // tasks)
    groups *= max(1, -(-n * k // (groups * RESULTS)))
    return (max(1, min(n, groups)), tasks)


def small_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class Best:
    """The best ``k`` rows of each of ``n`` queries, by score, then overlap, then id.

    Rows equal to the last one but for their id may stay beyond ``k``, up to twice as many; the caller chooses by id.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.full(n, -np.inf)  # rows with a lower score are not among the best
        self.found = (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))  # query, score, overlap, place in ids
        self.new: list[tuple] = []
        self.size = self.start = self.held = self.settled = self.batches = 0
        self.ids: list[pa.Array] = []

    def begin(self, ids: pa.Array) -> None:
        """The ids of the next batch of rows."""
        self.batches += 1
        if self.size > self.n * self.k // 2 or self.held - self.settled > 100_000 or self.batches & (self.batches - 1) == 0:
            self.settle()
        self.ids.append(ids)
        self.start, self.held = self.held, self.held + len(ids)

    def scan(self, near: np.ndarray, first: int, slack: np.ndarray, floor: float, exact: Callable) -> None:
        """Take what may be among the best of a batch.

        ``near`` has the approximate scores of the queries from ``first`` on, off by no more than ``slack`` (of each
        query of the task); those under ``floor`` don't count. ``exact`` gives scores and overlaps of pairs of
        query and row of the batch.
        """
        for i in range(0, len(near), 256):
            part = near[i : i + 256]
            own = slice(first + i, first + i + len(part))
            least = self.least[own].copy()
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and part.shape[1] > self.k:  # of one batch no more than k are wanted
                least[fresh] = np.partition(part[fresh], -self.k, axis=1)[:, -self.k]
            bound = np.maximum(least - 2 * slack[own], floor).astype(np.float32)
            q, row = np.nonzero(part >= bound[:, None])
            for j in range(0, len(q), 50_000):
                q_, row_ = q[j : j + 50_000] + (first + i), row[j : j + 50_000]
                score, overlap = exact(q_, row_)
                good = score >= self.least[q_]
                self.new.append((q_[good].astype(np.int32), score[good], overlap[good].astype(np.int32), row_[good] + self.start))
                self.size += int(good.sum())
                if self.size > max(2 * self.n * self.k, 500_000):
                    self._merge()

    def _merge(self) -> None:
        if not self.new:
            return
        query, score, overlap, place = (np.concatenate(x) for x in zip(self.found, *self.new))
        self.new, self.size = [], 0
        order = np.lexsort((-overlap, -score, query))
        query, score, overlap, place = query[order], score[order], overlap[order], place[order]
        start = np.searchsorted(query, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(start) >= self.k)
        last = start[full] + self.k - 1
        edge = np.full(self.n, -1)
        self.least[full], edge[full] = score[last], overlap[last]
        keep = (score > self.least[query]) | ((score == self.least[query]) & (overlap >= edge[query]))
        names = None
        for r in np.flatnonzero(np.bincount(query[keep], minlength=self.n) > 2 * self.k):
            own = np.arange(start[r], start[r + 1])
            tied = own[(score[own] == self.least[r]) & (overlap[own] == edge[r])]
            names = pa.chunked_array(self.ids).combine_chunks() if names is None else names
            need = self.k - (tied[0] - start[r])
            keep[tied] = False
            keep[tied[pc.sort_indices(names.take(pa.array(place[tied]))).to_numpy()[:need]]] = True
        self.found = query[keep], score[keep], overlap[keep], place[keep]

    def settle(self) -> None:
        """Merge, and forget the ids of other rows."""
        self._merge()
        if self.ids:
            used, place = np.unique(self.found[3], return_inverse=True)
            kept = pa.chunked_array(self.ids).take(pa.array(used)).combine_chunks()
            self.ids, self.held, self.settled = [kept], len(kept), len(kept)
            self.found = (*self.found[:3], place.astype(np.int64))

    def batches_of(self, q_ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The results as (query, id, score, overlap), or as many of these columns as there are names."""
        self.settle()
        query, score, overlap, place = self.found
        for at in range(0, len(query), 20_000):
            cut = slice(at, at + 20_000)
            columns = [q_ids.take(pa.array(query[cut])), self.ids[0].take(pa.array(place[cut])), pa.array(score[cut]), pa.array(overlap[cut].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)
