"""Matching records by nearest time with a learned index.

Both sides are cut into pieces: one entity within one stretch of time. A right-hand row within the tolerance of its
stretch's edge is copied to the neighbouring stretch, so every piece holds all rows its left-hand rows can match,
and a hot entity is spread over its stretches. Hashes gather the pieces into shards. Inside a shard the right-hand rows are one sorted array of
64-bit positions (piece rank, second); a piecewise linear model, split until no prediction is off by more than
``MAX_ERROR`` places, predicts where a left-hand time belongs, and a binary search within that error finds the
exact neighbours.

Defined cases: a row with a NULL or empty entity or a NULL time matches nothing; the tolerance is inclusive; of
equally near rows the smallest right-hand id wins; a right-hand row may serve several left-hand rows; repeated
rows each get their answer; empty tables give empty results; left-hand rows without a partner come out with a
NULL right-hand id where ``keep_unmatched`` asks for them; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ERROR = 32
#: Length of a stretch of time in seconds: one entity's rows within it are the least that one task can hold.
STRETCH = 86_400
#: One task matches about so many rows, held in arrays.
SHARD_ROWS = 2_000_000


class LearnedIndex:
    """Predicts the place of a key in a sorted array, at most ``max_error`` places off."""

    def __init__(self, keys: np.ndarray, max_error: int = MAX_ERROR) -> None:
        self.keys, self.max_error = keys, max_error
        n = len(keys)
        cuts = np.array([0, n - 1]) if n > 1 else np.array([0] * min(n, 1))
        while len(cuts) > 1:
            places = np.arange(n)
            segment = np.clip(np.searchsorted(cuts, places, "right") - 1, 0, len(cuts) - 2)
            error = np.abs(self._line(keys, cuts, segment) - places)
            worst = np.maximum.reduceat(error, cuts[:-1])
            wide = (worst > max_error - 2) & (np.diff(cuts) > 1)
            if not wide.any():
                break
            cuts = np.union1d(cuts, (cuts[:-1][wide] + cuts[1:][wide]) // 2)
        self.cuts = cuts

    def _line(self, x: np.ndarray, cuts: np.ndarray, segment: np.ndarray) -> np.ndarray:
        lo, hi = cuts[segment], cuts[segment + 1]
        span = np.maximum(self.keys[hi] - self.keys[lo], 1)
        return lo + (x - self.keys[lo]) / span * (hi - lo)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(self.cuts) < 2:
            return np.zeros(len(x))
        segment = np.clip(np.searchsorted(self.keys[self.cuts], x, "right") - 1, 0, len(self.cuts) - 2)
        x = np.clip(x, self.keys[self.cuts[segment]], self.keys[self.cuts[segment + 1]])
        return self._line(x, self.cuts, segment)

    def place(self, x: np.ndarray) -> np.ndarray:
        """How many keys are smaller than each of ``x``: a binary search around the prediction.

        Runs of equal keys can exceed the error, so a window that does not enclose the answer is doubled.
        """
        n = len(self.keys)
        if not n:
            return np.zeros(len(x), np.int64)
        at = self.predict(x).astype(np.int64)
        width = self.max_error
        lo, hi = np.maximum(at - width, 0), np.minimum(at + width, n)
        while True:
            low = (lo > 0) & (self.keys[np.maximum(lo - 1, 0)] >= x)
            high = (hi < n) & (self.keys[np.minimum(hi, n - 1)] < x)
            if not (low.any() or high.any()):
                break
            width *= 2
            lo, hi = np.where(low, np.maximum(lo - width, 0), lo), np.where(high, np.minimum(hi + width, n), hi)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = self.keys[np.minimum(mid, n - 1)] < x
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


def nearest(
    left_entity: np.ndarray,
    left_time: np.ndarray,
    right_entity: np.ndarray,
    right_time: np.ndarray,
    right_id: np.ndarray,
    tolerance: int,
) -> np.ndarray:
    """Index into the right-hand rows of the nearest one of each left-hand row, or -1."""
    if not len(left_time) or not len(right_time):
        return np.full(len(left_time), -1, np.int64)
    start = min(left_time.min(), right_time.min())
    span = int(max(left_time.max(), right_time.max()) - start) + 2 * tolerance + 2
    names = np.unique(right_entity)
    rank = np.minimum(np.searchsorted(names, left_entity), len(names) - 1)
    known = names[rank] == left_entity
    keys = np.searchsorted(names, right_entity) * span + (right_time - start) + tolerance + 1
    order = np.lexsort((right_id, keys))
    keys, ids = keys[order], right_id[order]
    index = LearnedIndex(keys)
    want = rank * span + (left_time - start) + tolerance + 1
    after = index.place(want)
    # Of equal keys the first has the smallest id: both neighbours are taken at the start of their run.
    run_start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = np.repeat(run_start, np.diff(np.r_[run_start, len(keys)]))
    before = np.where(after > 0, first[np.maximum(after - 1, 0)], 0)
    far = np.int64(2**62)
    gap_before = np.where(after > 0, want - keys[before], far)
    here = np.minimum(after, len(keys) - 1)
    gap_after = np.where(after < len(keys), keys[here] - want, far)
    take_after = (gap_after < gap_before) | ((gap_after == gap_before) & (ids[here] < ids[before]))
    best, gap = np.where(take_after, here, before), np.minimum(gap_before, gap_after)
    return np.where(known & (gap <= tolerance), order[best], -1)


def _pieces(table: pa.Table, other: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    both = pa.concat_arrays([c for t in (table, other) for c in t.column("entity").chunks] or [pa.array([], pa.string())])
    codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    slots = np.concatenate([t.column("slot").to_numpy() for t in (table, other)])
    if len(slots):
        codes = codes * (int(slots.max() - slots.min()) + 1) + slots - slots.min()
    return codes[: table.num_rows], codes[table.num_rows :]


def _match(tolerance: int, keep_unmatched: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        le, re = _pieces(left, right)
        ids = right.column("id").to_numpy()
        at = nearest(le, left.column("t").to_numpy(), re, right.column("t").to_numpy(), ids, tolerance)
        hit = at >= 0
        chosen = pa.array(ids[np.maximum(at, 0)] if len(ids) else np.zeros(len(at), np.int64), mask=~hit)
        out = pa.table({"left_id": left.column("id"), "right_id": chosen})
        return out if keep_unmatched else out.filter(pa.array(hit))

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    tolerance: int,
    keep_unmatched: bool = False,
    stretch: int = STRETCH,
    shards: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(left_id, right_id) from two tables (id long, entity string, t long seconds).

    ``stretch`` bounds how much of one entity meets in one task; ``shards`` is the number of groups the pieces are
    gathered into, by default twice the shuffle partitions, or, where the caller knows that the two tables hold about
    ``rows`` rows, as many as hold ``SHARD_ROWS`` of them each.
    """
    stretch = max(stretch, 2 * tolerance + 1)
    least = 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(least, (rows or 0) // SHARD_ROWS)
    usable = F.col("entity").isNotNull() & (F.col("entity") != "") & F.col("t").isNotNull() & F.col("id").isNotNull()
    slot = lambda t: F.floor(t / F.lit(stretch))
    shard = F.pmod(F.xxhash64("entity", "slot"), F.lit(shards)).alias("shard")
    near = F.array_distinct(F.array(slot(F.col("t") - tolerance), slot(F.col("t")), slot(F.col("t") + tolerance)))
    left_side = left.where(usable).select("id", "entity", "t", slot(F.col("t")).alias("slot")).select("*", shard)
    right_side = right.where(usable).select("id", "entity", "t", F.explode(near).alias("slot")).select("*", shard)
    found = (
        left_side.groupBy("shard")
        .cogroup(right_side.groupBy("shard"))
        .applyInArrow(_match(tolerance, keep_unmatched), "left_id long, right_id long")
    )
    if keep_unmatched:
        lost = left.where(F.col("id").isNotNull() & ~F.coalesce(usable, F.lit(False)))
        found = found.unionByName(lost.select(F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_id")))
    return found
