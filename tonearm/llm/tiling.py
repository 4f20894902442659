"""Evaluation passages inside a corpus, by greedy string tiling.

Texts become tokens that ignore case, punctuation, spacing, look-alike and invisible characters: words, or single
characters in scripts that write no blanks. A Karp-Rabin hash of every run of ``SEED`` tokens of a batch of
documents is looked up among those of the items; each document that shares a seed with an item is tiled against
it: the longest common run is marked first, then the longest of what is left, each token once on either side, so
reordered pieces count and repeated ones do not count twice. One changed word between two tiles is bridged. A
document is reported with an item if its tiles cover at least ``share`` of the item's characters.

Items are the stated query set. They are sent to the executors in blocks of at most ``BLOCK_CHARS`` characters, each a
broadcast whose index a Python worker builds once and keeps for its next tasks. With more items than one block holds,
the documents are scanned once per block and each block's answers are written before the next is read, so the driver
and the executors never hold more than one. There is no shuffle.

Defined cases: NULL or empty documents hold nothing; an item without tokens is in no document; an item shorter
than a seed must occur whole; equal documents are each reported, equal items each count; whole documents are read;
further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.lookalike import fold
from tonearm.session import durable

SEED = 4
SHARE = 0.5
BLOCK_CHARS = 4_000_000
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
TOKEN = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
#: In scripts of single-character tokens a seed of four tokens says little; their tiles need this many.
UNSPACED_TILE = 5
BASE = np.uint64(0x100000001B3)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(fold(text).casefold())


def rolling(ids: np.ndarray, k: int = SEED) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``k`` ids."""
    h = np.zeros(max(len(ids) - k + 1, 0), np.uint64)
    for i in range(k):
        h = h * BASE + ids[i : len(ids) - k + 1 + i].astype(np.uint64) + np.uint64(1)
    return h


class Items:
    """The items of one block: their tokens as numbers, and the hashes of their seeds."""

    def __init__(self, rows: Iterable[tuple[int, str | None]], k: int = SEED) -> None:
        self.k, self.vocabulary = k, {}
        self.ids, self.tokens, self.weights, self.least = [], [], [], []
        seeds = defaultdict(list)
        self.short = defaultdict(list)
        for item_id, text in rows:
            words = tokens(text or "")
            if not words:
                continue
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            n = len(self.ids)
            unspaced = sum(bool(re.match(f"[{UNSPACED}]", w)) for w in words) > len(words) / 2
            self.ids.append(item_id)
            self.tokens.append(own)
            self.weights.append(np.array([len(w) for w in words]))
            self.least.append(UNSPACED_TILE if unspaced else k)
            if len(own) < k:
                self.short[int(own[0])].append(n)
            for at, h in enumerate(rolling(own, k).tolist()):
                seeds[h].append((n, at))
        self.hashes = np.array(sorted(seeds), np.uint64)
        self.places = [seeds[h] for h in self.hashes.tolist()]

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in tokens(text)), np.int64)

    def leaks(self, texts: list[str], share: float = SHARE) -> Iterator[tuple[int, int, float]]:
        """(index into ``texts``, item id, covered share) of every pair that reaches ``share``."""
        coded = [self.encode(t) for t in texts]
        if not coded or not self.ids:
            return
        gap = np.zeros(self.k, np.int64)
        joined = np.concatenate([x for c in coded for x in (c, gap)])
        ends = np.cumsum([len(c) + self.k for c in coded])
        known = joined > 0
        runs = np.ones(max(len(joined) - self.k + 1, 0), bool)
        for i in range(self.k):
            runs &= known[i : len(runs) + i]
        at = np.flatnonzero(runs)
        hashes = rolling(joined, self.k)[at]
        found = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[found] == hashes if len(self.hashes) else np.zeros(len(at), bool)
        diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
        touched: dict[tuple[int, int], int] = defaultdict(int)
        seed = (1 << self.k) - 1
        starts = ends - np.array([len(c) + self.k for c in coded])
        docs = np.searchsorted(ends, at[hit], "right")
        for p, f, d in zip((at[hit] - starts[docs]).tolist(), found[hit].tolist(), docs.tolist()):
            for n, q in self.places[f]:
                diagonals[d, n].add(p - q)
                touched[d, n] |= seed << q
        for (d, n), offsets in diagonals.items():
            if self.most(touched[d, n], n) < share:
                continue
            covered = self.tile(coded[d], n, offsets)
            if covered >= share:
                yield d, self.ids[n], covered
        if self.short:
            for d, c in enumerate(coded):
                for p, token in enumerate(c.tolist()):
                    for n in self.short.get(token, ()):
                        own = self.tokens[n]
                        if np.array_equal(c[p : p + len(own)], own):
                            yield d, self.ids[n], 1.0

    def most(self, touched: int, n: int) -> float:
        """No tiling can cover a larger share: the tokens (one bit each) in any shared seed, and bridged ones."""
        size = len(self.tokens[n])
        touched |= (touched << 1) & (touched >> 1)
        bits = np.unpackbits(np.frombuffer(touched.to_bytes(size // 8 + 2, "little"), np.uint8), bitorder="little")
        return float(self.weights[n][bits[:size] > 0].sum() / self.weights[n].sum())

    def tile(self, doc: np.ndarray, n: int, offsets: set[int]) -> float:
        """Share of the characters of item ``n`` that tiles on the given diagonals (doc place - item place) cover."""
        own, weights, least = self.tokens[n], self.weights[n], self.least[n]
        matches = []
        for offset in offsets:
            lo, hi = max(0, -offset), min(len(own), len(doc) - offset)
            same = doc[lo + offset : hi + offset] == own[lo:hi]
            edges = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
            matches += [(b - a, lo + a, offset) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]
        marked_item, marked_doc = np.zeros(len(own), bool), np.zeros(len(doc), bool)
        tiles: list[tuple[int, int, int]] = []
        heap = [(-length, q, offset) for length, q, offset in matches]
        heapify(heap)
        while heap:
            length, q, offset = heappop(heap)
            length = -length
            free = ~(marked_item[q : q + length] | marked_doc[q + offset : q + offset + length])
            if free.all():
                marked_item[q : q + length] = marked_doc[q + offset : q + offset + length] = True
                tiles.append((q, q + length, offset))
                continue
            edges = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= least:
                    heappush(heap, (a - b, q + a, offset))
        tiles.sort()
        for (_, end, offset), (begin, _, following) in zip(tiles, tiles[1:]):
            if begin - end == 1 and abs(offset - following) <= 1:
                marked_item[end] = True
        return float(weights[marked_item].sum() / weights.sum())


_INDEX: dict[tuple, Items] = {}


def _index(rows, k: int, name: str) -> Items:
    """The index of a broadcast block, built once in each Python worker; the last one is kept."""
    if (name, k) not in _INDEX:
        _INDEX.clear()
        _INDEX[name, k] = Items(rows.value, k)
    return _INDEX[name, k]


def _scan(rows, share: float, k: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(rows, k, name)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            found = list(items.leaks([t or "" for t in batch.column("text").to_pylist()], share))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[d] for d, _, _ in found], pa.int64()),
                    pa.array([i for _, i, _ in found], pa.int64()),
                    pa.array([c for _, _, c in found], pa.float64()),
                ],
                names=["doc_id", "item_id", "covered"],
            )

    return run


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks whose texts have at most ``block_chars`` characters (one longer item is a block alone).

    The driver streams the query set, one partition at a time, and holds one block.
    """
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        length = len(row.text or "")
        if block and size + length > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += length
    if block:
        yield block


def leaked_items(
    documents: DataFrame, items: DataFrame, share: float = SHARE, seed: int = SEED, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, covered) of ``documents`` (doc_id long, text) against ``items`` (item_id long, text)."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    schema = "doc_id long, item_id long, covered double"
    spark, out, before = texts.sparkSession, None, None
    for block in item_blocks(items, block_chars):
        if before is not None:
            # A further block: what the one before it found is written, and the driver lets go of its items.
            before = durable(before)
            out = before if out is None else out.unionByName(before)
        before = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), share, seed), schema)
    if before is None:
        return spark.createDataFrame([], schema)
    return before if out is None else out.unionByName(before)
