"""Most frequent values of a column in bounded memory, by code-based identification.

Every value is a 64-bit fingerprint. A salted hash sends it to one of ``groups`` groups; its eight bytes are
written as a codeword of twelve symbols: after every second byte stands a check symbol that depends on all bytes
so far. Each task counts, per group, position and symbol, how often it was seen: ``groups * 12 * 256`` counters
per column, whatever the number of distinct values. A symbol that a frequent value uses is counted on each of its
occurrences, so in the summed counters every symbol of a value with at least ``share`` of the rows reaches that
share: no frequent value can be missed. Decoding walks the positions of a group, extends each prefix by the
symbols that are heavy there, and drops prefixes whose check symbol is not heavy; a false combination passes a
check with a chance of about (heavy symbols / 256). The few fingerprints left (at most a few per group that is
heavy at all) select rows in a second scan, which counts the values themselves exactly.

Defined cases: NULL and the empty string are no values, but their rows count in the number of rows; values are
compared exactly as stored; two values with one fingerprint are told apart by the exact count; ties all come
out; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.session import durable
from tonearm.sources.tables import present

GROUPS = 512
BLOCKS = 16
#: Where the check symbols stand: codeword positions 2, 5, 8 and 11; the others hold the bytes in order.
POSITIONS = 12


def codewords(keys: np.ndarray) -> np.ndarray:
    """(n, 12) symbols of unsigned 64-bit fingerprints."""
    out = np.empty((len(keys), POSITIONS), np.uint8)
    state = np.full(len(keys), 0x9E3779B97F4A7C15, np.uint64)
    position = 0
    for i in range(8):
        byte = (keys >> np.uint64(8 * i)) & np.uint64(255)
        out[:, position] = byte
        state = step(state, byte)
        position += 1
        if i % 2:
            out[:, position] = check_symbol(state)
            position += 1
    return out


def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    mixed = (state ^ (byte + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def check_symbol(state: np.ndarray) -> np.ndarray:
    return (state >> np.uint64(40)) & np.uint64(255)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def count_symbols(counters: np.ndarray, keys: np.ndarray) -> None:
    """Add the codewords of ``keys`` to counters of shape (groups, 12, 256); equal keys are counted once each."""
    unique, times = np.unique(keys, return_counts=True)
    words, groups = codewords(unique), group_of(unique, counters.shape[0])
    for p in range(POSITIONS):
        flat = groups * 256 + words[:, p]
        counters[:, p, :] += np.bincount(flat, times, minlength=counters.shape[0] * 256).reshape(-1, 256).astype(np.int64)


def decode(counters: np.ndarray, least: float) -> np.ndarray:
    """Fingerprints all of whose symbols reach ``least`` in one group of ``counters``."""
    found = [np.empty(0, np.uint64)]
    for group in np.flatnonzero((counters >= least).any(axis=2).all(axis=1)):
        heavy = counters[group] >= least
        keys, state = np.zeros(1, np.uint64), np.full(1, 0x9E3779B97F4A7C15, np.uint64)
        position = 0
        for i in range(8):
            symbols = np.flatnonzero(heavy[position]).astype(np.uint64)
            keys = (keys[:, None] | (symbols << np.uint64(8 * i))).ravel()
            state = step(np.repeat(state, len(symbols)), np.tile(symbols, len(state)))
            position += 1
            if i % 2:
                passed = heavy[position][check_symbol(state).astype(np.int64)]
                keys, state = keys[passed], state[passed]
                position += 1
        found.append(keys)
    return np.concatenate(found)


def _sketch(fields: Sequence[str], groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((len(fields), groups, POSITIONS, 256), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for f, field in enumerate(fields):
                column = batch.column(field).drop_null()
                count_symbols(counters[f], column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        if rows:
            size = groups // BLOCKS
            out = [
                (field, b, rows, zlib.compress(counters[f, b * size : (b + 1) * size].tobytes(), 1))
                for f, field in enumerate(fields)
                for b in range(BLOCKS)
            ]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=["field", "block", "n_rows", "counters"]), preserve_index=False
            )

    return run


def _merge(share: float, groups: int):
    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((groups // BLOCKS, POSITIONS, 256), np.int64), 0
        for batch in parts:
            for n, blob in zip(batch.column("n_rows").to_pylist(), batch.column("counters")):
                total += np.frombuffer(zlib.decompress(blob.as_py()), np.int64).reshape(total.shape)
                rows += n
        keys = decode(total, share * rows).view(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"field": [key[0].as_py()] * len(keys), "key": keys, "n_rows": [rows] * len(keys)},
            schema=pa.schema([("field", pa.string()), ("key", pa.int64()), ("n_rows", pa.int64())]),
        )

    return run


def candidates(table: DataFrame, fields: Sequence[str], share: float, groups: int = GROUPS) -> DataFrame:
    """(field, key, n_rows): the decoded fingerprints, and the number of rows of ``table``."""
    keys = table.select(*[F.when(present(f), F.xxhash64(f)).alias(f) for f in fields])
    sketch = keys.mapInArrow(_sketch(fields, groups), "field string, block long, n_rows long, counters binary")
    return sketch.groupBy("field", "block").applyInArrow(_merge(share, groups), "field string, key long, n_rows long")


def heavy_hitters(table: DataFrame, fields: Sequence[str], share: float = 0.01, groups: int = GROUPS) -> DataFrame:
    """(field, value, n, n_rows): every value held by at least ``share`` of the rows, with its exact count."""
    few = durable(candidates(table, fields, share, groups))
    cells = table.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")
    ).select("c.field", "c.value", F.xxhash64("c.value").alias("key"))
    # At most 1/share fingerprints reach the share in each position of a column, so the candidates are few.
    counted = (
        cells.where(present("value"))
        .join(F.broadcast(few), ["field", "key"])
        .groupBy("field", "value", "n_rows")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.where(F.col("n") >= F.lit(share) * F.col("n_rows")).select("field", "value", "n", "n_rows")
