"""Documents packed into containers of a fixed token capacity by length-histogram planning.

Lengths are counted per value; best fit in decreasing order runs over these counts on the driver (at most one entry
per length up to the capacity, however many documents there are) and yields runs of slots: the documents of one
length with ranks ``first_rank``..``first_rank + n - 1`` go to consecutive containers. Documents then take their
slots by joining on their rank within their length. The rank is counted in shards by a hash of the document, with
the shards' offsets added, so a length that a third of all documents share is not sorted in one task.

Defined cases: a NULL or empty text has no tokens, takes no room and stands in container 0; only a text longer
than the capacity is split, into full pieces and one rest; equal lengths take slots in the order of hash shard,
doc_id and piece; repeated rows are packed each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import durable

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The public pattern that cuts text into pieces before byte-level merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A length is ranked in at least ``SHARDS`` parts, and in as many as keep a part within ``SHARD_ROWS`` documents.
SHARDS, SHARD_ROWS = 64, 1_000_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of one vocabulary file, read once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of ``documents`` (doc_id long, text)."""
    return documents.select("doc_id", "text").mapInArrow(count_tokens(tokenizer), "doc_id long, tokens long")


def plan_slots(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first_rank, n, first_container, per_container) of best fit decreasing over counts."""
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, count))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for per, bins in ((each, left // each), (left % each, 1)):
                    if per and bins:
                        runs.append((length, rank, per * bins, opened, per))
                        leave(capacity - per * length, opened, bins)
                        opened, rank = opened + bins, rank + per * bins
                break
            space = rooms[at]
            first, count = room[space].pop()
            if not room[space]:
                del room[space], rooms[at]
            used = min(left, count)
            runs.append((length, rank, used, first, 1))
            leave(space - length, first, used)
            leave(space, first + used, count - used)
            left, rank = left - used, rank + used
    return runs


def pack(lengths: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """(container, doc_id, piece, first_token, n_tokens) of ``lengths`` (doc_id long, tokens long)."""
    spark = lengths.sparkSession
    whole = F.floor(F.col("tokens") / capacity)
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    pieces = durable(
        lengths.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
            "doc_id",
            "piece",
            F.when(F.col("piece") < whole, F.lit(capacity)).otherwise(F.col("tokens") % capacity).cast("long").alias("n_tokens"),
        )
    )
    shards = shards or max(SHARDS, -(-pieces.count() // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    counts = durable(pieces.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("n")))
    # At most capacity + 1 rows reach the driver, whatever the number of documents.
    histogram = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_slots(histogram, capacity),
        "length long, first_rank long, n_slots long, first_container long, per_container long",
    )
    before = Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("in_shard", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "shard"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("in_shard"))
    # The plan has a few runs per length; lengths go up to the capacity, so its size is bounded.
    fits = (F.col("length") == F.col("n_tokens")) & (F.col("rank") >= F.col("first_rank")) & (
        F.col("rank") < F.col("first_rank") + F.col("n_slots")
    )
    placed = ranked.join(F.broadcast(slots), fits, "left")
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_container"))
    return placed.select(
        F.coalesce(container, F.lit(0)).cast("long").alias("container"),
        "doc_id",
        "piece",
        (F.col("piece") * capacity).cast("long").alias("first_token"),
        "n_tokens",
    )


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the fewest possible for the tokens, and the share of room left empty."""
    total = packed.agg(
        (F.max(F.when(F.col("n_tokens") > 0, F.col("container"))) + 1).alias("top"), F.sum("n_tokens").alias("tokens")
    )
    filled = total.select(F.coalesce("top", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return filled.select(
        "containers",
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        "tokens",
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("empty_share"),
    )
