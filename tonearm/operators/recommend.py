"""Seeds, merged recommendations, their snapshots, and exact nearest vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import durable
from tonearm.sources.tables import present


def seeds(sources: list[tuple[DataFrame, float]], limit: int) -> DataFrame:
    """(artist, weight) of the best seeds from (artist, n) sources and their weights; case-blind, first spelling kept."""
    parts = [df.select("artist", (F.col("n") * F.lit(w)).alias("w"), F.lit(i).alias("source")) for i, (df, w) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, parts).where(present(F.trim("artist")))
    grouped = every.groupBy(F.lower(F.trim("artist")).alias("key")).agg(
        F.sum("w").alias("weight"), F.min(F.struct("source", (-F.col("w")).alias("o"), "artist")).alias("first")
    )
    return grouped.select(F.col("first.artist").alias("artist"), "weight").orderBy(F.col("weight").desc(), "artist").limit(limit)


def _total(score: Column) -> Column:
    """The sum of the scores as decimals: it does not depend on the order of the rows, so equal totals tie exactly."""
    return F.sum(score.cast("decimal(28,12)")).cast("double")


def from_similar(seed: DataFrame, similar: DataFrame) -> DataFrame:
    """(artist, score, seed): similarity times seed weight, summed; the strongest seed is kept."""
    met = similar.join(seed.select(F.col("artist").alias("seed"), "weight"), "seed").where(present("artist"))
    return met.groupBy(F.lower("artist").alias("key")).agg(
        _total(F.col("match") * F.col("weight")).alias("score"),
        F.max(F.struct("weight", "seed")).alias("s"),
        F.min("artist").alias("artist"),
    ).select("artist", "score", F.col("s.seed").alias("seed"))


def merge(sources: list[DataFrame], excluded: DataFrame, limit: int | None) -> DataFrame:
    """Sources of (artist, score, mbid, source) merged by name: scores add up, the first identifier is kept.

    Without a ``limit`` every artist is kept, in no order.
    """
    every = reduce(DataFrame.unionByName, sources).withColumn("key", F.lower(F.trim("artist")))
    merged = every.groupBy("key").agg(
        _total(F.col("score")).alias("score"), F.min("artist").alias("artist"),
        F.min(F.nullif("mbid", F.lit(""))).alias("mbid"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    away = excluded.select(F.lower(F.trim("artist")).alias("key")).distinct()
    left = merged.join(away, "key", "left_anti").drop("key")
    return left.orderBy(F.col("score").desc(), "artist").limit(limit) if limit is not None else left


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(query, near, distance, rank): exact k nearest vectors by Euclidean distance, in blocks of queries.

    ``queries`` is a stated set. The driver streams it and sends one block at a time to the executors; each task
    compares its rows with the block by matrix products and gives its own best ``k`` per query once, at its end. With
    several blocks the answers of each are written before the next is read.
    """
    found, rows = None, []
    local = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
    asked = queries.select("id", "embedding").where(F.col("embedding").isNotNull())

    def answer(rows: list) -> DataFrame:
        sent = local.sparkSession.sparkContext.broadcast([(r["id"], list(r["embedding"])) for r in rows])
        best = local.mapInArrow(_best_of_task(sent, k), "query long, near long, distance double")
        order = Window.partitionBy("query").orderBy("distance", "near")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    for row in asked.toLocalIterator():
        if len(rows) == block:
            part = durable(answer(rows))
            found, rows = part if found is None else found.unionByName(part), []
        rows.append(row)
    last = answer(rows)
    return last if found is None else found.unionByName(last)


def _best_of_task(sent, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = sent.value
        if not asked:
            return
        ids = np.array([i for i, _ in asked], np.int64)
        matrix = np.array([v for _, v in asked], np.float64)
        near, far = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column("embedding").to_pylist(), np.float64)
            other = np.broadcast_to(np.array(batch.column("id").to_pylist(), np.int64), (len(ids), len(own)))
            squares = (matrix**2).sum(1)[:, None] + (own**2).sum(1)[None, :] - 2 * matrix @ own.T
            squares = np.where(other == ids[:, None], np.inf, squares)
            near, far = np.concatenate([near, other], 1), np.concatenate([far, squares], 1)
            if near.shape[1] > k:
                kept = np.lexsort((near, far), axis=1)[:, :k]
                near, far = np.take_along_axis(near, kept, 1), np.take_along_axis(far, kept, 1)
        rows, columns = np.nonzero(np.isfinite(far))
        distance = np.sqrt(np.maximum(far[rows, columns], 0))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(near[rows, columns]), pa.array(distance)], names=["query", "near", "distance"])

    return run


def from_recordings(recordings: DataFrame, artists: DataFrame, scale: float = 100.0) -> DataFrame:
    """(artist, score, mbid) from recommended recordings (recording, score) and their artists (recording, mbid, name)."""
    met = artists.join(recordings.groupBy("recording").agg(F.max("score").alias("score")), "recording")
    return met.groupBy("mbid").agg(F.min("name").alias("artist"), (F.sum("score") * scale).alias("score")).select("artist", "score", "mbid")


def best_candidates(candidates: DataFrame, least_score: int = 85) -> DataFrame:
    """(artist, found): the identifier of each looked-up name's best candidate, if its score is high enough.

    ``candidates`` is (query, pos, mbid, score) in the order in which the lookup gave them.
    """
    first = candidates.groupBy("query").agg(F.min(F.struct("pos", "mbid", "score")).alias("x"))
    return first.where(F.col("x.score") >= least_score).select(F.col("query").alias("artist"), F.col("x.mbid").alias("found"))


def recommend(
    merged: DataFrame, candidates: DataFrame, owned: DataFrame, ignored_names: DataFrame, ignored_ids: DataFrame, limit: int
) -> DataFrame:
    """(artist, score, mbid) of the best merged recommendations (artist, score, mbid) that are not owned or ignored.

    Names are compared by the normaliser. An identifier that no source gave comes from the looked-up ``candidates``;
    one that is in ``ignored_ids`` (mbid) drops the artist, a missing one does not.
    """
    from tonearm.operators import matching

    norm = durable(matching.norms(merged.select("artist"), owned.select("artist"), ignored_names.select("artist")))
    named = lambda df: matching.with_norm(df, F.col("artist"), "a", norm).where(present("a"))
    away = named(owned.select("artist").unionByName(ignored_names.select("artist"))).select("a").distinct()
    left = named(merged).join(away, "a", "left_anti").join(best_candidates(candidates), "artist", "left")
    known = left.withColumn("mbid", F.coalesce(F.nullif("mbid", F.lit("")), "found"))
    # An anti join keeps rows without identifier, as it must.
    kept = known.join(ignored_ids.select("mbid").where(present("mbid")).distinct(), "mbid", "left_anti")
    return kept.select("artist", "score", "mbid").orderBy(F.col("score").desc(), "artist").limit(limit)


SNAPSHOT = "array<struct<artist:string,score:double,mbid:string>>"


def saved(recommendations: DataFrame, at: str) -> DataFrame:
    """(generated_at, payload): a snapshot of a short ranked list, as JSON."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "artist", "score", "mbid")))
    listed = F.transform(rows, lambda x: F.struct(x["artist"].alias("artist"), x["score"].alias("score"), x["mbid"].alias("mbid")))
    return recommendations.agg(F.to_json(listed).alias("payload")).select(F.lit(at).alias("generated_at"), "payload")


def loaded(snapshot: DataFrame) -> DataFrame:
    """(generated_at, artist, score, mbid) of a snapshot; one that is no JSON gives nothing."""
    rows = snapshot.select("generated_at", F.from_json("payload", SNAPSHOT).alias("rows")).where(F.col("rows").isNotNull())
    return rows.select("generated_at", F.inline("rows"))


def removed(snapshot: DataFrame, mbid: str | None, name: str) -> DataFrame:
    """The snapshot without an artist: by identifier, or by name, whatever its case, if there is none."""
    gone = (lambda x: F.coalesce(x["mbid"], F.lit("")) == mbid) if mbid else (lambda x: F.lower(F.trim(x["artist"])) == name.strip().lower())
    rows = F.filter(F.from_json("payload", SNAPSHOT), lambda x: ~gone(x))
    return snapshot.select("generated_at", F.to_json(rows).alias("payload"))


def ignore(ignored: DataFrame, mbid: str | None, name: str) -> DataFrame:
    """(kind, value) of ignored identifiers and names with one artist added; each is listed once."""
    rows = [("mbid", mbid)] * bool(mbid) + [("name", name.strip().lower())] * bool(name.strip())
    return ignored.unionByName(ignored.sparkSession.createDataFrame(rows, "kind string, value string")).distinct()
