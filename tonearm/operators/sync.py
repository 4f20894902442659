"""Upserts, state transitions and the ordered suppression of near-duplicate plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.sources.tables import present

PLAY_KEY = ["lastfm_user", "played_at", "artist", "title"]


def insert_ignore(existing: DataFrame, arrivals: DataFrame, keys: Sequence[str] = PLAY_KEY, order: Sequence = ("id",)) -> DataFrame:
    """The arrivals to append: the first of each key, and none whose key exists already."""
    fresh = arrivals.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    first = Window.partitionBy(*keys).orderBy(*order)
    return fresh.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").select(*arrivals.columns)


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """One row per key: the one with the greatest ``newest``; a change wins a tie with an existing row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_new")


def purge(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def purge_stale(cache: DataFrame, resolved: str, now: Column, days: int) -> DataFrame:
    """Without negative entries older than ``days``; zero or less keeps all."""
    if days <= 0:
        return cache
    old = F.col("target_id").isNull() & (F.col(resolved) < now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return cache.where(~F.coalesce(old, F.lit(False)))


def prepare_pending(plays: DataFrame, sync: DataFrame, target: str) -> DataFrame:
    """(scrobble_id, target, status): pending rows for plays that have none for the target."""
    own = sync.where(F.col("target") == target).select(F.col("scrobble_id").alias("id"))
    return plays.select("id").join(own, "id", "left_anti").select(
        F.col("id").alias("scrobble_id"), F.lit(target).alias("target"), F.lit("pending").alias("status")
    )


def pending(plays: DataFrame, sync: DataFrame, target: str) -> DataFrame:
    """Plays whose sync row for the target is missing or pending."""
    own = sync.where(F.col("target") == target).select(F.col("scrobble_id").alias("id"), "status")
    joined = plays.join(own, "id", "left")
    return joined.where(F.col("status").isNull() | (F.col("status") == "pending"))


def reset(sync: DataFrame, target: str, condition: Column) -> DataFrame:
    """Sync rows of the target that meet the condition become pending and lose their target and strategy."""
    hit = (F.col("target") == target) & (F.col("status") != "pending") & condition
    void = lambda c: F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c)
    changed = {"status": F.when(hit, "pending").otherwise(F.col("status")).alias("status"), "target_id": void("target_id"), "strategy": void("strategy")}
    return sync.select(*[changed.get(c, F.col(c)) for c in sync.columns])


def mark_loved(plays: DataFrame, loved: DataFrame) -> DataFrame:
    """``plays`` with ``loved`` set for each loved (artist, title, mbid) of the same user.

    A loved track with an identifier that some play carries marks by identifier; any other by artist and title,
    whatever their case.
    """
    loved = loved.select(F.monotonically_increasing_id().alias("_n"), "lastfm_user", "artist", "title", "mbid_track")
    ids = plays.where(present("mbid_track")).select("lastfm_user", "mbid_track").distinct()
    by_id = loved.where(present("mbid_track")).join(ids, ["lastfm_user", "mbid_track"])
    by_name = loved.join(by_id.select("_n"), "_n", "left_anti")
    name = lambda df: df.select("lastfm_user", F.lower("artist").alias("_a"), F.lower("title").alias("_t")).distinct()
    keyed = plays.withColumn("_a", F.lower("artist")).withColumn("_t", F.lower("title"))
    # Most plays have no identifier: they are spread over the tasks.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("artist", "title"), F.lit(997)).cast("string"))
    keyed = keyed.withColumn("_m", F.when(present("mbid_track"), F.col("mbid_track")).otherwise(spread))
    known = by_id.select("lastfm_user", F.col("mbid_track").alias("_m")).distinct().withColumn("_i", F.lit(True))
    keyed = keyed.join(known, ["lastfm_user", "_m"], "left").drop("_m")
    keyed = keyed.join(name(by_name).withColumn("_m", F.lit(True)), ["lastfm_user", "_a", "_t"], "left")
    now = F.col("loved") | F.coalesce("_i", F.lit(False)) | F.coalesce("_m", F.lit(False))
    return keyed.withColumn("loved", now).select(*plays.columns)


def reconcile(annotation: DataFrame, plays: DataFrame) -> DataFrame:
    """Annotations of tracks with play_count and play_date taken from the plays; missing ones are added.

    ``plays`` is (user_id, media_file_id, ts); keys without plays keep what they have.
    """
    counted = plays.where(present("media_file_id")).groupBy("user_id", F.col("media_file_id").alias("item_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("ts").alias("last")
    )
    tracks = annotation.where(F.col("item_type") == "media_file")
    both = tracks.join(counted, ["user_id", "item_id"], "full")
    return both.select(
        "user_id", "item_id", F.lit("media_file").alias("item_type"),
        F.coalesce("n", "play_count").alias("play_count"), F.coalesce("last", "play_date").alias("play_date"),
        F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("starred", F.lit(False)).alias("starred"), "starred_at",
    )


def add_stars(annotation: DataFrame, stars: DataFrame, now: Column) -> DataFrame:
    """Stars of (user_id, item_id) added; an annotation that has a star keeps its time."""
    tracks = annotation.where(F.col("item_type") == "media_file")
    both = tracks.join(stars.select("user_id", "item_id").distinct().withColumn("_s", F.lit(True)), ["user_id", "item_id"], "full")
    promoted = F.col("_s") & ~F.coalesce("starred", F.lit(False))
    return both.select(
        "user_id", "item_id", F.lit("media_file").alias("item_type"), "play_count", "play_date", "rating",
        (F.coalesce("starred", F.lit(False)) | F.coalesce("_s", F.lit(False))).alias("starred"),
        F.when(promoted, F.coalesce("starred_at", now)).otherwise(F.col("starred_at")).alias("starred_at"),
    )


def pull_loves(loved: DataFrame, by_id: DataFrame, by_couple: DataFrame) -> DataFrame:
    """(artist, title, mbid, item_id) of loved tracks: the track of the identifier, or else of the couple.

    ``by_id`` is (mbid, item_id) and ``by_couple`` (artist, title, item_id), as the cascade's stages answer.
    """
    first = by_id.select("mbid", F.col("item_id").alias("_i"))
    second = by_couple.select("artist", "title", F.col("item_id").alias("_c"))
    met = loved.join(first, "mbid", "left").join(second, ["artist", "title"], "left")
    return met.select("artist", "title", "mbid", F.coalesce("_i", "_c").alias("item_id"))


def loves_to_push(starred: DataFrame, loved: DataFrame) -> DataFrame:
    """(artist, title) of starred tracks that are not loved yet, each couple once; names and case as first written."""
    keyed = lambda df: df.select(F.trim("artist").alias("artist"), F.trim("title").alias("title")).where(present("artist") & present("title"))
    key = lambda df: keyed(df).withColumn("_a", F.lower("artist")).withColumn("_t", F.lower("title"))
    new = key(starred).join(key(loved).select("_a", "_t").distinct(), ["_a", "_t"], "left_anti")
    return new.groupBy("_a", "_t").agg(F.min(F.struct("artist", "title")).alias("x")).select("x.artist", "x.title")


def counter_deltas(songs: DataFrame, plays: DataFrame) -> DataFrame:
    """Songs (id, playcount, lastplayed) after plays (id, epoch): counts add up, the last play is the later one."""
    delta = plays.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"))
    return songs.join(delta, "id", "left").select(
        "id",
        (F.col("playcount") + F.coalesce("n", F.lit(0))).alias("playcount"),
        F.greatest("lastplayed", F.coalesce("last", F.lit(-1))).alias("lastplayed"),
    )


def near_existing(plays: DataFrame, existing: DataFrame, tolerance: int = 60) -> DataFrame:
    """Rows of ``plays`` (entity, t, id) with a row of ``existing`` (entity, t) within the tolerance.

    Both sides meet on the entity and a slot of the tolerance's length, looked up in three slots, so a busy entity
    is spread over its slots.
    """
    slot = lambda c: F.floor(c / F.lit(max(tolerance, 1)))
    around = plays.select("*", F.explode(F.array(*[slot(F.col("t")) + d for d in (-1, 0, 1)])).alias("slot"))
    there = existing.select("entity", F.col("t").alias("other"), slot(F.col("t")).alias("slot")).distinct()
    met = around.join(there, ["entity", "slot"]).where(F.abs(F.col("t") - F.col("other")) <= tolerance)
    return plays.join(met.select("id").distinct(), "id", "left_semi")


def suppress_near_duplicates(plays: DataFrame, tolerance: int = 60) -> DataFrame:
    """(id, accepted) of ``plays`` (entity, t, id): a play is dropped if an accepted one is at most that far before.

    The fold is greedy and ordered: 0, 50 and 100 seconds give yes, no, yes. An empty slot of the tolerance's length
    parts plays that cannot influence each other, so an entity falls into runs of slots in use; the runs are found on
    distinct slots, whose number is bounded by the calendar and not by the plays, and each run is folded as a stream
    in time order, with one play in memory.
    """
    width = max(tolerance, 1)
    slotted = plays.select("entity", "t", "id", F.floor(F.col("t") / width).alias("slot"))
    order = Window.partitionBy("entity").orderBy("slot")
    runs = slotted.select("entity", "slot").distinct()
    runs = runs.withColumn("run", F.col("slot") - F.row_number().over(order))
    rows = slotted.join(runs, ["entity", "slot"]).select("entity", "run", "t", "id")
    return rows.repartition("entity", "run").sortWithinPartitions("entity", "run", "t", "id").mapInArrow(
        _fold(tolerance), "id long, accepted boolean"
    )


def _fold(tolerance: int):
    def run(batches):
        import pyarrow as pa

        at, last = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("entity", "run", "t", "id")]
            taken = []
            for entity, island, t, _ in zip(*columns):
                take = (entity, island) != at or t - last > tolerance
                if take:
                    at, last = (entity, island), t
                taken.append(take)
            yield pa.RecordBatch.from_arrays([pa.array(columns[3], pa.int64()), pa.array(taken, pa.bool_())], names=["id", "accepted"])

    return run
