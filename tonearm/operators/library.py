"""Top lists, lookups and counts over the library and its plays or, where there is no play log, its annotations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators import matching, stats
from tonearm.session import durable
from tonearm.sources.tables import present

TRACK = ["media_file_id", "title", "artist", "album"]


def user_id(users: DataFrame, name: str) -> str:
    """The id of the user of that name; an error if there is none."""
    row = users.where(F.col("user_name") == name).select(F.min("id")).first()[0]
    if row is None:
        raise LookupError(f"no user {name!r}")
    return row


def default_user(plays: DataFrame) -> str | None:
    """The user with most plays, of equals the first by name."""
    row = plays.where(present("lastfm_user")).groupBy("lastfm_user").count().orderBy(F.col("count").desc(), "lastfm_user").first()
    return row and row["lastfm_user"]


def per_track(plays: DataFrame, client: str | None = None, dated: bool = False) -> DataFrame:
    """(media_file_id, n[, first, last]) of plays (media_file_id, client, ts): the only step that reads every play."""
    if client:
        plays = plays.where(F.col("client") == client)
    span = [F.min("ts").alias("first"), F.max("ts").alias("last")] if dated else []
    return plays.groupBy("media_file_id").agg(F.count(F.lit(1)).alias("n"), *span)


def per_track_annotated(annotation: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """``per_track`` where only annotations are known: counts of tracks last played in the window, if there is one."""
    own = annotation.where((F.col("item_type") == "media_file") & (F.col("play_count") > 0))
    if start is not None and end is not None:
        at = lambda when: F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        own = own.where((F.col("play_date") >= at(start)) & (F.col("play_date") < at(end)))
    return own.groupBy(F.col("item_id").alias("media_file_id")).agg(F.sum("play_count").alias("n"))


def top(counted: DataFrame, tracks: DataFrame, keys: list[str], limit: int, order: list[str], named: str | None = None) -> DataFrame:
    """(keys..., plays[, first, last]) from ``per_track`` counts and the tracks' columns, the most played first."""
    span = [F.min("first").alias("first"), F.max("last").alias("last")] if "first" in counted.columns else []
    met = counted.join(tracks, "media_file_id")
    groups = (met.where(present(named)) if named else met).groupBy(*keys).agg(F.sum("n").alias("plays"), *span)
    return groups.orderBy(F.col("plays").desc(), *order).limit(limit)


def timeline(plays: DataFrame, tracks: DataFrame, months: list[str], limit: int) -> DataFrame:
    """(artist, month, plays): the artists with most plays of the window, zero where a month has none."""
    counts = plays.groupBy("media_file_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    monthly = counts.join(tracks.where(present("artist")), "media_file_id").groupBy("artist", "month").agg(F.sum("n").alias("plays"))
    best = monthly.groupBy("artist").agg(F.sum("plays").alias("all")).orderBy(F.col("all").desc(), "artist").limit(limit)
    axis = best.select("artist", F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
    return monthly.join(axis, ["artist", "month"], "right").select("artist", "month", F.coalesce("plays", F.lit(0)).alias("plays"))


def lookup(ids: DataFrame, media_file: DataFrame, *columns: str) -> DataFrame:
    """(pos, id, columns...) of a list of ids (pos, id) in its order; unknown ids are left out."""
    return ids.join(media_file.select("id", *columns), "id").select("pos", "id", *columns).orderBy("pos")


def labels(ids: DataFrame, media_file: DataFrame) -> DataFrame:
    """(pos, id, label): "artist — title", without the dash where one is missing."""
    known = lookup(ids, media_file, "artist", "title")
    parts = F.filter(F.array("artist", "title"), lambda x: F.coalesce(x, F.lit("")) != "")
    return known.select("pos", "id", F.array_join(parts, " — ").alias("label"))


def summarize(ids: DataFrame, media_file: DataFrame, counted: DataFrame) -> DataFrame:
    """(pos, id, title, artist, album, plays) of a list of ids, with the plays of ``per_track`` counts, or zero."""
    plays = counted.select(F.col("media_file_id").alias("id"), F.col("n").alias("plays"))
    known = lookup(ids, media_file, "title", "artist", "album").join(plays, "id", "left")
    return known.select("pos", "id", "title", "artist", "album", F.coalesce("plays", F.lit(0)).alias("plays")).orderBy("pos")


def missing_ids(ids: DataFrame, media_file: DataFrame) -> DataFrame:
    """(pos, id) of the ids that are no track, in their order."""
    return ids.join(media_file.select("id"), "id", "left_anti").select("pos", "id").orderBy("pos")


def recent_stars(annotation: DataFrame, media_file: DataFrame, limit: int) -> DataFrame:
    """(user_id, item_id, title, artist, starred_at) of the newest stars that have a time."""
    own = annotation.where("item_type = 'media_file' AND starred AND starred_at IS NOT NULL")
    tracks = media_file.select(F.col("id").alias("item_id"), "title", "artist")
    met = own.select("user_id", "item_id", "starred_at").join(tracks, "item_id")
    return met.orderBy(F.col("starred_at").desc(), "item_id", "user_id").limit(limit)


def never_played(annotation: DataFrame, media_file: DataFrame, limit: int, seed: int) -> DataFrame:
    """A random handful of tracks that nobody has played; the same seed draws the same ones."""
    played = annotation.where("item_type = 'media_file' AND play_count > 0").select(F.col("item_id").alias("id"))
    return media_file.select("id").join(played, "id", "left_anti").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)


def artist_ids(names: DataFrame, artist: DataFrame, media_file: DataFrame) -> DataFrame:
    """(name, artist_id) by normalised name: from the artist table or else from the tracks, if exactly one id has it."""
    norm = durable(matching.norms(names.select("name"), artist.select("name"), media_file.select("artist")))
    asked = matching.with_norm(names.distinct(), F.col("name"), "a", norm).where(present("a"))
    own = matching.with_norm(artist.select("id", "name"), F.col("name"), "a", norm).select("a", "id", F.lit(0).alias("rank"))
    other = matching.with_norm(media_file.select("artist_id", "artist"), F.col("artist"), "a", norm)
    other = other.where(present("artist_id")).select("a", F.col("artist_id").alias("id"), F.lit(1).alias("rank"))
    ids = own.unionByName(other).where(present("a")).groupBy("a", "rank").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    first = ids.groupBy("a").agg(F.min(F.struct("rank", "n", "id")).alias("x")).where("x.n = 1")
    return asked.join(first, "a").select("name", F.col("x.id").alias("artist_id"))


def delete_user(plays: DataFrame, user: str) -> DataFrame:
    """The play log without one user's plays."""
    return plays.where(~F.col("user_id").eqNullSafe(user))


def reset_counts(annotation: DataFrame, user: str) -> DataFrame:
    """The annotations with one user's play counts and dates cleared; stars and ratings stay."""
    own = F.col("user_id").eqNullSafe(user)
    changed = {
        "play_count": F.when(own, F.lit(0)).otherwise(F.col("play_count")).cast(dict(annotation.dtypes)["play_count"]).alias("play_count"),
        "play_date": F.when(~own, F.col("play_date")).alias("play_date"),
    }
    return annotation.select(*[changed.get(c, F.col(c)) for c in annotation.columns])


def insert_shape(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` in the columns of the table they are added to; it may want an ``ann_id``, which is made up."""
    made = rows.withColumn("ann_id", F.expr("uuid()")) if "ann_id" in columns and "ann_id" not in rows.columns else rows
    return made.select(*[F.col(c) if c in made.columns else F.lit(None).alias(c) for c in columns])


def user_counts(plays: DataFrame, annotation: DataFrame) -> DataFrame:
    """(user_id, plays, played_items): library plays and annotations with plays of every user."""
    log = plays.groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"))
    notes = annotation.where("play_count > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("played_items"))
    both = log.join(notes, "user_id", "full")
    return both.select("user_id", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("played_items", F.lit(0)).alias("played_items"))


def nearest_titles(asked: DataFrame, library: DataFrame, most: int, limit: int = 3) -> DataFrame:
    """(a, t, near, distance, k): up to ``limit`` nearest titles of the artist or album artist, by normalised text.

    ``asked`` is (a, t), ``library`` (a, aa, t). Couples meet as one string on its segments, so an artist with many
    titles is not crossed with itself.
    """
    couple = lambda a, t: F.concat(F.col(a), F.lit("\u0001"), F.col(t))
    owned = library.select("a", "t").unionAll(library.select("aa", "t")).where(present("a") & present("t")).distinct()
    left = asked.select("a", "t").where(present("a") & present("t")).distinct().withColumn("l", couple("a", "t"))
    right = owned.select(F.col("a").alias("ra"), F.col("t").alias("near")).withColumn("r", couple("ra", "near"))
    met = matching.near_strings(left.select("l"), right.select("r"), most).join(left, "l").join(right, "r").where("a = ra")
    order = Window.partitionBy("a", "t").orderBy("distance", "near")
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("a", "t", "near", "distance", "k")


def suggestions(diagnosed: DataFrame, asked: DataFrame, library: DataFrame) -> DataFrame:
    """``diagnosed`` (a, t, verdict) with ``artists`` and ``titles``: arrays of (name, distance) to try instead."""
    names = matching.nearest_names(asked.select("a").where(present("a")).distinct(), library.select("a").where(present("a")), 2)
    listed = lambda df, by, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("distance", name))).alias("x")).select(
        *by, F.transform("x", lambda s: F.struct(s[name].alias("name"), s["distance"].alias("distance"))).alias("x")
    )
    artists = listed(names.select(F.col("name").alias("a"), "near", "distance"), ["a"], "near").withColumnRenamed("x", "artists")
    titles = listed(nearest_titles(asked, library, 3).where("distance > 0"), ["a", "t"], "near").withColumnRenamed("x", "titles")
    return diagnosed.join(artists, "a", "left").join(titles, ["a", "t"], "left").select("a", "t", "verdict", "artists", "titles")


def history(counts: DataFrame, days: int) -> DataFrame:
    """The newest ``days`` daily rows (day, ...), oldest first."""
    return counts.orderBy(F.col("day").desc()).limit(days).orderBy("day")
