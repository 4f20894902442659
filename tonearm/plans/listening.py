"""Queries over the play logs: counts, top lists, time series, playlists. ``NOW`` pins every clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import filters, stats
from tonearm.plans.registry import Registry
from tonearm.sources.tables import present, table, utc

REGISTRY = Registry()
NOW = datetime(2025, 6, 1)
FROM, TO = datetime(2024, 3, 1), datetime(2024, 9, 1)

_LP = """WITH lp AS (
  SELECT l.id, l.media_file_id, l.user_id, l.client, TIMESTAMP '1970-01-01' + to_seconds(l.submission_time) AS ts,
         m.title, m.artist, m.album, m.album_id, m.album_artist
  FROM library_scrobbles l JOIN media_file m ON m.id = l.media_file_id)
"""
_W = "ts >= TIMESTAMP '2024-03-01' AND ts < TIMESTAMP '2024-09-01'"
_UNIQUE = ["artist", "title"]


def local_plays(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "scrobbles", F.col("played_at").alias("ts"), *columns)


def library_plays(spark: SparkSession, sf: str, *columns: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Plays of the library; with ``columns`` of their track, those of unknown tracks are dropped.

    The window is a range of epoch seconds, which the scan can use.
    """
    plays = table(spark, sf, "library_scrobbles", "id", "media_file_id", "user_id", "client", "submission_time")
    plays = filters.seconds_between(plays, "submission_time", start, end).withColumn("ts", utc("submission_time")).drop("submission_time")
    if not columns:
        return plays
    tracks = table(spark, sf, "media_file", F.col("id").alias("media_file_id"), *columns)
    return plays.join(tracks, "media_file_id")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media_file", "id")


@REGISTRY.query(
    "library_counts",
    """SELECT count(*) AS tracks, count(DISTINCT CASE WHEN artist <> '' THEN artist END) AS artists,
              count(DISTINCT CASE WHEN album <> '' THEN album END) AS albums, CAST(coalesce(sum(duration), 0) AS BIGINT) AS seconds
       FROM media_file""",
)
def library_counts(spark, sf):
    m = table(spark, sf, "media_file", "artist", "album", "duration")
    known = lambda c: F.countDistinct(F.when(present(c), F.col(c)))
    return m.agg(
        F.count(F.lit(1)).alias("tracks"), known("artist").alias("artists"), known("album").alias("albums"),
        F.coalesce(F.sum("duration"), F.lit(0)).cast("long").alias("seconds"),
    )


@REGISTRY.query(
    "starred_counts",
    """SELECT user_id, count(*) FILTER (item_type = 'media_file') AS tracks, count(*) FILTER (item_type = 'album') AS albums,
              count(*) FILTER (item_type = 'artist') AS artists FROM annotation WHERE starred GROUP BY user_id""",
)
def starred_counts(spark, sf):
    a = table(spark, sf, "annotation", "user_id", "item_type", "starred").where("starred")
    kind = lambda k: F.count_if(F.col("item_type") == k)
    return a.groupBy("user_id").agg(kind("media_file").alias("tracks"), kind("album").alias("albums"), kind("artist").alias("artists"))


@REGISTRY.query(
    "play_bounds",
    """SELECT lastfm_user, strftime(min(played_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(played_at), '%Y-%m-%d %H:%M:%S') AS last,
              count(*) AS plays FROM scrobbles GROUP BY lastfm_user""",
)
def play_bounds(spark, sf):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    g = local_plays(spark, sf, "lastfm_user").groupBy("lastfm_user")
    return g.agg(stamp(F.min("ts")).alias("first"), stamp(F.max("ts")).alias("last"), F.count(F.lit(1)).alias("plays"))


@REGISTRY.query("available_years", "SELECT DISTINCT strftime(played_at, '%Y') AS year FROM scrobbles")
def available_years(spark, sf):
    return local_plays(spark, sf).select(F.date_format("ts", "yyyy").alias("year")).distinct()


@REGISTRY.query(
    "distinct_counts",
    """SELECT 'artists' AS what, count(*) AS n FROM (SELECT DISTINCT artist FROM scrobbles WHERE artist <> '')
       UNION ALL SELECT 'tracks', count(*) FROM (SELECT DISTINCT artist, title FROM scrobbles)
       UNION ALL SELECT 'albums', count(*) FROM (SELECT DISTINCT artist, album FROM scrobbles WHERE album <> '')
       UNION ALL SELECT 'loved', count(*) FROM (SELECT DISTINCT artist, title FROM scrobbles WHERE loved)""",
)
def distinct_counts(spark, sf):
    # One shuffle of different triples, which the four counts share.
    s = table(spark, sf, "scrobbles", "artist", "title", "album", "loved").groupBy("artist", "title", "album").agg(F.max("loved").alias("loved"))
    parts = [
        ("artists", s.where(present("artist")), ["artist"]), ("tracks", s, _UNIQUE),
        ("albums", s.where(present("album")), ["artist", "album"]), ("loved", s.where("loved"), _UNIQUE),
    ]
    out = [stats.distinct_count(df, *cols).select(F.lit(name).alias("what"), "n") for name, df, cols in parts]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@REGISTRY.query(
    "window_totals",
    _LP + f"SELECT client, count(*) AS plays, count(DISTINCT media_file_id) AS tracks FROM lp WHERE {_W} GROUP BY client",
)
def window_totals(spark, sf):
    p = library_plays(spark, sf, start=FROM, end=TO)
    per = p.groupBy("client", "media_file_id").agg(F.count(F.lit(1)).alias("n"))
    known = stats.of_known(per, "media_file_id", tracks(spark, sf))
    return known.groupBy("client").agg(F.sum("n").alias("plays"), F.count(F.lit(1)).alias("tracks"))


@REGISTRY.query("listened_days", "SELECT DISTINCT lastfm_user, strftime(played_at, '%Y-%m-%d') AS day FROM scrobbles")
def listened_days(spark, sf):
    return local_plays(spark, sf, "lastfm_user").select("lastfm_user", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()


@REGISTRY.query("play_clients", "SELECT DISTINCT client FROM library_scrobbles WHERE client <> ''")
def play_clients(spark, sf):
    return table(spark, sf, "library_scrobbles", "client").where(present("client")).distinct()


@REGISTRY.query("known_artists", "SELECT DISTINCT artist FROM media_file WHERE artist <> ''")
def known_artists(spark, sf):
    return table(spark, sf, "media_file", "artist").where(present("artist")).distinct()


@REGISTRY.query(
    "incomplete_albums",
    """SELECT m.album_id, m.album, count(DISTINCT m.id) AS tracks, count(l.id) AS plays
       FROM media_file m LEFT JOIN library_scrobbles l ON l.media_file_id = m.id
       WHERE (m.mbz_album_id IS NULL OR m.mbz_album_id = '') AND m.album <> ''
       GROUP BY 1, 2 ORDER BY plays DESC, tracks DESC, m.album, m.album_id LIMIT 200""",
)
def incomplete_albums(spark, sf):
    m = table(spark, sf, "media_file", F.col("id").alias("media_file_id"), "album_id", "album", "mbz_album_id")
    m = m.where((F.coalesce("mbz_album_id", F.lit("")) == "") & present("album"))
    per_track = table(spark, sf, "library_scrobbles", "media_file_id").groupBy("media_file_id").agg(F.count(F.lit(1)).alias("n"))
    g = m.join(per_track, "media_file_id", "left").groupBy("album_id", "album")
    out = g.agg(F.countDistinct("media_file_id").alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("plays"))
    return out.orderBy(F.col("plays").desc(), F.col("tracks").desc(), "album", "album_id").limit(200)


@REGISTRY.query(
    "forgotten_artists",
    _LP + """SELECT artist, plays, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, idle_days FROM (
         SELECT artist, count(*) AS plays, max(ts) AS last,
                CAST(floor((epoch(TIMESTAMP '2025-06-01') - epoch(max(ts))) / 86400) AS BIGINT) AS idle_days
         FROM lp WHERE artist <> '' GROUP BY artist HAVING count(*) >= 3 AND max(ts) < TIMESTAMP '2024-12-01') AS g
         ORDER BY plays * idle_days DESC, artist LIMIT 200""",
)
def forgotten_artists(spark, sf):
    out = stats.forgotten(library_plays(spark, sf, "artist"), "artist", 3, datetime(2024, 12, 1), NOW, 200)
    return out.select("artist", "plays", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "idle_days")


@REGISTRY.query(
    "new_artists",
    """SELECT artist, count(*) AS plays, strftime(min(played_at), '%Y-%m-%d %H:%M:%S') AS first FROM scrobbles WHERE artist <> ''
       GROUP BY artist HAVING strftime(min(played_at), '%Y') = '2024' ORDER BY min(played_at), artist LIMIT 100""",
)
def new_artists(spark, sf):
    s = local_plays(spark, sf, "artist").where(present("artist"))
    g = s.groupBy("artist").agg(F.count(F.lit(1)).alias("plays"), F.min("ts").alias("at"))
    kept = filters.cascade(g, "at", 2024).orderBy("at", "artist").limit(100)
    return kept.select("artist", "plays", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("first"))


@REGISTRY.query(
    "most_active_month",
    """SELECT strftime(played_at, '%Y-%m') AS month, count(*) AS plays FROM scrobbles
       WHERE played_at >= TIMESTAMP '2024-01-01' AND played_at < TIMESTAMP '2025-01-01' GROUP BY 1 ORDER BY plays DESC, month DESC LIMIT 1""",
)
def most_active_month(spark, sf):
    s = filters.cascade(local_plays(spark, sf), "ts", 2024)
    return stats.top(s, [F.date_format("ts", "yyyy-MM").alias("month")], [F.col("plays").desc(), F.col("month").desc()], 1)


@REGISTRY.query("plays_by_dow", "SELECT CAST(dayofweek(played_at) AS INTEGER) AS dow, count(*) AS plays FROM scrobbles GROUP BY 1")
def plays_by_dow(spark, sf):
    return local_plays(spark, sf).groupBy((F.dayofweek("ts") - 1).alias("dow")).agg(F.count(F.lit(1)).alias("plays"))


@REGISTRY.query(
    "top_tracks_window",
    _LP + f"""SELECT media_file_id, count(*) AS plays, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM lp WHERE {_W}
              GROUP BY 1 ORDER BY plays DESC, max(ts) DESC, media_file_id LIMIT 50""",
)
def top_tracks_window(spark, sf):
    p = library_plays(spark, sf, start=FROM, end=TO)
    order = [F.col("plays").desc(), F.col("at").desc(), F.col("media_file_id")]
    out = stats.top(p, ["media_file_id"], order, 50, tracks(spark, sf), at=F.max("ts"))
    return out.select("media_file_id", "plays", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last"))


@REGISTRY.query(
    "top_tracks_windows",
    _LP + """SELECT media_file_id, count(*) AS plays FROM lp
             WHERE (ts >= TIMESTAMP '2023-06-01' AND ts < TIMESTAMP '2023-08-01') OR (ts >= TIMESTAMP '2023-07-01' AND ts < TIMESTAMP '2023-09-01')
                OR (ts >= TIMESTAMP '2024-06-01' AND ts < TIMESTAMP '2024-09-01')
             GROUP BY 1 ORDER BY plays DESC, max(ts) DESC, media_file_id LIMIT 50""",
)
def top_tracks_windows(spark, sf):
    rows = [(datetime(2023, 6, 1), datetime(2023, 8, 1)), (datetime(2023, 7, 1), datetime(2023, 9, 1)), (datetime(2024, 6, 1), datetime(2024, 9, 1))]
    windows = spark.createDataFrame(rows, "start timestamp_ntz, end timestamp_ntz")
    p = library_plays(spark, sf, start=min(lo for lo, _ in rows), end=max(hi for _, hi in rows))
    p = stats.in_windows(p, windows)
    order = [F.col("plays").desc(), F.col("at").desc(), F.col("media_file_id")]
    out = stats.top(p, ["media_file_id"], order, 50, tracks(spark, sf), at=F.max("ts"))
    return out.select("media_file_id", "plays")


@REGISTRY.query(
    "top_all_time",
    """SELECT a.ann_id, a.item_id, a.play_count FROM annotation a JOIN media_file m ON m.id = a.item_id
       WHERE a.item_type = 'media_file' AND a.play_count > 0 ORDER BY a.play_count DESC, a.play_date DESC NULLS LAST, a.ann_id LIMIT 100""",
)
def top_all_time(spark, sf):
    a = table(spark, sf, "annotation", "ann_id", "item_id", "item_type", "play_count", "play_date")
    a = a.where("item_type = 'media_file' AND play_count > 0").join(table(spark, sf, "media_file", F.col("id").alias("item_id")), "item_id", "left_semi")
    order = [F.col("play_count").desc(), F.col("play_date").desc_nulls_last(), F.col("ann_id")]
    return a.orderBy(*order).limit(100).select("ann_id", "item_id", "play_count")


_STAMPS = "strftime(min({0}), '%Y-%m-%d %H:%M:%S') AS first, strftime(max({0}), '%Y-%m-%d %H:%M:%S') AS last"


def _dated(p: DataFrame, keys: list[str], ties: list[str], limit: int = 100) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    order = [F.col("plays").desc(), *[F.col(t) for t in ties]]
    return stats.top(p, keys, order, limit, first=stamp(F.min("ts")), last=stamp(F.max("ts")))


def _register_cascades() -> None:
    for name, when, lo, hi in (
        ("all", (None,), "1900-01-01", "2100-01-01"), ("year", (2024,), "2024-01-01", "2025-01-01"),
        ("month", (2024, 5), "2024-05-01", "2024-06-01"), ("day", (2024, 5, 17), "2024-05-17", "2024-05-18"),
    ):
        for what, keys, ties in (
            ("artists", ["artist"], ["artist"]), ("albums", ["artist", "album"], ["album", "artist"]), ("tracks", ["artist", "title"], ["title", "artist"]),
        ):
            sql = f"""SELECT {', '.join(keys)}, count(*) AS plays, {_STAMPS.format('played_at')} FROM scrobbles
                      WHERE {' AND '.join(f"{k} <> ''" for k in keys)} AND played_at >= TIMESTAMP '{lo}' AND played_at < TIMESTAMP '{hi}'
                      GROUP BY {', '.join(keys)} ORDER BY plays DESC, {', '.join(ties)} LIMIT 100"""

            def run(spark, sf, keys=keys, ties=ties, when=when):
                p = filters.cascade(local_plays(spark, sf, *keys), "ts", *when)
                for k in keys:
                    p = p.where(present(k))
                return _dated(p, keys, ties)

            REGISTRY.query(f"top_{what}_{name}", sql)(run)


_register_cascades()


@REGISTRY.query(
    "library_top_albums_dates",
    _LP + f"""SELECT album_id, album, coalesce(nullif(album_artist, ''), artist) AS credit, count(*) AS plays, count(DISTINCT media_file_id) AS tracks,
              {_STAMPS.format('ts')} FROM lp WHERE album <> '' GROUP BY 1, 2, 3 ORDER BY plays DESC, album, album_id, credit LIMIT 100""",
)
def library_top_albums_dates(spark, sf):
    p = library_plays(spark, sf, "album_id", "album", "album_artist", "artist").where(present("album"))
    by = F.coalesce(F.nullif("album_artist", F.lit("")), "artist").alias("credit")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    order = [F.col("plays").desc(), F.col("album"), F.col("album_id"), F.col("credit")]
    return stats.top(p, ["album_id", "album", by], order, 100, tracks=F.countDistinct("media_file_id"), first=stamp(F.min("ts")), last=stamp(F.max("ts")))


@REGISTRY.query(
    "top_albums_sample_track",
    _LP + f""", per AS (SELECT album_id, media_file_id, count(*) AS n FROM lp GROUP BY 1, 2),
         sample AS (SELECT album_id, media_file_id, row_number() OVER (PARTITION BY album_id ORDER BY n DESC, media_file_id) AS k FROM per)
         SELECT t.album_id, t.plays, s.media_file_id AS sample_track_id FROM
           (SELECT album_id, count(*) AS plays FROM lp WHERE album_id <> '' AND {_W} GROUP BY 1 ORDER BY plays DESC, album_id LIMIT 50) t
           JOIN sample s ON s.album_id = t.album_id AND s.k = 1""",
)
def top_albums_sample_track(spark, sf):
    p = library_plays(spark, sf, "album_id").where(present("album_id"))
    inside = library_plays(spark, sf, "album_id", start=FROM, end=TO).where(present("album_id"))
    best = stats.top(inside, ["album_id"], [F.col("plays").desc(), F.col("album_id")], 50)
    per = p.groupBy("album_id", "media_file_id").agg(F.count(F.lit(1)).alias("n"))
    sample = per.groupBy("album_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "media_file_id")).alias("s"))
    return sample.join(best, "album_id").select("album_id", "plays", F.col("s.media_file_id").alias("sample_track_id"))


@REGISTRY.query(
    "artists_timeline",
    """WITH t AS (SELECT artist FROM scrobbles WHERE artist <> '' AND played_at >= TIMESTAMP '2024-06-01' AND played_at < TIMESTAMP '2025-06-01'
                  GROUP BY artist ORDER BY count(*) DESC, artist LIMIT 10),
       c AS (SELECT artist, strftime(played_at, '%Y-%m') AS month, count(*) AS plays FROM scrobbles
             WHERE played_at >= TIMESTAMP '2024-06-01' AND played_at < TIMESTAMP '2025-06-01' GROUP BY 1, 2)
       SELECT t.artist, m.month, coalesce(c.plays, 0) AS plays FROM t CROSS JOIN
         (SELECT strftime(unnest(generate_series(TIMESTAMP '2024-06-01', TIMESTAMP '2025-05-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) m
         LEFT JOIN c ON c.artist = t.artist AND c.month = m.month""",
)
def artists_timeline(spark, sf):
    p = filters.between(local_plays(spark, sf, "artist"), "ts", datetime(2024, 6, 1), NOW).where(present("artist"))
    best = stats.top(p, ["artist"], [F.col("plays").desc(), F.col("artist")], 10).select("artist")
    months = stats.month_axis(datetime(2024, 6, 1), datetime(2025, 5, 1))
    axis = best.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    counts = p.groupBy("artist", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("plays"))
    return counts.join(axis, ["artist", "month"], "right").select("artist", "month", F.coalesce("plays", F.lit(0)).alias("plays"))


@REGISTRY.query(
    "top_tracks_album",
    """WITH t AS (SELECT artist, title, count(*) AS plays FROM scrobbles WHERE artist <> '' AND title <> '' GROUP BY 1, 2
                  ORDER BY plays DESC, artist, title LIMIT 100)
       SELECT t.artist, t.title, t.plays, (SELECT min(s.album) FROM scrobbles s WHERE s.artist = t.artist AND s.title = t.title AND s.album <> '') AS album
       FROM t""",
)
def top_tracks_album(spark, sf):
    s = table(spark, sf, "scrobbles", "artist", "title", "album").where(present("artist") & present("title"))
    order = [F.col("plays").desc(), F.col("artist"), F.col("title")]
    return stats.top(s, ["artist", "title"], order, 100, album=F.min(F.nullif("album", F.lit(""))))


@REGISTRY.query(
    "recent_plays",
    """SELECT id, artist, title, strftime(played_at, '%Y-%m-%d %H:%M:%S') AS played_at FROM scrobbles ORDER BY scrobbles.played_at DESC, id DESC LIMIT 100""",
)
def recent_plays(spark, sf):
    s = table(spark, sf, "scrobbles", "id", "artist", "title", "played_at")
    out = s.orderBy(F.col("played_at").desc(), F.col("id").desc()).limit(100)
    return out.withColumn("played_at", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss"))


@REGISTRY.query(
    "recent_loved",
    """SELECT artist, title, strftime(max(played_at), '%Y-%m-%d %H:%M:%S') AS last, min(nullif(album, '')) AS album FROM scrobbles WHERE loved
       GROUP BY artist, title ORDER BY max(played_at) DESC, artist, title LIMIT 50""",
)
def recent_loved(spark, sf):
    s = local_plays(spark, sf, "artist", "title", "album", "loved").where("loved")
    g = s.groupBy("artist", "title").agg(F.max("ts").alias("at"), F.min(F.nullif("album", F.lit(""))).alias("album"))
    out = g.orderBy(F.col("at").desc(), "artist", "title").limit(50)
    return out.select("artist", "title", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last"), "album")


def _months_sql(source: str, column: str, extra: str = "") -> str:
    return f"""WITH axis AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2023-06-01', TIMESTAMP '2025-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
        c AS (SELECT strftime({column}, '%Y-%m') AS month, count(*) AS plays{extra} FROM {source} GROUP BY 1)
        SELECT axis.month, coalesce(c.plays, 0) AS plays{', coalesce(c.different, 0) AS different' if extra else ''} FROM axis LEFT JOIN c ON c.month = axis.month"""


@REGISTRY.query("plays_by_month_filled", _months_sql("scrobbles", "played_at"))
def plays_by_month_filled(spark, sf):
    return stats.months_filled(local_plays(spark, sf), spark, datetime(2023, 6, 1), NOW)


@REGISTRY.query(
    "diversity_by_month", _months_sql("scrobbles", "played_at", ", count(DISTINCT CASE WHEN artist <> '' THEN artist END) AS different")
)
def diversity_by_month(spark, sf):
    return stats.months_filled(local_plays(spark, sf, "artist"), spark, datetime(2023, 6, 1), NOW, "artist")


@REGISTRY.query(
    "library_plays_by_month",
    """WITH axis AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2023-06-01', TIMESTAMP '2025-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
       c AS (SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(l.submission_time), '%Y-%m') AS month, count(*) AS plays
             FROM library_scrobbles l JOIN media_file m ON m.id = l.media_file_id GROUP BY 1)
       SELECT axis.month, coalesce(c.plays, 0) AS plays FROM axis LEFT JOIN c ON c.month = axis.month""",
)
def library_plays_by_month(spark, sf):
    return stats.months_filled(library_plays(spark, sf, "title"), spark, datetime(2023, 6, 1), NOW)


@REGISTRY.query(
    "plays_by_week_filled",
    """WITH axis AS (SELECT unnest(generate_series(TIMESTAMP '2024-06-03', TIMESTAMP '2025-05-26', INTERVAL 7 DAY)) AS w),
       c AS (SELECT date_trunc('week', played_at) AS w, count(*) AS plays FROM scrobbles GROUP BY 1)
       SELECT strftime(axis.w, '%Y-%m-%d') AS week, coalesce(c.plays, 0) AS plays FROM axis LEFT JOIN c ON c.w = axis.w""",
)
def plays_by_week_filled(spark, sf):
    return stats.weeks_filled(local_plays(spark, sf), spark, NOW, 52)


@REGISTRY.query(
    "plays_by_day_filled",
    """WITH axis AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2025-03-04', TIMESTAMP '2025-06-01', INTERVAL 1 DAY)), '%Y-%m-%d') AS day),
       c AS (SELECT strftime(played_at, '%Y-%m-%d') AS day, count(*) AS plays FROM scrobbles GROUP BY 1)
       SELECT axis.day, coalesce(c.plays, 0) AS plays FROM axis LEFT JOIN c ON c.day = axis.day""",
)
def plays_by_day_filled(spark, sf):
    return stats.days_filled(local_plays(spark, sf), spark, NOW, 90)


@REGISTRY.query(
    "plays_by_month_sparse",
    "SELECT strftime(played_at, '%Y-%m') AS month, count(*) AS plays FROM scrobbles GROUP BY 1 ORDER BY month DESC LIMIT 24",
)
def plays_by_month_sparse(spark, sf):
    return stats.top(local_plays(spark, sf), [F.date_format("ts", "yyyy-MM").alias("month")], [F.col("month").desc()], 24)


@REGISTRY.query(
    "heatmap_day_hour",
    """SELECT CAST(d.d AS INTEGER) AS dow, CAST(h.h AS INTEGER) AS hour, coalesce(c.n, 0) AS plays
       FROM (SELECT unnest(generate_series(0, 6)) AS d) d CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) h
       LEFT JOIN (SELECT dayofweek(played_at) AS dow, hour(played_at) AS hour, count(*) AS n FROM scrobbles GROUP BY 1, 2) c
       ON c.dow = d.d AND c.hour = h.h""",
)
def heatmap_day_hour(spark, sf):
    return stats.day_hour(local_plays(spark, sf), spark)


@REGISTRY.query(
    "heatmap_levels",
    """WITH axis AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2024-05-27', TIMESTAMP '2025-06-01', INTERVAL 1 DAY)), '%Y-%m-%d') AS day),
       f AS (SELECT axis.day, coalesce(c.n, 0) AS plays FROM axis LEFT JOIN
             (SELECT strftime(played_at, '%Y-%m-%d') AS day, count(*) AS n FROM scrobbles GROUP BY 1) c ON c.day = axis.day),
       r AS (SELECT plays, row_number() OVER (ORDER BY plays) - 1 AS k, count(*) OVER () AS n FROM f WHERE plays > 0),
       q AS (SELECT max(CASE WHEN k = floor((n - 1) * 0.25) THEN plays END) AS q1, max(CASE WHEN k = floor((n - 1) * 0.5) THEN plays END) AS q2,
                    max(CASE WHEN k = floor((n - 1) * 0.75) THEN plays END) AS q3 FROM r)
       SELECT day, plays, CASE WHEN plays <= 0 THEN 0 WHEN plays <= q1 THEN 1 WHEN plays <= q2 THEN 2 WHEN plays <= q3 THEN 3 ELSE 4 END AS level
       FROM f CROSS JOIN q""",
)
def heatmap_levels(spark, sf):
    return stats.heatmap(local_plays(spark, sf), spark, NOW)


@REGISTRY.query(
    "listening_streaks",
    """WITH d AS (SELECT DISTINCT lastfm_user, CAST(played_at AS DATE) AS d FROM scrobbles),
       i AS (SELECT lastfm_user, d, d - CAST(row_number() OVER (PARTITION BY lastfm_user ORDER BY d) AS INTEGER) AS g FROM d),
       r AS (SELECT lastfm_user, min(d) AS lo, max(d) AS hi, count(*) AS n FROM i GROUP BY lastfm_user, g),
       k AS (SELECT *, row_number() OVER (PARTITION BY lastfm_user ORDER BY n DESC, lo) AS k FROM r)
       SELECT k.lastfm_user, k.n AS longest, strftime(k.lo, '%Y-%m-%d') AS longest_start, strftime(k.hi, '%Y-%m-%d') AS longest_end,
              coalesce((SELECT max(r.n) FROM r WHERE r.lastfm_user = k.lastfm_user AND r.hi >= DATE '2025-05-31' AND r.hi <= DATE '2025-06-01'), 0) AS current
       FROM k WHERE k.k = 1""",
)
def listening_streaks(spark, sf):
    return stats.streak_summary(local_plays(spark, sf, "lastfm_user"), "lastfm_user", NOW)


@REGISTRY.query(
    "kickstart",
    _LP + """, f AS (SELECT CAST(ts AS DATE) AS d, min(ts) AS ts FROM lp GROUP BY 1)
         SELECT lp.media_file_id, count(*) AS plays FROM lp JOIN f ON CAST(lp.ts AS DATE) = f.d AND lp.ts = f.ts
         GROUP BY 1 ORDER BY plays DESC, max(lp.ts) DESC, lp.media_file_id LIMIT 50""",
)
def kickstart(spark, sf):
    return stats.kickstart(library_plays(spark, sf, "title"), "media_file_id", 50).select("media_file_id", "plays")


@REGISTRY.query(
    "recently_discovered",
    _LP + """SELECT media_file_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS plays FROM lp GROUP BY 1
         HAVING min(ts) >= TIMESTAMP '2025-05-02' ORDER BY min(ts) DESC, media_file_id LIMIT 50""",
)
def recently_discovered(spark, sf):
    out = stats.discovered(library_plays(spark, sf), "media_file_id", NOW - timedelta(days=30), 50, tracks(spark, sf))
    return out.select("media_file_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "plays")


@REGISTRY.query(
    "rediscovered_gems",
    _LP + """SELECT media_file_id, before, again FROM (SELECT media_file_id, max(ts) AS last,
           count(*) FILTER (ts >= TIMESTAMP '2023-06-01' AND ts < TIMESTAMP '2024-06-01') AS before,
           count(*) FILTER (ts >= TIMESTAMP '2024-06-01' AND ts < TIMESTAMP '2025-05-01') AS during,
           count(*) FILTER (ts >= TIMESTAMP '2025-05-01') AS again FROM lp GROUP BY 1) g
         WHERE before > 0 AND during = 0 AND again > 0 ORDER BY last DESC, media_file_id LIMIT 50""",
)
def rediscovered_gems(spark, sf):
    cut = [filters.months_back(NOW, m) for m in (24, 12, 1)]
    return stats.rediscovered(library_plays(spark, sf), "media_file_id", *cut, 50, tracks(spark, sf)).select("media_file_id", "before", "again")


@REGISTRY.query(
    "most_consistent",
    _LP + """SELECT media_file_id, count(*) AS plays, count(DISTINCT CAST(ts AS DATE)) AS days FROM lp GROUP BY 1
         ORDER BY days DESC, plays DESC, media_file_id LIMIT 50""",
)
def most_consistent(spark, sf):
    return stats.consistent(library_plays(spark, sf), "media_file_id", 50, tracks(spark, sf))


@REGISTRY.query(
    "day_of_year_top",
    _LP + """SELECT media_file_id, count(*) AS plays FROM lp WHERE strftime(ts, '%m-%d') = '05-22' GROUP BY 1
         ORDER BY plays DESC, max(ts) DESC, media_file_id LIMIT 50""",
)
def day_of_year_top(spark, sf):
    p = library_plays(spark, sf).where(F.date_format("ts", "MM-dd") == "05-22")
    order = [F.col("plays").desc(), F.col("at").desc(), F.col("media_file_id")]
    return stats.top(p, ["media_file_id"], order, 50, tracks(spark, sf), at=F.max("ts")).drop("at")


@REGISTRY.query(
    "hit_parade",
    _LP + """, w AS (SELECT CAST(ceil((epoch(TIMESTAMP '2025-06-01') - epoch(ts)) / 604800.0) AS INTEGER) AS week, media_file_id, ts FROM lp
           WHERE ts < TIMESTAMP '2025-06-01'),
         c AS (SELECT week, media_file_id, row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, max(ts) DESC, media_file_id) AS rank
               FROM w WHERE week >= 1 AND week <= 52 GROUP BY 1, 2),
         b AS (SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY week, rank) AS k FROM c WHERE rank <= 3)
         SELECT week, CAST(rank AS INTEGER) AS rank, media_file_id FROM b WHERE k = 1""",
)
def hit_parade(spark, sf):
    p = library_plays(spark, sf, start=NOW - timedelta(weeks=53), end=NOW)
    return stats.hit_parade(p, "media_file_id", NOW, known=tracks(spark, sf))


@REGISTRY.query(
    "anniversary_top",
    _LP + """, y AS (SELECT * FROM (VALUES (1, TIMESTAMP '2024-05-02', TIMESTAMP '2024-06-01'), (2, TIMESTAMP '2023-05-02', TIMESTAMP '2023-06-01')) v(y, lo, hi)),
         c AS (SELECT y.y, media_file_id, count(*) AS plays, row_number() OVER (PARTITION BY y.y ORDER BY count(*) DESC, max(ts) DESC, media_file_id) AS k
               FROM lp JOIN y ON lp.ts >= y.lo AND lp.ts < y.hi GROUP BY 1, 2),
         b AS (SELECT *, row_number() OVER (PARTITION BY media_file_id ORDER BY y) AS r FROM c WHERE k <= 10)
         SELECT y AS year_back, media_file_id, plays FROM b WHERE r = 1""",
)
def anniversary_top(spark, sf):
    p = library_plays(spark, sf, start=NOW - timedelta(days=3 * 366), end=NOW)
    return stats.anniversaries(p, spark, "media_file_id", NOW, 2, known=tracks(spark, sf))


_GAPS = """WITH a AS (SELECT strftime(played_at, '%Y-%m') AS month, count(*) AS n FROM scrobbles GROUP BY 1),
  b AS (SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(submission_time), '%Y-%m') AS month, count(*) AS n FROM library_scrobbles GROUP BY 1),
  g AS (SELECT coalesce(a.month, b.month) AS month, coalesce(a.n, 0) AS local, coalesce(b.n, 0) AS library FROM a FULL JOIN b ON a.month = b.month)
"""
_GAP = """greatest(0, local - library) AS gap, CAST(CASE WHEN local > 0 THEN least(100, round(library * 100.0 / local)) ELSE 100 END AS INTEGER) AS coverage"""


def _months(spark, sf):
    per = lambda p: p.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("plays"))
    return stats.coverage(per(local_plays(spark, sf)), per(library_plays(spark, sf)))


@REGISTRY.query("disparity_by_month", _GAPS + f"SELECT month, local, library, {_GAP} FROM g")
def disparity_by_month(spark, sf):
    return _months(spark, sf)


@REGISTRY.query(
    "disparity_by_year",
    _GAPS + f""", y AS (SELECT substr(month, 1, 4) AS year, CAST(sum(local) AS BIGINT) AS local, CAST(sum(library) AS BIGINT) AS library FROM g GROUP BY 1)
         SELECT * FROM (SELECT year, local, library, {_GAP} FROM y) AS z WHERE gap >= 1 ORDER BY gap DESC, year DESC LIMIT 10""",
)
def disparity_by_year(spark, sf):
    return stats.coverage_by_year(_months(spark, sf))
