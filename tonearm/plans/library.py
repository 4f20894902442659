"""Queries over the library: top lists with dates, lookups, aliases, playlists, landed answers, snapshots, recommendations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import aliases, filters, library, matching, playlists, recommend, snapshots, stats, sync
from tonearm.plans import sqltext as q
from tonearm.plans.listening import _LP, FROM, NOW, TO, library_plays, local_plays, tracks
from tonearm.plans.registry import Registry
from tonearm.plans.syncing import _UNMATCHED, _UNMATCHED_PLAYS, _SIDES, _n, _norm_sides, _seed_sources, _unmatched, stamp
from tonearm.session import durable
from tonearm.sources import landing
from tonearm.sources.tables import present, table

REGISTRY = Registry()
_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_WINDOW = "ts >= TIMESTAMP '2024-03-01' AND ts < TIMESTAMP '2024-09-01'"
_YEAR = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01'"
_MAY = "ts >= TIMESTAMP '2025-05-01' AND ts < TIMESTAMP '2025-06-01'"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "media_file", F.col("id").alias("media_file_id"), "title", "artist", "album")


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("first", stamp("first")).withColumn("last", stamp("last"))


_SPAN = f"{_AT.format('min(ts)')} AS first, {_AT.format('max(ts)')} AS last"


@REGISTRY.query(
    "library_top_artists", _LP + f"SELECT artist, count(*) AS plays FROM lp WHERE artist <> '' AND client = 'web' AND {_WINDOW} GROUP BY 1 ORDER BY plays DESC, artist LIMIT 50"
)
def library_top_artists(spark, sf):
    counted = library.per_track(library_plays(spark, sf, start=FROM, end=TO), client="web")
    return library.top(counted, _columns(spark, sf), ["artist"], 50, ["artist"], named="artist")


@REGISTRY.query(
    "library_top_artists_dates",
    _LP + f"SELECT artist, count(*) AS plays, {_SPAN} FROM lp WHERE artist <> '' AND {_YEAR} GROUP BY 1 ORDER BY plays DESC, artist LIMIT 50",
)
def library_top_artists_dates(spark, sf):
    counted = library.per_track(library_plays(spark, sf, start=datetime(2024, 1, 1), end=datetime(2025, 1, 1)), dated=True)
    return _dated(library.top(counted, _columns(spark, sf), ["artist"], 50, ["artist"], named="artist"))


@REGISTRY.query(
    "library_top_tracks_dates",
    _LP + f"SELECT media_file_id, title, artist, album, count(*) AS plays, {_SPAN} FROM lp WHERE {_YEAR} GROUP BY 1, 2, 3, 4 ORDER BY plays DESC, title, media_file_id LIMIT 50",
)
def library_top_tracks_dates(spark, sf):
    counted = library.per_track(library_plays(spark, sf, start=datetime(2024, 1, 1), end=datetime(2025, 1, 1)), dated=True)
    return _dated(library.top(counted, _columns(spark, sf), library.TRACK, 50, ["title", "media_file_id"]))


@REGISTRY.query(
    "library_top_tracks_details",
    _LP + f"SELECT media_file_id, title, artist, album, count(*) AS plays FROM lp WHERE client = 'web' AND {_WINDOW} GROUP BY 1, 2, 3, 4 ORDER BY plays DESC, title, media_file_id LIMIT 50",
)
def library_top_tracks_details(spark, sf):
    counted = library.per_track(library_plays(spark, sf, start=FROM, end=TO), client="web")
    return library.top(counted, _columns(spark, sf), library.TRACK, 50, ["title", "media_file_id"])


@REGISTRY.query(
    "annotated_top_artists",
    f"""SELECT m.artist, CAST(sum(a.play_count) AS BIGINT) AS plays FROM annotation a JOIN media_file m ON m.id = a.item_id
        WHERE a.item_type = 'media_file' AND a.play_count > 0 AND m.artist <> '' AND {_WINDOW.replace('ts', 'a.play_date')} GROUP BY 1 ORDER BY plays DESC, artist LIMIT 50""",
)
def annotated_top_artists(spark, sf):
    notes = table(spark, sf, "annotation", "item_id", "item_type", "play_count", "play_date")
    return library.top(library.per_track_annotated(notes, FROM, TO), _columns(spark, sf), ["artist"], 50, ["artist"], named="artist")


@REGISTRY.query(
    "library_artists_timeline",
    _LP + """, t AS (SELECT artist FROM lp WHERE artist <> '' AND ts >= TIMESTAMP '2024-06-01' AND ts < TIMESTAMP '2025-06-01' GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10),
       c AS (SELECT artist, strftime(ts, '%Y-%m') AS month, count(*) AS plays FROM lp WHERE ts >= TIMESTAMP '2024-06-01' AND ts < TIMESTAMP '2025-06-01' GROUP BY 1, 2)
       SELECT t.artist, m.month, coalesce(c.plays, 0) AS plays FROM t CROSS JOIN
         (SELECT strftime(unnest(generate_series(TIMESTAMP '2024-06-01', TIMESTAMP '2025-05-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) m
         LEFT JOIN c ON c.artist = t.artist AND c.month = m.month""",
)
def library_artists_timeline(spark, sf):
    p = library_plays(spark, sf, start=datetime(2024, 6, 1), end=NOW)
    return library.timeline(p, _columns(spark, sf), stats.month_axis(datetime(2024, 6, 1), datetime(2025, 5, 1)), 10)


def _asked_ids(spark, sf) -> DataFrame:
    """A list of ids in an order of its own: the hundred most matched targets and some that are no track."""
    y = table(spark, sf, "scrobble_sync", "target", "target_id").where(present("target_id"))
    best = stats.top(y, ["target_id"], [F.col("plays").desc(), F.col("target_id")], 100)
    return playlists.ranked(best, [F.col("plays").desc(), "target_id"], "target_id").withColumnRenamed("position", "pos")


_ASKED = """WITH asked AS (SELECT target_id AS id, row_number() OVER (ORDER BY n DESC, target_id) AS pos FROM
    (SELECT target_id, count(*) AS n FROM scrobble_sync WHERE target_id <> '' GROUP BY 1 ORDER BY n DESC, target_id LIMIT 100) x)"""


@REGISTRY.query("track_metadata", _ASKED + " SELECT CAST(pos AS INTEGER) AS pos, m.id, artist, album, nullif(year, 0) AS year, duration FROM asked JOIN media_file m ON m.id = asked.id")
def track_metadata(spark, sf):
    m = table(spark, sf, "media_file", "id", "artist", "album", F.nullif("year", F.lit(0)).alias("year"), "duration")
    return library.lookup(_asked_ids(spark, sf), m, "artist", "album", "year", "duration")


@REGISTRY.query(
    "track_labels",
    _ASKED + " SELECT CAST(pos AS INTEGER) AS pos, m.id, concat_ws(' — ', nullif(artist, ''), nullif(title, '')) AS label FROM asked JOIN media_file m ON m.id = asked.id",
)
def track_labels(spark, sf):
    return library.labels(_asked_ids(spark, sf), table(spark, sf, "media_file", "id", "artist", "title"))


@REGISTRY.query(
    "track_summaries",
    _ASKED + f""" SELECT CAST(pos AS INTEGER) AS pos, m.id, title, artist, album, coalesce(n, 0) AS plays FROM asked JOIN media_file m ON m.id = asked.id LEFT JOIN
        (SELECT media_file_id, count(*) AS n FROM (SELECT media_file_id, TIMESTAMP '1970-01-01' + to_seconds(submission_time) AS ts FROM library_scrobbles) l WHERE {_WINDOW} GROUP BY 1) c
        ON c.media_file_id = m.id""",
)
def track_summaries(spark, sf):
    counted = library.per_track(library_plays(spark, sf, start=FROM, end=TO))
    return library.summarize(_asked_ids(spark, sf), table(spark, sf, "media_file", "id", "title", "artist", "album"), counted)


@REGISTRY.query(
    "orphan_library_tracks",
    "SELECT DISTINCT l.media_file_id AS id FROM library_scrobbles l WHERE l.media_file_id <> '' AND NOT EXISTS (SELECT 1 FROM media_file m WHERE m.id = l.media_file_id)",
)
def orphan_library_tracks(spark, sf):
    ids = table(spark, sf, "library_scrobbles", F.col("media_file_id").alias("id")).where(present("id")).distinct()
    return library.missing_ids(ids.withColumn("pos", F.lit(0)), tracks(spark, sf)).select("id")


@REGISTRY.query(
    "recent_stars",
    f"""SELECT a.user_id, a.item_id, m.title, m.artist, {_AT.format('a.starred_at')} AS starred_at FROM annotation a JOIN media_file m ON m.id = a.item_id
        WHERE a.item_type = 'media_file' AND a.starred AND a.starred_at IS NOT NULL ORDER BY a.starred_at DESC, a.item_id, a.user_id LIMIT 50""",
)
def recent_stars(spark, sf):
    a = table(spark, sf, "annotation", "user_id", "item_id", "item_type", "starred", "starred_at")
    return library.recent_stars(a, table(spark, sf, "media_file", "id", "title", "artist"), 50).withColumn("starred_at", stamp("starred_at"))


@REGISTRY.query(
    "artist_ids_by_name",
    f"""WITH n AS (SELECT DISTINCT artist AS name, {_n('artist')} AS a FROM media_file WHERE artist <> ''),
          i AS (SELECT {_n('name')} AS a, 0 AS rank, id FROM artist UNION ALL SELECT {_n('artist')}, 1, artist_id FROM media_file WHERE artist_id <> ''),
          g AS (SELECT a, rank, count(DISTINCT id) AS n, min(id) AS id FROM i WHERE a <> '' GROUP BY 1, 2),
          b AS (SELECT a, arg_min(n, rank) AS n, arg_min(id, rank) AS id FROM g GROUP BY 1)
        SELECT n.name, b.id AS artist_id FROM n JOIN b ON b.a = n.a WHERE b.n = 1 AND n.a <> ''""",
)
def artist_ids_by_name(spark, sf):
    m = table(spark, sf, "media_file", "artist_id", "artist")
    names = m.where(present("artist")).select(F.col("artist").alias("name")).distinct()
    return library.artist_ids(names, table(spark, sf, "artist", "id", "name"), m)


@REGISTRY.query(
    "user_counts",
    """SELECT coalesce(l.user_id, a.user_id) AS user_id, coalesce(l.n, 0) AS plays, coalesce(a.n, 0) AS played_items FROM
       (SELECT user_id, count(*) AS n FROM library_scrobbles GROUP BY 1) l FULL JOIN (SELECT user_id, count(*) AS n FROM annotation WHERE play_count > 0 GROUP BY 1) a ON a.user_id = l.user_id""",
)
def user_counts(spark, sf):
    return library.user_counts(table(spark, sf, "library_scrobbles", "user_id"), table(spark, sf, "annotation", "user_id", "play_count"))


_FIRST_USER = "(SELECT min(id) FROM library_user WHERE user_name = (SELECT min(user_name) FROM library_user))"


def _first_user(spark, sf) -> str:
    users = table(spark, sf, "library_user", "id", "user_name")
    return library.user_id(users, users.agg(F.min("user_name")).first()[0])


@REGISTRY.query("plays_without_user", f"SELECT id, user_id FROM library_scrobbles WHERE user_id IS DISTINCT FROM {_FIRST_USER}")
def plays_without_user(spark, sf):
    return library.delete_user(table(spark, sf, "library_scrobbles", "id", "user_id"), _first_user(spark, sf))


@REGISTRY.query(
    "reset_counts",
    f"""SELECT ann_id, CASE WHEN user_id = {_FIRST_USER} THEN 0 ELSE play_count END AS play_count,
               CASE WHEN user_id = {_FIRST_USER} THEN NULL ELSE {_AT.format('play_date')} END AS play_date, starred, rating FROM annotation""",
)
def reset_counts(spark, sf):
    a = table(spark, sf, "annotation", "ann_id", "user_id", "play_count", "play_date", "starred", "rating")
    return library.reset_counts(a, _first_user(spark, sf)).select("ann_id", "play_count", stamp("play_date").alias("play_date"), "starred", "rating")


@REGISTRY.query(
    "starred_annotations",
    f"""WITH s AS (SELECT DISTINCT user_id, media_file_id AS item_id FROM library_scrobbles WHERE media_file_id <> ''), t AS (SELECT * FROM annotation WHERE item_type = 'media_file')
        SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.item_id, s.item_id) AS item_id, coalesce(t.starred, FALSE) OR s.user_id IS NOT NULL AS starred,
               {_AT.format("CASE WHEN s.user_id IS NOT NULL AND NOT coalesce(t.starred, FALSE) THEN coalesce(t.starred_at, TIMESTAMP '2025-06-01') ELSE t.starred_at END")} AS starred_at
        FROM t FULL JOIN s ON s.user_id = t.user_id AND s.item_id = t.item_id""",
)
def starred_annotations(spark, sf):
    """Annotations after every track that a user has played is starred."""
    a = table(spark, sf, "annotation", "user_id", "item_id", "item_type", "play_count", "play_date", "rating", "starred", "starred_at")
    s = table(spark, sf, "library_scrobbles", "user_id", F.col("media_file_id").alias("item_id")).where(present("item_id"))
    return sync.add_stars(a, s, filters.moment(NOW)).select("user_id", "item_id", "starred", stamp("starred_at").alias("starred_at"))


_COUPLES = f"""c AS (SELECT s.artist, s.title, count(*) AS plays, list_sort(list_distinct(list(nullif(s.mbid_album, '')))) AS albums {_UNMATCHED} GROUP BY 1, 2),
    cn AS MATERIALIZED (SELECT *, row_number() OVER () AS key, {_n('artist')} AS a, {_n('title')} AS t FROM c),
    m AS MATERIALIZED (SELECT id, mbz_album_id, {_n('artist')} AS a, {_n('title')} AS t FROM media_file),
    have AS (SELECT DISTINCT a, t FROM cn WHERE a LIKE 'a%' AND t <> '')"""


@REGISTRY.query(
    "track_aliases",
    f"""WITH {_COUPLES}, o AS (SELECT * FROM cn WHERE t <> '' AND (a, t) NOT IN (SELECT (a, t) FROM m WHERE a <> '' AND t <> '')),
          al AS (SELECT key, t, unnest(albums) AS b, generate_subscripts(albums, 1) AS pos FROM o),
          h AS (SELECT al.key, 0 AS s, pos, m.id, 0 AS d FROM al JOIN m ON m.mbz_album_id = al.b AND m.t = al.t
                UNION ALL SELECT al.key, 1, pos, m.id, levenshtein(al.t, m.t) FROM al JOIN m ON m.mbz_album_id = al.b WHERE m.t <> '' AND levenshtein(al.t, m.t) <= 5
                UNION ALL SELECT o.key, 2, 1, m.id, levenshtein(o.t, m.t) FROM o JOIN m ON m.a = o.a WHERE o.a <> '' AND m.t <> '' AND levenshtein(o.t, m.t) <= 2),
          w AS (SELECT *, min(d) OVER (PARTITION BY key, s, pos) AS least FROM h),
          g AS (SELECT key, s, pos, count(DISTINCT id) AS n, min(id) AS id FROM w WHERE d = least GROUP BY 1, 2, 3),
          b AS (SELECT key, arg_min(CASE WHEN n = 1 THEN id END, CASE WHEN n = 1 THEN (s, pos) END) AS id, min(CASE WHEN n = 1 THEN (s, pos) END)[1] AS s, max(n) > 1 AS ambiguous FROM g GROUP BY 1)
        SELECT cn.artist, cn.title, cn.plays, b.id, ['album-exact', 'album-fuzzy', 'artist-fuzzy'][b.s + 1] AS strategy,
               CASE WHEN o.key IS NULL THEN 'resolvable' WHEN b.id IS NOT NULL THEN 'alias' WHEN b.ambiguous THEN 'ambiguous' ELSE 'none' END AS state
        FROM cn LEFT JOIN o ON o.key = cn.key LEFT JOIN b ON b.key = cn.key WHERE cn.t <> ''""",
)
def track_aliases(spark, sf):
    u = _unmatched(spark, sf, "artist", "title", "mbid_album")
    albums = F.array_sort(F.collect_set(F.nullif("mbid_album", F.lit("")))).alias("albums")
    couples = u.groupBy("artist", "title").agg(F.count(F.lit(1)).alias("plays"), albums)
    owned = table(spark, sf, "media_file", "id", "artist", "title", "mbz_album_id")
    none = spark.createDataFrame([], "a string, t string")
    return aliases.track_aliases(durable(couples), owned, none)


@REGISTRY.query(
    "nearest_titles",
    f"""WITH {_SIDES.replace('PLAYS', _UNMATCHED_PLAYS)}, asked AS (SELECT DISTINCT a, t FROM r WHERE a <> '' AND t <> ''),
          own AS (SELECT a, t FROM m WHERE a <> '' AND t <> '' UNION SELECT aa, t FROM m WHERE aa <> '' AND t <> ''),
          n AS (SELECT asked.a, asked.t, own.t AS near, CAST(levenshtein(asked.t, own.t) AS INTEGER) AS distance,
                       row_number() OVER (PARTITION BY asked.a, asked.t ORDER BY levenshtein(asked.t, own.t), own.t) AS k
                FROM asked JOIN own ON own.a = asked.a AND levenshtein(asked.t, own.t) <= 3)
        SELECT a, t, near, distance, CAST(k AS INTEGER) AS k FROM n WHERE k <= 3""",
)
def nearest_titles(spark, sf):
    asked, owned = _norm_sides(spark, sf, _unmatched(spark, sf, "artist", "title", "album", "mbid_track"))
    return library.nearest_titles(asked, owned, 3)


@REGISTRY.query(
    "loves_to_push",
    """WITH st AS (SELECT trim(m.artist) AS artist, trim(m.title) AS title FROM annotation a JOIN media_file m ON m.id = a.item_id WHERE a.item_type = 'media_file' AND a.starred),
         lv AS (SELECT DISTINCT lower(trim(artist)) AS a, lower(trim(title)) AS t FROM scrobbles WHERE loved)
       SELECT x.artist, x.title FROM (SELECT min((artist, title)) AS s FROM st WHERE artist <> '' AND title <> '' AND (lower(artist), lower(title)) NOT IN (SELECT (a, t) FROM lv WHERE a <> '' AND t <> '')
             GROUP BY lower(artist), lower(title)) g, LATERAL (SELECT g.s[1] AS artist, g.s[2] AS title) x""",
)
def loves_to_push(spark, sf):
    stars = table(spark, sf, "annotation", "item_id", "item_type", "starred").where("starred AND item_type = 'media_file'")
    starred = stars.join(table(spark, sf, "media_file", F.col("id").alias("item_id"), "artist", "title"), "item_id")
    loved = table(spark, sf, "scrobbles", "artist", "title", "loved").where("loved").select("artist", "title").distinct()
    return sync.loves_to_push(starred.select("artist", "title"), loved)


_BY_ID = "(SELECT x AS mbid, min(id) AS id FROM (SELECT id, mbz_track_id AS x FROM media_file UNION ALL SELECT id, mbz_recording_id FROM media_file) z WHERE x <> '' GROUP BY x)"


@REGISTRY.query(
    "loves_pulled",
    f"""WITH {_SIDES.replace('PLAYS', '(SELECT artist, title, NULL::VARCHAR AS album, mbid_track FROM scrobbles WHERE loved)')},
          c AS (SELECT k, arg_min(id, (p, rank, id)) AS id FROM q JOIN e USING (mode, a, t) WHERE a <> '' AND t <> '' GROUP BY 1)
        SELECT r.artist, r.title, r.mbid_track AS mbid, coalesce(i.id, c.id) AS item_id FROM r LEFT JOIN {_BY_ID} i ON i.mbid = r.mbid_track LEFT JOIN c ON c.k = r.k""",
)
def loves_pulled(spark, sf):
    loved = table(spark, sf, "scrobbles", "artist", "title", "mbid_track", "loved").where("loved").select("artist", "title", F.lit(None).cast("string").alias("album"), "mbid_track").distinct()
    requests, owned = _norm_sides(spark, sf, durable(loved))
    requests = durable(requests)
    ids = matching.by_identifier(requests, owned).join(requests.select("request", "mbid_track"), "request")
    by_id = ids.select(F.col("mbid_track").alias("mbid"), F.col("id").alias("item_id")).distinct()
    names = matching.by_couple(requests, owned).join(requests.select("request", "artist", "title"), "request")
    by_couple = names.select("artist", "title", F.col("id").alias("item_id")).distinct()
    return sync.pull_loves(loved.select("artist", "title", F.col("mbid_track").alias("mbid")), by_id, by_couple)


def _previous(lo: datetime, hi: datetime):
    def build(spark, sf):
        counted = library.per_track(library_plays(spark, sf, start=lo, end=hi), dated=True)
        return library.top(counted, _columns(spark, sf), library.TRACK, 50, ["title", "media_file_id"])

    return build


def _top_sql(where: str) -> str:
    return _LP + f"""SELECT row_number() OVER (ORDER BY plays DESC, title, media_file_id) AS position, media_file_id AS id FROM
        (SELECT media_file_id, title, count(*) AS plays FROM lp WHERE {where} GROUP BY 1, 2 ORDER BY plays DESC, title, media_file_id LIMIT 50) t"""


def _as_int(sql: str) -> str:
    return f"SELECT CAST(position AS INTEGER) AS position, id FROM ({sql}) AS p"


@REGISTRY.query("playlist_year", _as_int(_top_sql(_YEAR)))
def playlist_year(spark, sf):
    best = _previous(datetime(2024, 1, 1), datetime(2025, 1, 1))(spark, sf)
    return playlists.ranked(best, [F.col("plays").desc(), "title", "media_file_id"])


@REGISTRY.query("playlist_month", _as_int(_top_sql(_MAY)))
def playlist_month(spark, sf):
    best = _previous(datetime(2025, 5, 1), datetime(2025, 6, 1))(spark, sf)
    return playlists.ranked(best, [F.col("plays").desc(), "title", "media_file_id"])


@REGISTRY.query(
    "playlist_very_old_gems",
    """SELECT DISTINCT ON (a.item_id) a.item_id AS id FROM annotation a JOIN media_file m ON m.id = a.item_id WHERE a.item_type = 'media_file' AND a.play_count >= 2
       AND a.play_date < TIMESTAMP '2023-06-01'""",
)
def playlist_very_old_gems(spark, sf):
    """Tracks played often enough and not for long; all of them, in a random order that the comparison leaves out."""
    a = table(spark, sf, "annotation", "item_id", "item_type", "play_count", "play_date").where("item_type = 'media_file' AND play_count >= 2")
    old = filters.between(a, "play_date", None, filters.months_back(NOW, 24)).select(F.col("item_id").alias("id")).distinct()
    return old.join(tracks(spark, sf), "id", "left_semi")


@REGISTRY.query(
    "playlist_starred", "SELECT DISTINCT a.item_id AS id FROM annotation a JOIN media_file m ON m.id = a.item_id WHERE a.item_type = 'media_file' AND a.starred"
)
def playlist_starred(spark, sf):
    n = table(spark, sf, "media_file", "id").count()
    a = table(spark, sf, "annotation", "item_id", "item_type", "starred")
    return playlists.random_stars(a, tracks(spark, sf), n, 7).select("id")


_SIMILAR = """sim AS (SELECT a.id AS query, b.id AS near, abs(a.duration - b.duration) * 1.0 AS distance,
      row_number() OVER (PARTITION BY a.id ORDER BY abs(a.duration - b.duration), b.id) AS k
      FROM media_file a JOIN media_file b ON a.genre = b.genre AND a.year = b.year AND a.id <> b.id WHERE a.genre <> '' AND a.year > 0 AND a.id IN (SELECT id FROM seeds))"""


@REGISTRY.query(
    "playlist_mix_of_week",
    _LP + f""", seeds AS (SELECT media_file_id AS id, row_number() OVER (ORDER BY n DESC, last DESC, media_file_id) AS position FROM
          (SELECT media_file_id, count(*) AS n, max(ts) AS last FROM lp WHERE ts >= TIMESTAMP '2025-05-25' AND ts < TIMESTAMP '2025-06-01' GROUP BY 1 ORDER BY n DESC, last DESC, media_file_id LIMIT 15) s),
        {_SIMILAR}, n AS (SELECT media_file_id AS id, count(*) AS n FROM library_scrobbles GROUP BY 1),
        fresh AS (SELECT near AS id, count(*) AS hits, min(distance) AS distance FROM sim WHERE k <= 20 AND near NOT IN (SELECT id FROM seeds) GROUP BY 1),
        f AS (SELECT fresh.*, row_number() OVER (ORDER BY hits DESC, distance, fresh.id) AS position FROM fresh LEFT JOIN n ON n.id = fresh.id WHERE coalesce(n.n, 0) <= 5),
        b AS (SELECT position, id, 0 AS part FROM seeds WHERE position <= 10 UNION ALL SELECT position, id, 1 FROM f WHERE position <= 10)
      SELECT CAST(row_number() OVER (ORDER BY part, position) AS INTEGER) AS position, id FROM b WHERE id IN (SELECT id FROM media_file)""",
)
def playlist_mix_of_week(spark, sf):
    """Similar tracks are landed by a service; here they are the nearest in length of the same genre and year."""
    p = library_plays(spark, sf, start=NOW - timedelta(days=7), end=NOW)
    order = [F.col("plays").desc(), F.col("last").desc(), F.col("media_file_id")]
    best = stats.top(p, ["media_file_id"], order, 15, tracks(spark, sf), last=F.max("ts"))
    seeds = durable(playlists.ranked(best, order))
    m = table(spark, sf, "media_file", "id", "genre", "year", "duration").where(present("genre") & (F.col("year") > 0))
    asked = m.join(F.broadcast(seeds.select("id")), "id").select(F.col("id").alias("query"), "genre", "year", F.col("duration").alias("d"))
    met = m.join(F.broadcast(asked), ["genre", "year"]).where("id <> query")
    from pyspark.sql import Window

    place = Window.partitionBy("query").orderBy("distance", "near")
    similar = met.select("query", F.col("id").alias("near"), F.abs(F.col("duration") - F.col("d")).cast("double").alias("distance"))
    similar = similar.withColumn("k", F.row_number().over(place)).where("k <= 20")
    counts = table(spark, sf, "library_scrobbles", F.col("media_file_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return playlists.mix_of_week(seeds, similar, counts, tracks(spark, sf), 20)


def _pages(rows: DataFrame, by: list[str], head: str, item: str) -> DataFrame:
    """Raw answers as a service gives them, one for each key, from rows that hold the items in a struct ``t``."""
    listed = F.struct(F.collect_list("t").alias(item)).alias(head)
    return rows.groupBy(*by).agg(F.to_json(F.struct(listed)).alias("value"))


@REGISTRY.query(
    "landed_loves",
    f"""SELECT lastfm_user, artist, title, nullif(mbid_track, '') AS mbid_track, {_AT.format('played_at')} AS loved_at
        FROM (SELECT DISTINCT lastfm_user, coalesce(artist, '') AS artist, coalesce(title, '') AS title, mbid_track, played_at FROM scrobbles WHERE loved) s""",
)
def landed_loves(spark, sf):
    """Loved plays written as pages of a day and read back."""
    s = table(spark, sf, "scrobbles", "lastfm_user", "artist", "title", "mbid_track", "played_at", "loved").where("loved").distinct()
    uts = F.unix_timestamp("played_at").cast("string")
    t = F.struct(F.col("title").alias("name"), F.col("mbid_track").alias("mbid"), F.struct(F.col("artist").alias("name")).alias("artist"), F.struct(uts.alias("uts")).alias("date"))
    pages = _pages(s.select("lastfm_user", F.to_date("played_at").alias("day"), t.alias("t")), ["lastfm_user", "day"], "lovedtracks", "track")
    return landing.loved_tracks(pages.drop("day")).withColumn("loved_at", stamp("loved_at"))


@REGISTRY.query(
    "landed_plays",
    f"""SELECT lastfm_user, artist, title, album, nullif(mbid_track, '') AS mbid_track, {_AT.format('played_at')} AS played_at, loved FROM scrobbles""",
)
def landed_plays(spark, sf):
    """Every play written as pages of a user and day and read back."""
    s = table(spark, sf, "scrobbles", "lastfm_user", "artist", "title", "album", "mbid_track", "played_at", "loved")
    text = lambda c: F.struct(F.col(c).alias("#text"), F.lit("").alias("mbid"))
    t = F.struct(
        text("artist").alias("artist"), text("album").alias("album"), F.col("title").alias("name"), F.col("mbid_track").alias("mbid"),
        F.when(F.col("loved"), "1").otherwise("0").alias("loved"), F.struct(F.unix_timestamp("played_at").cast("string").alias("uts")).alias("date"),
    )
    pages = _pages(s.select("lastfm_user", F.to_date("played_at").alias("day"), t.alias("t")), ["lastfm_user", "day"], "recenttracks", "track")
    read = landing.recent_tracks(pages.drop("day"))
    return read.select("lastfm_user", "artist", "title", "album", "mbid_track", stamp("played_at").alias("played_at"), "loved")


_GENRES = """SELECT a.artist AS seed, b.artist, count(*) / 10.0 AS match FROM (SELECT DISTINCT genre, artist FROM media_file WHERE genre <> '' AND artist <> '') a
    JOIN (SELECT DISTINCT genre, artist FROM media_file WHERE genre <> '' AND artist <> '') b ON a.genre = b.genre AND a.artist <> b.artist
    JOIN (SELECT artist FROM scrobbles WHERE artist <> '' GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10) t ON t.artist = a.artist GROUP BY 1, 2"""


def _similar(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(seeds, answers): the ten most played artists, and what a service would answer about artists like them."""
    s = table(spark, sf, "scrobbles", "artist").where(present("artist"))
    best = stats.top(s, ["artist"], [F.col("plays").desc(), F.col("artist")], 10).select("artist", F.lit(1.0).alias("weight"))
    g = table(spark, sf, "media_file", "genre", "artist").where(present("genre") & present("artist")).distinct()
    own = g.join(F.broadcast(best.select("artist")), "artist").select("genre", F.col("artist").alias("seed"))
    near = own.join(g, "genre").where("seed <> artist").groupBy("seed", "artist").agg((F.count(F.lit(1)) / 10.0).alias("match"))
    t = F.struct(F.col("artist").alias("name"), F.lit("").alias("mbid"), F.col("match").cast("string").alias("match"))
    return best, _pages(near.select("seed", t.alias("t")), ["seed"], "similarartists", "artist")


@REGISTRY.query("landed_similar_artists", f"SELECT seed, trim(artist) AS artist, match FROM ({_GENRES}) AS s WHERE trim(artist) <> ''")
def landed_similar_artists(spark, sf):
    return landing.similar_artists(_similar(spark, sf)[1]).select("seed", "artist", "match")


@REGISTRY.query(
    "recommended_artists",
    f"""WITH s AS ({_GENRES}), t AS (SELECT artist FROM scrobbles WHERE artist <> '' GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10),
          g AS (SELECT min(trim(artist)) AS artist, sum(match) AS score, lower(trim(artist)) AS key FROM s GROUP BY 3),
          away AS (SELECT {_n('artist')} AS a FROM t UNION SELECT {_n('name')} FROM artist WHERE mbz_artist_id <> '')
        SELECT artist, round(score, 6) AS score FROM g WHERE {_n('artist')} <> '' AND {_n('artist')} NOT IN (SELECT a FROM away WHERE a IS NOT NULL) ORDER BY g.score DESC, artist LIMIT 30""",
)
def recommended_artists(spark, sf):
    """Artists like the most played ones, without those, and without the library's artists that have an identifier."""
    best, pages = _similar(spark, sf)
    found = recommend.from_similar(best, landing.similar_artists(pages))
    merged = recommend.merge([found.select("artist", "score", F.lit(None).cast("string").alias("mbid"), F.lit("similar").alias("source"))], best.select("artist").limit(0), None)
    owned = table(spark, sf, "artist", F.col("name").alias("artist"), "mbz_artist_id").where(present("mbz_artist_id"))
    none = spark.createDataFrame([], "query string, pos int, mbid string, score int")
    out = recommend.recommend(merged, none, owned, best.select("artist"), spark.createDataFrame([], "mbid string"), 30)
    return out.select("artist", F.round("score", 6).alias("score"))


@REGISTRY.query(
    "recording_scores",
    """SELECT min(artist) AS artist, mbid_artist AS mbid, round(sum(score) * 100, 4) AS score FROM
       (SELECT min(s.artist) AS artist, s.mbid_artist, s.mbid_track, r.score FROM scrobbles s JOIN
          (SELECT mbid_track, count(*) / 1000.0 AS score FROM scrobbles WHERE mbid_track <> '' GROUP BY 1) r ON r.mbid_track = s.mbid_track
        WHERE s.mbid_artist <> '' GROUP BY s.mbid_artist, s.mbid_track, r.score) x GROUP BY mbid_artist""",
)
def recording_scores(spark, sf):
    """Artists by the recordings that a service recommends, here those of the log with their shares of plays."""
    s = table(spark, sf, "scrobbles", "artist", "mbid_artist", "mbid_track").where(present("mbid_track"))
    recordings = s.groupBy(F.col("mbid_track").alias("recording")).agg((F.count(F.lit(1)) / 1000.0).alias("score"))
    artists = s.where(present("mbid_artist")).groupBy(F.col("mbid_track").alias("recording"), F.col("mbid_artist").alias("mbid")).agg(F.min("artist").alias("name"))
    return recommend.from_recordings(recordings, artists).withColumn("score", F.round("score", 4))


@REGISTRY.query(
    "snapshot_read_back",
    """SELECT 'all' AS key, artist, count(*) AS plays FROM scrobbles WHERE artist <> '' GROUP BY artist ORDER BY plays DESC, artist LIMIT 25""",
)
def snapshot_read_back(spark, sf):
    """The top artists of a stored snapshot, as the unfiltered list shows them."""
    p = local_plays(spark, sf, "artist")
    best = lambda: stats.top(p.where(present("artist")), ["artist"], [F.col("plays").desc(), F.col("artist")], 25)
    counts = p.agg(F.count(F.lit(1)).alias("plays"), F.countDistinct("artist").alias("artists"))
    order = {"top_artists": [F.col("plays").desc(), F.col("artist")]}
    fresh = snapshots.compute("all", {"counts": counts, "top_artists": best()}, NOW, order)
    held = durable(snapshots.store(spark.createDataFrame([], snapshots.SCHEMA), fresh))
    shown = snapshots.top_list(held, "all", "top_artists", best, filtered=False)
    return shown.select(F.lit("all").alias("key"), "artist", "plays")


@REGISTRY.query(
    "daily_history",
    """SELECT strftime(day, '%Y-%m-%d') AS day, plays FROM (SELECT CAST(played_at AS DATE) AS day, count(*) AS plays FROM scrobbles GROUP BY 1 ORDER BY day DESC LIMIT 30) d""",
)
def daily_history(spark, sf):
    """The newest thirty rows of a daily history, its last day recorded twice."""
    per = local_plays(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("plays"))
    per = durable(per)
    last = per.agg(F.max("day")).first()[0]
    if last is None:
        return per.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    wrong = per.where(F.col("day") == F.lit(last)).select("day", (F.col("plays") + 1).alias("plays"))
    log = per.where(F.col("day") != F.lit(last)).unionByName(wrong)
    log = snapshots.record_day(log, str(last), per.where(F.col("day") == F.lit(last)).select("plays"))
    return library.history(log, 30).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@REGISTRY.query("unmatched_search", f"SELECT s.id {_UNMATCHED} AND (lower(s.artist) LIKE '%the%' OR lower(s.title) LIKE '%the%')")
def unmatched_search(spark, sf):
    return filters.search(_unmatched(spark, sf, "artist", "title"), ["artist", "title"], "The ").select("id")
