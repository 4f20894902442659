"""Queries over sync state, matching, upserts, streams and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import filters, matching, pipeline, recommend, sync
from tonearm.operators.stats import top
from tonearm.plans.listening import NOW, library_plays
from tonearm.plans import sqltext as q
from tonearm.plans.registry import Registry
from tonearm.session import durable
from tonearm.sources.tables import epoch_seconds, present, table
from tonearm.streaming import ingest

REGISTRY = Registry()
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_UNMATCHED = "FROM scrobble_sync y JOIN scrobbles s ON s.id = y.scrobble_id WHERE y.target = 'navidrome' AND y.status = 'unmatched'"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _own(spark: SparkSession, sf: str, target: str = "navidrome") -> DataFrame:
    y = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status", "target_id", "strategy")
    return y.where(F.col("target") == target)


def _unmatched(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    y = _own(spark, sf).where(F.col("status") == "unmatched").select(F.col("scrobble_id").alias("id"))
    return table(spark, sf, "scrobbles", "id", *columns).join(y, "id")


@REGISTRY.query(
    "history_with_status",
    f"""SELECT s.id, s.artist, s.title, {_TS.format('s.played_at')} AS played_at, y.status FROM scrobbles s
        LEFT JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome' ORDER BY s.played_at DESC, s.id DESC LIMIT 100 OFFSET 200""",
)
def history_with_status(spark, sf):
    s = table(spark, sf, "scrobbles", "id", "artist", "title", "played_at")
    # A play has at most one row per target: the page is cut first, and only its rows are looked up.
    page = filters.page(s, [F.col("played_at").desc(), F.col("id").desc()], 100, 200)
    rows = _own(spark, sf).select(F.col("scrobble_id").alias("id"), "status").join(F.broadcast(page.select("id")), "id")
    return page.join(F.broadcast(rows), "id", "left").withColumn("played_at", stamp("played_at"))


@REGISTRY.query(
    "history_filtered",
    """SELECT coalesce(y.status, 'none') AS status, count(*) AS n FROM scrobbles s
       LEFT JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome'
       WHERE s.played_at >= TIMESTAMP '2024-01-01' AND s.played_at < TIMESTAMP '2025-01-01' AND lower(s.artist) LIKE '%the%'
         AND (y.status = 'unmatched' OR y.status IS NULL) GROUP BY 1""",
)
def history_filtered(spark, sf):
    s = table(spark, sf, "scrobbles", "id", "artist", "title", "played_at", "lastfm_user")
    h = s.join(_own(spark, sf).select(F.col("scrobble_id").alias("id"), "status"), "id", "left")
    h = filters.history_filter(h, artist="the", status="unmatched", year=2024)
    return h.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("sync_status_counts", "SELECT target, status, count(*) AS n FROM scrobble_sync GROUP BY target, status")
def sync_status_counts(spark, sf):
    return table(spark, sf, "scrobble_sync", "target", "status").groupBy("target", "status").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "pending_count",
    """SELECT count(*) AS n FROM scrobbles s LEFT JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome'
       WHERE y.status IS NULL OR y.status = 'pending'""",
)
def pending_count(spark, sf):
    y = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status")
    return sync.pending(table(spark, sf, "scrobbles", "id"), y, "navidrome").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "prepare_pending",
    """SELECT s.id AS scrobble_id, 'strawberry' AS target, 'pending' AS status FROM scrobbles s
       WHERE NOT EXISTS (SELECT 1 FROM scrobble_sync y WHERE y.scrobble_id = s.id AND y.target = 'strawberry')""",
)
def prepare_pending(spark, sf):
    return sync.prepare_pending(table(spark, sf, "scrobbles", "id"), table(spark, sf, "scrobble_sync", "scrobble_id", "target"), "strawberry")


@REGISTRY.query(
    "pending_plays",
    f"""SELECT s.id, s.artist, s.title, {_TS.format('s.played_at')} AS played_at FROM scrobbles s
        JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome' AND y.status = 'pending'""",
)
def pending_plays(spark, sf):
    y = _own(spark, sf).where(F.col("status") == "pending").select(F.col("scrobble_id").alias("id"))
    return table(spark, sf, "scrobbles", "id", "artist", "title", "played_at").join(y, "id").withColumn("played_at", stamp("played_at"))


@REGISTRY.query(
    "unmatched_by_period",
    f"SELECT strftime(s.played_at, '%Y-%m') AS period, count(*) AS n {_UNMATCHED} GROUP BY 1",
)
def unmatched_by_period(spark, sf):
    u = _unmatched(spark, sf, "played_at")
    return u.groupBy(F.date_format("played_at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(
    "unmatched_aggregates",
    f"""SELECT s.artist, s.title, s.album, count(*) AS plays, {_TS.format('max(s.played_at)')} AS last {_UNMATCHED}
        AND s.played_at >= TIMESTAMP '2024-01-01' AND s.played_at < TIMESTAMP '2025-01-01'
        GROUP BY 1, 2, 3 ORDER BY plays DESC, max(s.played_at) DESC, s.artist, s.title, s.album NULLS FIRST LIMIT 50""",
)
def unmatched_aggregates(spark, sf):
    u = filters.period(_unmatched(spark, sf, "artist", "title", "album", "played_at"), "played_at", "2024")
    order = [F.col("plays").desc(), F.col("at").desc(), F.col("artist"), F.col("title"), F.col("album").asc_nulls_first()]
    return top(u, ["artist", "title", "album"], order, 50, at=F.max("played_at")).withColumn("last", stamp("at")).drop("at")


@REGISTRY.query(
    "unmatched_couples",
    f"""SELECT s.artist, s.title, string_agg(DISTINCT nullif(s.mbid_album, ''), ',' ORDER BY nullif(s.mbid_album, '')) AS albums, count(*) AS plays
        {_UNMATCHED} GROUP BY 1, 2""",
)
def unmatched_couples(spark, sf):
    u = _unmatched(spark, sf, "artist", "title", "mbid_album")
    ids = F.array_sort(F.collect_set(F.nullif("mbid_album", F.lit(""))))
    g = u.groupBy("artist", "title").agg(ids.alias("ids"), F.count(F.lit(1)).alias("plays"))
    return g.select("artist", "title", F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("albums"), "plays")


@REGISTRY.query("unmatched_artist_mbids", f"SELECT s.artist, s.mbid_artist, count(*) AS plays {_UNMATCHED} AND s.mbid_artist <> '' GROUP BY 1, 2")
def unmatched_artist_mbids(spark, sf):
    u = _unmatched(spark, sf, "artist", "mbid_artist").where(present("mbid_artist"))
    return u.groupBy("artist", "mbid_artist").agg(F.count(F.lit(1)).alias("plays"))


@REGISTRY.query("unmatched_top_artists", f"SELECT s.artist, count(*) AS plays {_UNMATCHED} GROUP BY 1 ORDER BY plays DESC, s.artist LIMIT 15")
def unmatched_top_artists(spark, sf):
    return top(_unmatched(spark, sf, "artist"), ["artist"], [F.col("plays").desc(), F.col("artist")], 15)


@REGISTRY.query(
    "unmatched_top_albums",
    f"""SELECT s.album, s.artist, min(coalesce(nullif(s.album_artist, ''), s.artist)) AS credit, count(*) AS plays {_UNMATCHED} AND s.album <> ''
        GROUP BY 1, 2 ORDER BY plays DESC, s.album, s.artist LIMIT 15""",
)
def unmatched_top_albums(spark, sf):
    u = _unmatched(spark, sf, "artist", "album", "album_artist").where(present("album"))
    credit = F.min(F.coalesce(F.nullif("album_artist", F.lit("")), "artist"))
    return top(u, ["album", "artist"], [F.col("plays").desc(), F.col("album"), F.col("artist")], 15, credit=credit)


@REGISTRY.query(
    "recent_library_plays",
    """SELECT l.id, coalesce(m.title, '') AS title, coalesce(m.artist, '') AS artist FROM library_scrobbles l LEFT JOIN media_file m ON m.id = l.media_file_id
       ORDER BY l.submission_time DESC, l.id DESC LIMIT 100""",
)
def recent_library_plays(spark, sf):
    p = library_plays(spark, sf).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(100)
    tracks = table(spark, sf, "media_file", F.col("id").alias("media_file_id"), "title", "artist")
    joined = tracks.join(p, "media_file_id", "right")
    return joined.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist"))


@REGISTRY.query(
    "starred_tracks",
    """SELECT a.user_id, m.id, m.title, m.artist, m.mbz_recording_id FROM annotation a JOIN media_file m ON m.id = a.item_id
       WHERE a.item_type = 'media_file' AND a.starred""",
)
def starred_tracks(spark, sf):
    a = table(spark, sf, "annotation", "user_id", "item_id", "item_type", "starred").where("starred AND item_type = 'media_file'")
    m = table(spark, sf, "media_file", F.col("id").alias("item_id"), "title", "artist", "mbz_recording_id")
    return a.join(m, "item_id").select("user_id", F.col("item_id").alias("id"), "title", "artist", "mbz_recording_id")


@REGISTRY.query(
    "never_played",
    """SELECT m.id FROM media_file m WHERE NOT EXISTS (SELECT 1 FROM annotation a WHERE a.item_id = m.id AND a.item_type = 'media_file' AND a.play_count > 0)""",
)
def never_played(spark, sf):
    a = table(spark, sf, "annotation", F.col("item_id").alias("id"), "item_type", "play_count").where("item_type = 'media_file' AND play_count > 0")
    return table(spark, sf, "media_file", "id").join(a, "id", "left_anti")


@REGISTRY.query(
    "loved_and_forgotten",
    f"""SELECT a.ann_id, a.item_id, a.play_count, {_TS.format('a.play_date')} AS play_date FROM annotation a JOIN media_file m ON m.id = a.item_id
        WHERE a.item_type = 'media_file' AND a.play_count >= 2 AND a.play_date < TIMESTAMP '2024-06-01'
        ORDER BY a.play_count DESC, a.play_date, a.ann_id LIMIT 50""",
)
def loved_and_forgotten(spark, sf):
    a = table(spark, sf, "annotation", "ann_id", "item_id", "item_type", "play_count", "play_date")
    a = a.where((F.col("item_type") == "media_file") & (F.col("play_count") >= 2))
    a = filters.between(a, "play_date", None, filters.months_back(NOW, 12)).join(table(spark, sf, "media_file", F.col("id").alias("item_id")), "item_id", "left_semi")
    out = a.orderBy(F.col("play_count").desc(), "play_date", "ann_id").limit(50)
    return out.select("ann_id", "item_id", "play_count", stamp("play_date").alias("play_date"))


@REGISTRY.query(
    "play_counts_with_zero",
    "SELECT m.id, count(l.id) AS plays FROM media_file m LEFT JOIN library_scrobbles l ON l.media_file_id = m.id GROUP BY m.id",
)
def play_counts_with_zero(spark, sf):
    n = table(spark, sf, "library_scrobbles", F.col("media_file_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "media_file", "id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("plays"))


@REGISTRY.query(
    "missing_target_ids",
    """SELECT DISTINCT y.target_id FROM scrobble_sync y WHERE y.target = 'navidrome' AND y.target_id <> ''
       AND NOT EXISTS (SELECT 1 FROM media_file m WHERE m.id = y.target_id)""",
)
def missing_target_ids(spark, sf):
    ids = _own(spark, sf).where(present("target_id")).select("target_id").distinct()
    return ids.join(table(spark, sf, "media_file", F.col("id").alias("target_id")), "target_id", "left_anti")


@REGISTRY.query(
    "tracks_without_identifiers",
    """SELECT id, artist, album, title FROM media_file WHERE coalesce(mbz_track_id, '') = '' AND coalesce(mbz_recording_id, '') = ''
       ORDER BY artist, album, title, id LIMIT 100""",
)
def tracks_without_identifiers(spark, sf):
    m = filters.without_identifiers(table(spark, sf, "media_file", "id", "artist", "album", "title", "mbz_track_id", "mbz_recording_id"))
    return filters.page(m.select("id", "artist", "album", "title"), ["artist", "album", "title", "id"], 100)


@REGISTRY.query("tracks_by_album_mbid", "SELECT mbz_album_id, count(*) AS n, min(id) AS first FROM media_file WHERE mbz_album_id <> '' GROUP BY 1")
def tracks_by_album_mbid(spark, sf):
    m = table(spark, sf, "media_file", "id", "mbz_album_id").where(present("mbz_album_id"))
    return m.groupBy("mbz_album_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@REGISTRY.query(
    "artist_names_by_mbid",
    "SELECT mbz_artist_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM artist WHERE mbz_artist_id <> '' GROUP BY 1",
)
def artist_names_by_mbid(spark, sf):
    a = table(spark, sf, "artist", "name", "mbz_artist_id").where(present("mbz_artist_id"))
    return a.groupBy("mbz_artist_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


@REGISTRY.query(
    "library_near_repeats",
    """SELECT DISTINCT a.id FROM library_scrobbles a JOIN library_scrobbles b ON a.user_id = b.user_id AND a.media_file_id = b.media_file_id AND a.id <> b.id
       AND abs(a.submission_time - b.submission_time) <= 60 AND b.id < a.id WHERE a.media_file_id <> ''""",
)
def library_near_repeats(spark, sf):
    """Library plays with an earlier-numbered play of the same user and track within a minute."""
    l = table(spark, sf, "library_scrobbles", "id", "user_id", "media_file_id", F.col("submission_time").alias("t")).where(present("media_file_id"))
    l = l.select("id", F.concat_ws("|", "user_id", "media_file_id").alias("entity"), "t")
    slot = F.floor(F.col("t") / 60)
    around = l.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    there = l.select("entity", F.col("t").alias("ot"), F.col("id").alias("oid"), slot.alias("slot"))
    met = around.join(there, ["entity", "slot"]).where((F.col("oid") < F.col("id")) & (F.abs(F.col("t") - F.col("ot")) <= 60))
    return met.select("id").distinct()


@REGISTRY.query(
    "plays_near_library",
    """SELECT DISTINCT p.id FROM (SELECT s.id, u.id AS user_id, y.target_id, epoch(s.played_at) AS t FROM scrobbles s
         JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome' AND y.status = 'matched' JOIN library_user u ON u.user_name = s.lastfm_user) p
       JOIN library_scrobbles l ON l.user_id = p.user_id AND l.media_file_id = p.target_id AND abs(l.submission_time - p.t) <= 60""",
)
def plays_near_library(spark, sf):
    y = _own(spark, sf).where(F.col("status") == "matched").select(F.col("scrobble_id").alias("id"), "target_id")
    users = table(spark, sf, "library_user", F.col("id").alias("user_id"), F.col("user_name").alias("lastfm_user"))
    p = table(spark, sf, "scrobbles", "id", "lastfm_user", "played_at").join(y, "id").join(users, "lastfm_user")
    entity = lambda c: F.concat_ws("|", "user_id", c).alias("entity")
    l = table(spark, sf, "library_scrobbles", "user_id", "media_file_id", F.col("submission_time").alias("t"))
    return sync.near_existing(p.select("id", entity("target_id"), epoch_seconds("played_at").alias("t")), l.select(entity("media_file_id"), "t")).select("id")


@REGISTRY.query(
    "near_duplicate_dedup",
    """WITH RECURSIVE o AS (SELECT id, user_id || '|' || media_file_id AS e, submission_time AS t,
           row_number() OVER (PARTITION BY user_id, media_file_id ORDER BY submission_time, id) AS k FROM library_scrobbles WHERE media_file_id <> ''),
         f AS (SELECT e, k, id, t AS last, TRUE AS accepted FROM o WHERE k = 1
               UNION ALL SELECT o.e, o.k, o.id, CASE WHEN o.t - f.last > 60 THEN o.t ELSE f.last END, o.t - f.last > 60 FROM f JOIN o ON o.e = f.e AND o.k = f.k + 1)
         SELECT id, accepted FROM f""",
)
def near_duplicate_dedup(spark, sf):
    l = table(spark, sf, "library_scrobbles", "id", "user_id", "media_file_id", F.col("submission_time").alias("t")).where(present("media_file_id"))
    return sync.suppress_near_duplicates(l.select("id", F.concat_ws("|", "user_id", "media_file_id").alias("entity"), "t"), 60)


@REGISTRY.query(
    "insert_ignore",
    """WITH n AS (SELECT * FROM scrobbles WHERE fetched_at >= TIMESTAMP '2025-01-01'),
         e AS (SELECT DISTINCT lastfm_user, played_at, artist, title FROM scrobbles WHERE fetched_at < TIMESTAMP '2025-01-01'),
         k AS (SELECT n.*, row_number() OVER (PARTITION BY lastfm_user, played_at, artist, title ORDER BY id) AS k FROM n)
         SELECT k.id FROM k WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.lastfm_user = k.lastfm_user AND e.played_at = k.played_at
           AND e.artist = k.artist AND e.title = k.title)""",
)
def insert_ignore(spark, sf):
    from datetime import datetime

    s = table(spark, sf, "scrobbles", "id", *sync.PLAY_KEY, "fetched_at")
    cut = datetime(2025, 1, 1)
    return sync.insert_ignore(filters.between(s, "fetched_at", None, cut), filters.between(s, "fetched_at", cut, None)).select("id")


@REGISTRY.query(
    "mark_loved",
    """WITH l AS (SELECT DISTINCT lastfm_user, artist, title, mbid_track FROM scrobbles WHERE loved),
         i AS (SELECT DISTINCT lastfm_user, mbid_track FROM l WHERE mbid_track <> ''),
         n AS (SELECT DISTINCT lastfm_user, lower(artist) AS a, lower(title) AS t FROM l WHERE mbid_track IS NULL OR mbid_track = '')
       SELECT s.id FROM scrobbles s WHERE s.loved OR EXISTS (SELECT 1 FROM i WHERE i.lastfm_user = s.lastfm_user AND i.mbid_track = s.mbid_track)
         OR EXISTS (SELECT 1 FROM n WHERE n.lastfm_user = s.lastfm_user AND n.a = lower(s.artist) AND n.t = lower(s.title))""",
)
def mark_loved(spark, sf):
    s = table(spark, sf, "scrobbles", "id", "lastfm_user", "artist", "title", "mbid_track", "loved")
    loved = s.where("loved").select("lastfm_user", "artist", "title", "mbid_track").distinct()
    return sync.mark_loved(s, loved).where("loved").select("id")


@REGISTRY.query(
    "reconcile_annotation",
    f"""WITH c AS (SELECT user_id, media_file_id, count(*) AS n, max(TIMESTAMP '1970-01-01' + to_seconds(submission_time)) AS last
           FROM library_scrobbles WHERE media_file_id <> '' GROUP BY 1, 2),
         t AS (SELECT * FROM annotation WHERE item_type = 'media_file')
       SELECT coalesce(t.user_id, c.user_id) AS user_id, coalesce(t.item_id, c.media_file_id) AS item_id,
              CAST(coalesce(c.n, t.play_count) AS INTEGER) AS play_count, {_TS.format('coalesce(c.last, t.play_date)')} AS play_date
       FROM t FULL JOIN c ON c.user_id = t.user_id AND c.media_file_id = t.item_id""",
)
def reconcile_annotation(spark, sf):
    out = sync.reconcile(table(spark, sf, "annotation"), library_plays(spark, sf))
    return out.select("user_id", "item_id", "play_count", stamp("play_date").alias("play_date"))


@REGISTRY.query(
    "latest_sync_state",
    """SELECT scrobble_id, target, status FROM (SELECT scrobble_id, target, status, row_number() OVER (PARTITION BY scrobble_id
         ORDER BY attempted_at DESC NULLS LAST, target DESC) AS k FROM scrobble_sync) z WHERE k = 1""",
)
def latest_sync_state(spark, sf):
    y = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status", "attempted_at")
    old, new = y.where(F.col("target") == "navidrome"), y.where(F.col("target") == "strawberry")
    return sync.upsert(old, new, ["scrobble_id"], "attempted_at").select("scrobble_id", "target", "status")


@REGISTRY.query(
    "reset_unmatched",
    """SELECT id, CASE WHEN target = 'navidrome' AND status = 'unmatched' THEN 'pending' ELSE status END AS status FROM scrobble_sync""",
)
def reset_unmatched(spark, sf):
    y = table(spark, sf, "scrobble_sync", "id", "target", "status", "target_id", "strategy")
    return sync.reset(y, "navidrome", F.col("status") == "unmatched").select("id", "status")


@REGISTRY.query(
    "song_counters",
    """SELECT m.id, coalesce(c.n, 0) AS playcount, coalesce(c.last, -1) AS lastplayed FROM media_file m LEFT JOIN
       (SELECT media_file_id, count(*) AS n, max(submission_time) AS last FROM library_scrobbles GROUP BY 1) c ON c.media_file_id = m.id""",
)
def song_counters(spark, sf):
    songs = table(spark, sf, "media_file", "id").select("id", F.lit(0).cast("long").alias("playcount"), F.lit(-1).cast("long").alias("lastplayed"))
    plays = table(spark, sf, "library_scrobbles", F.col("media_file_id").alias("id"), F.col("submission_time").alias("epoch"))
    return sync.counter_deltas(songs, plays)


@REGISTRY.query(
    "track_number_titles",
    r"""SELECT title, regexp_replace(title, '^\d{1,3}[_\-.\s]+(\S)', '\1') AS bare FROM (SELECT DISTINCT title FROM scrobbles WHERE title IS NOT NULL)""",
)
def track_number_titles(spark, sf):
    t = table(spark, sf, "scrobbles", "title").where(F.col("title").isNotNull()).distinct()
    return t.select("title", text.without_track_number(F.col("title")).alias("bare"))


@REGISTRY.query("couple_keys", "SELECT DISTINCT lower(trim(artist)) AS a, lower(trim(title)) AS t FROM media_file")
def couple_keys(spark, sf):
    m = table(spark, sf, "media_file", "artist", "title")
    return m.select(text.couple_key(F.col("artist"), F.col("title")).alias("k")).select(F.col("k.artist").alias("a"), F.col("k.title").alias("t")).distinct()


@REGISTRY.query(
    "normalize_text",
    f"""SELECT raw, {q.norm('raw')} AS norm FROM (SELECT title AS raw FROM scrobbles UNION SELECT artist FROM scrobbles UNION SELECT title FROM media_file)
        WHERE raw <> ''""",
)
def normalize_text(spark, sf):
    return matching.norms(table(spark, sf, "scrobbles", "title"), table(spark, sf, "scrobbles", "artist"), table(spark, sf, "media_file", "title"))


@REGISTRY.query(
    "strip_titles",
    f"""SELECT title, {q.version('title')} AS version, {q.title_featuring('title')} AS featuring, {q.truncated('title')} AS truncated,
               {q.featuring('title')} AS marked FROM (SELECT DISTINCT title FROM scrobbles WHERE title <> '')""",
)
def strip_titles(spark, sf):
    t = table(spark, sf, "scrobbles", "title").where(present("title")).distinct()
    c = F.col("title")
    return t.select(
        "title", text.strip_version(c).alias("version"), text.strip_title_featuring(c).alias("featuring"),
        text.strip_truncated(c).alias("truncated"), text.has_featuring(c).alias("marked"),
    )


@REGISTRY.query("strip_albums", f"SELECT album, {q.decoration('album')} AS bare FROM (SELECT DISTINCT album FROM media_file WHERE album <> '')")
def strip_albums(spark, sf):
    a = table(spark, sf, "media_file", "album").where(present("album")).distinct()
    return a.select("album", text.strip_decoration(F.col("album")).alias("bare"))


@REGISTRY.query(
    "strip_artists",
    f"""SELECT artist, {q.featured('artist')} AS plain, {q.lead('artist')} AS lead FROM (SELECT DISTINCT artist FROM scrobbles WHERE artist <> '')""",
)
def strip_artists(spark, sf):
    t = table(spark, sf, "scrobbles", "artist").where(present("artist")).distinct()
    return t.select("artist", text.strip_featured(F.col("artist")).alias("plain"), text.lead_artist(F.col("artist")).alias("lead"))


_REQUEST = ("artist", "title", "album", "mbid_track")


def _library(spark, sf):
    return table(spark, sf, "media_file", "id", "artist", "album_artist", "title", "album", "mbz_track_id", "mbz_recording_id")


def _n(x: str) -> str:
    return q.norm(f"nullif({x}, '')")


_SIDES = f"""m AS MATERIALIZED (SELECT *, {_n('artist')} AS a, {_n('album_artist')} AS aa, {_n('title')} AS t, {_n('album')} AS al, {_n(q.decoration('album'))} AS alb
         FROM media_file),
  r AS MATERIALIZED (SELECT *, row_number() OVER () AS k, {_n('artist')} AS a, {_n('title')} AS t, {_n('album')} AS al, {_n(q.decoration('album'))} AS alb,
              {_n(q.featured(f"({q.lead('artist')})"))} AS lead, {_n(q.bare('title'))} AS bare, {q.featuring('title')} AS marked
       FROM (SELECT DISTINCT artist, title, album, mbid_track FROM PLAYS) AS s),
  e AS (SELECT 'any' AS mode, a, t, 0 AS rank, id FROM m UNION ALL SELECT 'any', aa, t, 1, id FROM m UNION ALL SELECT 'both', a, t, 0, id FROM m WHERE a = aa
        UNION ALL SELECT 'feat', array_to_string(w[1:i], ' '), t, 0, id FROM (SELECT *, string_split(a, ' ') AS w FROM m) AS x, unnest(range(1, len(w) - 1)) AS u(i)
                  WHERE w[i + 1] IN ('feat', 'ft', 'featuring', 'with')),
  q AS (SELECT k, 1 AS p, 'any' AS mode, a, t FROM r UNION ALL SELECT k, 2, 'any', lead, t FROM r WHERE lead <> a UNION ALL SELECT k, 3, 'any', a, bare FROM r WHERE bare <> t
        UNION ALL SELECT k, 4, 'feat', a, bare FROM r WHERE marked UNION ALL SELECT k, 5, 'any', lead, bare FROM r WHERE lead <> a AND bare <> t
        UNION ALL SELECT k, 6, 'feat', a, t FROM r WHERE NOT marked UNION ALL SELECT k, 7, 'both', lead, t FROM r WHERE lead <> a),
  s1 AS (SELECT r.k, min(m.id) AS id FROM r JOIN (SELECT id, mbz_track_id AS x FROM media_file UNION ALL SELECT id, mbz_recording_id FROM media_file) AS m
         ON m.x = r.mbid_track WHERE r.mbid_track <> '' GROUP BY 1),
  t1 AS (SELECT r.k, count(*) AS n, min(m.id) AS id FROM r JOIN m ON m.a = r.a AND m.t = r.t AND m.al = r.al WHERE r.album <> '' GROUP BY 1),
  t2 AS (SELECT r.k, count(*) AS n, min(m.id) AS id FROM r JOIN m ON m.a = r.a AND m.t = r.t AND m.alb = r.alb
         WHERE r.album <> '' AND r.k NOT IN (SELECT k FROM t1) GROUP BY 1),
  s3 AS (SELECT k, arg_min(id, (p, rank, id)) AS id FROM q JOIN e USING (mode, a, t) WHERE a <> '' AND t <> '' GROUP BY 1),
  hit AS (SELECT k, 1 AS stage, id FROM s1 UNION ALL SELECT k, 2, id FROM t1 WHERE n = 1 UNION ALL SELECT k, 2, id FROM t2 WHERE n = 1 UNION ALL SELECT k, 3, id FROM s3),
  best AS (SELECT k, min(stage) AS stage, arg_min(id, stage) AS id FROM hit GROUP BY 1)"""
_UNMATCHED_PLAYS = f"(SELECT s.* {_UNMATCHED})"


@REGISTRY.query(
    "match_cascade",
    f"""WITH {_SIDES.replace('PLAYS', 'scrobbles')}
        SELECT r.artist, r.title, r.album, r.mbid_track, best.id AS media_file_id, CASE stage WHEN 1 THEN 'mbid' WHEN 2 THEN 'triplet' ELSE 'couple' END AS strategy
        FROM r JOIN best ON best.k = r.k""",
)
def match_cascade(spark, sf):
    # Every play is a request, whatever its sync row says and whether it has one.
    return matching.match_cascade(table(spark, sf, "scrobbles", *_REQUEST), _library(spark, sf))


@REGISTRY.query(
    "match_by_identifier",
    f"""SELECT DISTINCT s.mbid_track, k.id AS media_file_id FROM (SELECT s.mbid_track {_UNMATCHED} AND s.mbid_track <> '') s
        JOIN (SELECT x AS identifier, min(id) AS id FROM (SELECT id, mbz_track_id AS x FROM media_file UNION ALL SELECT id, mbz_recording_id FROM media_file) z
              WHERE x <> '' GROUP BY x) k ON k.identifier = s.mbid_track""",
)
def match_by_identifier(spark, sf):
    u, m = _unmatched(spark, sf, "mbid_track"), _library(spark, sf)
    r = u.select(F.col("mbid_track").alias("identifier")).distinct().withColumn("request", F.col("identifier"))
    return matching.by_identifier(r, m).select(F.col("request").alias("mbid_track"), F.col("id").alias("media_file_id"))


def _norm_sides(spark, sf, plays):
    m = _library(spark, sf)
    t = durable(matching.norm_table(plays, m))
    return matching.prepared_requests(plays, t), durable(matching.prepared_library(m, t))


_PENDING = """pend AS MATERIALIZED (SELECT s.*, u.id AS uid, CAST(epoch(s.played_at) AS BIGINT) AS sec, NORM_A AS na, NORM_T AS nt FROM scrobbles s JOIN library_user u ON u.user_name = s.lastfm_user
    LEFT JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome' WHERE y.status IS NULL OR y.status = 'pending'),
  first AS MATERIALIZED (SELECT *, CASE WHEN na <> '' AND nt <> '' THEN first_value(id) OVER (PARTITION BY na, nt ORDER BY played_at, id) ELSE id END AS rep FROM pend)"""
_OUTCOME = f"""WITH RECURSIVE {_PENDING.replace('NORM_A', _n('s.artist')).replace('NORM_T', _n('s.title'))},
  {_SIDES.replace('PLAYS', '(SELECT * FROM first WHERE id = rep)')},
  ans AS MATERIALIZED (SELECT f.id, f.uid, f.sec, best.id AS target_id, CASE stage WHEN 1 THEN 'mbid' WHEN 2 THEN 'triplet' WHEN 3 THEN 'couple' END AS strategy
       FROM first f JOIN first g ON g.id = f.rep JOIN r ON r.artist IS NOT DISTINCT FROM g.artist AND r.title IS NOT DISTINCT FROM g.title
            AND r.album IS NOT DISTINCT FROM g.album AND r.mbid_track IS NOT DISTINCT FROM g.mbid_track LEFT JOIN best ON best.k = r.k),
  dup AS MATERIALIZED (SELECT DISTINCT a.id FROM ans a JOIN library_scrobbles l ON l.user_id = a.uid AND l.media_file_id = a.target_id AND abs(l.submission_time - a.sec) <= 60),
  o AS MATERIALIZED (SELECT id, uid, target_id, sec, row_number() OVER (PARTITION BY uid, target_id ORDER BY sec, id) AS n FROM ans WHERE target_id IS NOT NULL AND id NOT IN (FROM dup)),
  f AS (SELECT uid, target_id, n, id, sec AS last, TRUE AS accepted FROM o WHERE n = 1
        UNION ALL SELECT o.uid, o.target_id, o.n, o.id, CASE WHEN o.sec - f.last > 60 THEN o.sec ELSE f.last END, o.sec - f.last > 60
        FROM f JOIN o ON o.uid = f.uid AND o.target_id = f.target_id AND o.n = f.n + 1),
  out AS MATERIALIZED (SELECT ans.id, CASE WHEN ans.target_id IS NULL THEN 'unmatched' WHEN f.accepted THEN 'matched' ELSE 'duplicate' END AS status, ans.target_id, ans.strategy, ans.uid, ans.sec
          FROM ans LEFT JOIN f ON f.id = ans.id)"""


def _outcome(spark, sf):
    plays = table(spark, sf, "scrobbles", "id", "lastfm_user", "artist", "title", "album", "mbid_track", "played_at")
    states = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status")
    open_ = durable(pipeline.pending_plays(plays, states, table(spark, sf, "library_user", "id", "user_name"), "navidrome"))
    matched = durable(pipeline.match(open_, _library(spark, sf), filters.moment(NOW)))
    existing = table(spark, sf, "library_scrobbles", "user_id", "media_file_id", F.col("submission_time").alias("t"))
    return matched, pipeline.classify(matched, open_, existing)


@REGISTRY.query("sync_outcome", _OUTCOME + " SELECT id, status, target_id, strategy FROM out")
def sync_outcome(spark, sf):
    return _outcome(spark, sf)[1].select("id", "status", "target_id", "strategy")


@REGISTRY.query(
    "sync_report",
    _OUTCOME + """ SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'duplicate') AS duplicates,
                   count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS considered FROM out""",
)
def sync_report(spark, sf):
    return pipeline.report(_outcome(spark, sf)[1])


@REGISTRY.query(
    "sync_flush",
    _OUTCOME + f""", new AS (SELECT uid AS user_id, target_id AS media_file_id, sec AS submission_time FROM out WHERE status = 'matched'),
        c AS (SELECT user_id, media_file_id, count(*) AS n, max(submission_time) AS last FROM (SELECT user_id, media_file_id, submission_time FROM library_scrobbles UNION ALL FROM new) AS x
              WHERE (user_id, media_file_id) IN (SELECT user_id, media_file_id FROM new) GROUP BY 1, 2)
        SELECT c.user_id, c.media_file_id AS item_id, CAST(c.n AS INTEGER) AS play_count, {_TS.format("TIMESTAMP '1970-01-01' + to_seconds(c.last)")} AS play_date,
               coalesce(a.rating, 0) AS rating, coalesce(a.starred, FALSE) AS starred
        FROM c LEFT JOIN annotation a ON a.user_id = c.user_id AND a.item_id = c.media_file_id AND a.item_type = 'media_file'""",
)
def sync_flush(spark, sf):
    existing = table(spark, sf, "library_scrobbles", "user_id", "media_file_id", "submission_time")
    _, touched = pipeline.flush(durable(_outcome(spark, sf)[1]), existing, table(spark, sf, "annotation"))
    return touched.select("user_id", "item_id", "play_count", stamp("play_date").alias("play_date"), "rating", "starred")


@REGISTRY.query(
    "match_memo",
    _OUTCOME + """ SELECT f.na AS artist_norm, f.nt AS title_norm, min(a.target_id) AS target_id, coalesce(min(a.strategy), 'negative') AS strategy
                   FROM first f JOIN ans a ON a.id = f.id WHERE f.na <> '' AND f.nt <> '' GROUP BY 1, 2""",
)
def match_memo(spark, sf):
    return pipeline.memo_rows(_outcome(spark, sf)[0], filters.moment(NOW)).drop("resolved_at")


_COUNTERS = f"""s AS MATERIALIZED (SELECT *, {_n('artist')} AS a, {_n('title')} AS n, lower(title) AS lt FROM media_file),
    p AS (SELECT DISTINCT artist, title, mbid_track FROM scrobbles),
    v AS (SELECT *, 1 AS stage, artist AS va, title AS vt FROM p UNION ALL SELECT *, 2, {q.featured('artist')}, title FROM p
          UNION ALL SELECT *, 2, artist, {q.title_featuring(f"({q.version('title')})")} FROM p
          UNION ALL SELECT *, 2, {q.featured('artist')}, {q.title_featuring(f"({q.version('title')})")} FROM p),
    w AS MATERIALIZED (SELECT *, {_n('va')} AS a, {_n('vt')} AS n, lower(vt) AS lt FROM v WHERE va <> '' AND vt <> ''),
    h AS (SELECT w.artist, w.title, w.mbid_track, stage, s.id, s.duration FROM w JOIN s USING (a, n, lt)
          UNION ALL SELECT p.artist, p.title, p.mbid_track, 0, s.id, s.duration FROM p JOIN s ON (s.mbz_track_id = p.mbid_track OR s.mbz_recording_id = p.mbid_track) WHERE p.mbid_track <> '')"""


@REGISTRY.query(
    "counter_target_match",
    f"WITH {_COUNTERS} SELECT artist, title, mbid_track, arg_min(id, (stage, -duration, id)) AS id FROM h GROUP BY 1, 2, 3",
)
def counter_target_match(spark, sf):
    """Every play against a target that keeps counters, here the library with its durations as counters."""
    p = table(spark, sf, "scrobbles", "artist", "title", "mbid_track").distinct().withColumn("key", F.xxhash64("artist", "title", "mbid_track"))
    songs = table(spark, sf, "media_file", "id", "artist", "title", "mbz_track_id", "mbz_recording_id", F.col("duration").alias("playcount"))
    p = durable(p)
    return p.join(pipeline.match_counters(p, songs), "key").select("artist", "title", "mbid_track", "id")


@REGISTRY.query(
    "fuzzy_match",
    f"""WITH {_SIDES.replace('PLAYS', 'scrobbles')},
          asked AS (SELECT DISTINCT a, t FROM r WHERE k NOT IN (SELECT k FROM best) AND a <> '' AND t <> '' AND strlen(a) <= 255 AND strlen(t) <= 255),
          met AS (SELECT asked.a, asked.t, m.id, levenshtein(asked.a, m.a) + levenshtein(asked.t, m.t) AS d FROM asked JOIN m
                  ON (substr(m.a, 1, 3) = substr(asked.a, 1, 3) OR substr(m.t, 1, 3) = substr(asked.t, 1, 3))
                  AND abs(strlen(m.a) - strlen(asked.a)) <= 2 AND abs(strlen(m.t) - strlen(asked.t)) <= 2 WHERE m.a <> '' AND m.t <> '')
        SELECT a, t, arg_min(id, (d, id)) AS id, CAST(min(d) AS INTEGER) AS distance FROM met WHERE d <= 2 GROUP BY 1, 2""",
)
def fuzzy_match(spark, sf):
    requests, library = _norm_sides(spark, sf, table(spark, sf, "scrobbles", *_REQUEST))
    requests = durable(requests)
    left = requests.join(matching.answered(requests, library), "request", "left_anti")
    return matching.fuzzy_match(left, library, 2)


_NEAREST = """(SELECT x.a AS name, y.a AS near, CAST(levenshtein(x.a, y.a) AS INTEGER) AS distance,
          row_number() OVER (PARTITION BY x.a ORDER BY levenshtein(x.a, y.a), y.a) AS k
   FROM (SELECT DISTINCT a FROM r WHERE a IS NOT NULL) AS x JOIN (SELECT DISTINCT a FROM m WHERE a IS NOT NULL) AS y
   ON x.a <> y.a AND substr(x.a, 1, 1) = substr(y.a, 1, 1) AND levenshtein(x.a, y.a) <= 2)"""


@REGISTRY.query("nearest_names", f"WITH {_SIDES.replace('PLAYS', _UNMATCHED_PLAYS)} SELECT name, near, distance, CAST(k AS INTEGER) AS k FROM {_NEAREST} AS n WHERE k <= 3")
def nearest_names(spark, sf):
    asked, library = _norm_sides(spark, sf, _unmatched(spark, sf, *_REQUEST))
    return matching.nearest_names(asked.select("a"), library.select("a"), 2)


@REGISTRY.query(
    "diagnose_unmatched",
    f"""WITH {_SIDES.replace('PLAYS', _UNMATCHED_PLAYS)}, asked AS (SELECT DISTINCT a, t FROM r), own AS (SELECT a FROM m WHERE a <> '' UNION SELECT aa FROM m WHERE aa <> ''),
          near AS (SELECT DISTINCT name FROM {_NEAREST} AS n)
        SELECT a, t, CASE WHEN coalesce(a, '') = '' OR coalesce(t, '') = '' THEN 'unknown'
            WHEN a NOT IN (FROM own) AND a IN (FROM near) THEN 'artist_near_match' WHEN a NOT IN (FROM own) THEN 'artist_unknown'
            WHEN EXISTS (SELECT 1 FROM e WHERE e.mode = 'any' AND e.a = asked.a AND e.t = asked.t) THEN 'matcher_gap'
            WHEN EXISTS (SELECT 1 FROM e WHERE e.mode = 'any' AND e.a = asked.a AND levenshtein(e.t, asked.t) BETWEEN 1 AND 3) THEN 'title_near_match'
            ELSE 'track_missing' END AS verdict FROM asked""",
)
def diagnose_unmatched(spark, sf):
    return matching.diagnose(*_norm_sides(spark, sf, _unmatched(spark, sf, *_REQUEST)))


@REGISTRY.query(
    "nearest_genres",
    """SELECT a.g AS name, b.g AS near, CAST(levenshtein(a.g, b.g) AS BIGINT) AS distance FROM (SELECT DISTINCT lower(genre) AS g FROM media_file WHERE genre <> '') a
       JOIN (SELECT DISTINCT lower(genre) AS g FROM media_file WHERE genre <> '') b ON a.g <> b.g AND levenshtein(a.g, b.g) <= 4""",
)
def nearest_genres(spark, sf):
    g = table(spark, sf, "media_file", "genre").where(present("genre")).select(F.lower("genre").alias("g")).distinct()
    near = matching.near_strings(g, g, 4).where("distance > 0")
    return near.select(F.col("l").alias("name"), F.col("r").alias("near"), F.col("distance").cast("long").alias("distance"))


@REGISTRY.query(
    "artist_aliases",
    f"""WITH u AS (SELECT s.artist, s.mbid_artist, count(*) AS plays {_UNMATCHED} AND s.mbid_artist <> '' GROUP BY 1, 2),
          un AS (SELECT *, {_n('artist')} AS a FROM u), l AS (SELECT name, mbz_artist_id AS mbid, {_n('name')} AS ta FROM artist),
          c AS (SELECT un.artist AS source, l.name AS target, row_number() OVER (PARTITION BY un.a ORDER BY plays DESC, un.artist, l.name) AS k
                FROM un JOIN l ON l.mbid = un.mbid_artist AND l.ta <> un.a WHERE un.a NOT IN (SELECT ta FROM l WHERE ta IS NOT NULL))
        SELECT source, target FROM c WHERE k = 1""",
)
def artist_aliases(spark, sf):
    u = _unmatched(spark, sf, "artist", "mbid_artist")
    own = table(spark, sf, "artist", F.col("name").alias("artist"), F.col("mbz_artist_id").alias("mbid"))
    t = durable(matching.norms(u.select("artist"), own.select("artist")))
    counted = u.groupBy("artist", "mbid_artist").agg(F.count(F.lit(1)).alias("plays"))
    return matching.artist_aliases(matching.with_norm(counted, F.col("artist"), "a", t), matching.with_norm(own, F.col("artist"), "a", t)).drop("a")


@REGISTRY.query(
    "recommendation_seeds",
    """WITH e AS (SELECT artist, count(*) * 1.0 AS w, 0 AS s FROM scrobbles WHERE trim(artist) <> '' GROUP BY 1
         UNION ALL SELECT artist, count(*) * 1.5, 1 FROM scrobbles WHERE trim(artist) <> '' AND played_at >= TIMESTAMP '2025-01-01' GROUP BY 1
         UNION ALL SELECT m.artist, count(*) * 10.0, 2 FROM annotation a JOIN media_file m ON m.id = a.item_id WHERE a.starred AND a.item_type = 'media_file' AND trim(m.artist) <> '' GROUP BY 1),
       k AS (SELECT artist, lower(trim(artist)) AS key, w, row_number() OVER (PARTITION BY lower(trim(artist)) ORDER BY s, w DESC, artist) AS k FROM e),
       g AS (SELECT max(CASE WHEN k = 1 THEN artist END) AS artist, CAST(sum(w) AS DOUBLE) AS weight FROM k GROUP BY key)
       SELECT artist, weight FROM g ORDER BY weight DESC, artist LIMIT 50""",
)
def recommendation_seeds(spark, sf):
    return recommend.seeds(_seed_sources(spark, sf), 50)


def _seed_sources(spark, sf):
    s = table(spark, sf, "scrobbles", "artist", "played_at")
    per = lambda df: df.groupBy("artist").agg(F.count(F.lit(1)).alias("n"))
    stars = table(spark, sf, "annotation", "item_id", "item_type", "starred").where("starred AND item_type = 'media_file'")
    starred = stars.join(table(spark, sf, "media_file", F.col("id").alias("item_id"), "artist"), "item_id")
    return [(per(s), 1.0), (per(filters.cascade(s, "played_at", 2025)), 1.5), (per(starred), 10.0)]


@REGISTRY.query(
    "similar_artists_merged",
    """WITH sim AS (SELECT a.artist AS seed, b.artist, count(*) / 10.0 AS match FROM (SELECT DISTINCT genre, artist FROM media_file WHERE genre <> '') a
         JOIN (SELECT DISTINCT genre, artist FROM media_file WHERE genre <> '') b ON a.genre = b.genre AND a.artist <> b.artist
         JOIN (SELECT artist FROM scrobbles WHERE artist <> '' GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10) t ON t.artist = a.artist GROUP BY 1, 2)
       SELECT artist, score FROM (SELECT min(artist) AS artist, round(sum(match), 6) AS score, lower(trim(artist)) AS key FROM sim GROUP BY 3) g
       WHERE key NOT IN (SELECT lower(trim(artist)) FROM (SELECT artist FROM scrobbles WHERE artist <> '' GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10))
       ORDER BY score DESC, artist LIMIT 30""",
)
def similar_artists_merged(spark, sf):
    s = table(spark, sf, "scrobbles", "artist").where(present("artist"))
    best = top(s, ["artist"], [F.col("plays").desc(), F.col("artist")], 10).select(F.col("artist").alias("seed"), F.lit(1.0).alias("weight"))
    g = table(spark, sf, "media_file", "genre", "artist").where(present("genre") & present("artist")).distinct()
    sim = g.join(best.select("seed"), g.artist == F.col("seed"), "left_semi").select("genre", F.col("artist").alias("seed")).join(g, "genre")
    sim = sim.where(F.col("seed") != F.col("artist")).groupBy("seed", "artist").agg((F.count(F.lit(1)) / 10.0).alias("match"))
    found = recommend.from_similar(best.withColumnRenamed("seed", "artist"), sim)
    source = found.select("artist", "score", F.lit(None).cast("string").alias("mbid"), F.lit("genre").alias("source"))
    return recommend.merge([source], best.select(F.col("seed").alias("artist")), 30).select("artist", F.round("score", 6).alias("score"))


_VECTORS = """(SELECT q.vec_id AS query, v.vec_id AS near, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"""


@REGISTRY.query("similar_vectors", f"SELECT query, near, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM {_VECTORS} AS n WHERE rank <= 10")
def similar_vectors(spark, sf):
    v = table(spark, sf, "embeddings", F.col("vec_id").alias("id"), "embedding")
    near = recommend.nearest_vectors(v.where(F.col("id") % 100 == 0), v, 10)
    return near.withColumn("distance", F.round("distance", 6))


@REGISTRY.query(
    "stream_ingest_dedup",
    "SELECT lastfm_user, count(*) AS plays FROM (SELECT DISTINCT lastfm_user, played_at, artist, title FROM scrobbles) z GROUP BY 1",
)
def stream_ingest_dedup(spark, sf):
    once = ingest.deduplicated(ingest.play_stream(spark, sf)).select(*sync.PLAY_KEY)
    return ingest.run_to_table(once).groupBy("lastfm_user").agg(F.count(F.lit(1)).alias("plays"))


@REGISTRY.query(
    "stream_daily_counts",
    "SELECT lastfm_user, strftime(played_at, '%Y-%m-%d') AS day, count(*) AS plays FROM scrobbles GROUP BY 1, 2",
)
def stream_daily_counts(spark, sf):
    counts = ingest.daily_counts(ingest.play_stream(spark, sf), "lastfm_user")
    return ingest.run_to_totals(counts, ["lastfm_user", "day"])
