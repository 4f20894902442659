"""Queries of the two core data-care operators: dangling references and rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import orphans, rolling
from tonearm.plans.registry import Registry
from tonearm.sources.tables import table

REGISTRY = Registry()

_ORPHANS_SQL = """
SELECT 'scrobble_sync' AS table_name, CAST(y.id AS VARCHAR) AS row_key,
       coalesce(strftime(y.attempted_at, '%Y-%m'), 'none') AS period, CAST(y.scrobble_id AS VARCHAR) AS ref_key
FROM scrobble_sync y
WHERE y.scrobble_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scrobbles s WHERE s.id = y.scrobble_id)
UNION ALL
SELECT 'library_scrobbles', CAST(l.id AS VARCHAR),
       coalesce(strftime(TIMESTAMP '1970-01-01' + to_seconds(l.submission_time), '%Y-%m'), 'none'), l.media_file_id
FROM library_scrobbles l
WHERE l.media_file_id <> '' AND NOT EXISTS (SELECT 1 FROM media_file m WHERE m.id = l.media_file_id)
UNION ALL
SELECT 'annotation', a.ann_id, coalesce(strftime(a.play_date, '%Y-%m'), 'none'), a.item_id
FROM annotation a
WHERE a.item_id <> '' AND (
    (a.item_type = 'media_file' AND NOT EXISTS (SELECT 1 FROM media_file m WHERE m.id = a.item_id))
 OR (a.item_type = 'album' AND NOT EXISTS (SELECT 1 FROM media_file m WHERE m.album_id = a.item_id))
 OR (a.item_type = 'artist' AND NOT EXISTS (SELECT 1 FROM artist r WHERE r.id = a.item_id)))
"""

_DAYS_SQL = """
WITH plays AS (
    SELECT DISTINCT lastfm_user, played_at, artist, title FROM scrobbles
    WHERE lastfm_user <> '' AND played_at IS NOT NULL),
daily AS (SELECT lastfm_user, CAST(played_at AS DATE) AS day, count(*) AS n FROM plays GROUP BY 1, 2),
spans AS (SELECT lastfm_user, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
days AS (
    SELECT lastfm_user, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
    FROM spans),
dense AS (
    SELECT d.lastfm_user, d.lo, d.day, coalesce(x.n, 0) AS n
    FROM days d LEFT JOIN daily x ON x.lastfm_user = d.lastfm_user AND x.day = d.day),
totals AS (
    SELECT lastfm_user, lo, day,
           CAST(sum(n) OVER (PARTITION BY lastfm_user ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS t7,
           CAST(sum(n) OVER (PARTITION BY lastfm_user ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS t30
    FROM dense)
"""


def _orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.library_orphans(
        table(spark, sf, "scrobble_sync", "id", "scrobble_id", "attempted_at"),
        table(spark, sf, "scrobbles", "id"),
        table(spark, sf, "library_scrobbles", "id", "media_file_id", "submission_time"),
        table(spark, sf, "media_file", "id", "album_id"),
        table(spark, sf, "annotation", "ann_id", "item_id", "item_type", "play_date"),
        table(spark, sf, "artist", "id"),
    )


def _state(spark: SparkSession, sf: str) -> DataFrame:
    plays = table(spark, sf, "scrobbles", "lastfm_user", "played_at", "artist", "title", "fetched_at")
    return rolling.current(rolling.maintain(rolling.distinct_plays(plays)))


@REGISTRY.query("p4_found", f"SELECT table_name, row_key, period FROM ({_ORPHANS_SQL}) AS o")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphan_rows(spark, sf).select("table_name", "row_key", "period")


@REGISTRY.query(
    "p4_report",
    f"""SELECT table_name, period, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys
        FROM ({_ORPHANS_SQL}) AS o GROUP BY table_name, period""",
)
def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphan_rows(spark, sf))


@REGISTRY.query(
    "p6_found",
    _DAYS_SQL
    + """SELECT lastfm_user, strftime(day, '%Y-%m-%d') AS day,
                CASE WHEN t7 = 0 AND t30 > 0 THEN 'quiet' ELSE 'peak' END AS kind
         FROM totals WHERE day >= lo + 29
           AND ((t7 = 0 AND t30 > 0) OR (t7 >= 10 AND t7 * 30 > t30 * 14))""",
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.quiet_and_peak_days(_state(spark, sf))


@REGISTRY.query(
    "p6_rolling_days",
    _DAYS_SQL
    + """SELECT lastfm_user, strftime(day, '%Y-%m-%d') AS day, t7, t30,
                round(t7 / 7.0, 6) AS avg7, round(t30 / 30.0, 6) AS avg30 FROM totals""",
)
def p6_rolling_days(spark: SparkSession, sf: str) -> DataFrame:
    days = rolling.with_averages(_state(spark, sf))
    return days.select(
        F.col("entity").alias("lastfm_user"),
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "t7",
        "t30",
        F.round("avg7", 6).alias("avg7"),
        F.round("avg30", 6).alias("avg30"),
    )
