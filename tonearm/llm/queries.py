"""The pN_ queries of the text and log operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import heavy, linkage, lookalike, names, neartime, packing, sentences, tiling
from tonearm.plans.registry import Registry
from tonearm.sources.tables import epoch_seconds, present, table

REGISTRY = Registry()

_HEAVY_SQL = """
SELECT f.field, f.value, count(*) AS n FROM (
    SELECT 'artist' AS field, artist AS value FROM scrobbles
    UNION ALL SELECT 'title', title FROM scrobbles
    UNION ALL SELECT 'album', album FROM scrobbles) AS f
WHERE f.value <> '' GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM scrobbles)
"""


def _heavy(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["artist", "title", "album"]
    return heavy.heavy_hitters(table(spark, sf, "scrobbles", *fields), fields, 0.01)


@REGISTRY.query("p3_found", f"SELECT field, value FROM ({_HEAVY_SQL}) AS h")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _heavy(spark, sf).select("field", "value")


@REGISTRY.query("p3_counts", _HEAVY_SQL)
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _heavy(spark, sf).select("field", "value", "n")


_NEAREST_SQL = """
WITH plays AS (
    SELECT s.id, u.id || '|' || y.target_id AS entity, s.played_at AS t
    FROM scrobbles s JOIN scrobble_sync y ON y.scrobble_id = s.id AND y.target = 'navidrome' AND y.status = 'matched'
    JOIN library_user u ON u.user_name = s.lastfm_user WHERE y.target_id <> ''),
library AS (
    SELECT id, user_id || '|' || media_file_id AS entity, TIMESTAMP '1970-01-01' + to_seconds(submission_time) AS t
    FROM library_scrobbles WHERE media_file_id <> ''),
pairs AS (
    SELECT p.id AS scrobble_id, l.id AS library_scrobble_id,
           row_number() OVER (PARTITION BY p.id ORDER BY abs(epoch(l.t) - epoch(p.t)), l.id) AS k
    FROM plays p JOIN library l ON l.entity = p.entity AND abs(epoch(l.t) - epoch(p.t)) <= 120)
"""


def _plays_and_library(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sync = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status", "target_id")
    matched = sync.where((F.col("target") == "navidrome") & (F.col("status") == "matched"))
    users = table(spark, sf, "library_user", F.col("id").alias("user_id"), "user_name")
    plays = (
        table(spark, sf, "scrobbles", "id", "lastfm_user", "played_at")
        .join(matched.select("scrobble_id", "target_id"), F.col("id") == F.col("scrobble_id"))
        .join(users, F.col("lastfm_user") == F.col("user_name"))
    )
    left = plays.select(
        "id", F.concat_ws("|", "user_id", "target_id").alias("entity"), epoch_seconds("played_at").alias("t")
    )
    library = table(spark, sf, "library_scrobbles", "id", "user_id", "media_file_id", "submission_time")
    right = library.where(F.col("media_file_id") != "").select(
        "id", F.concat_ws("|", "user_id", "media_file_id").alias("entity"), F.col("submission_time").alias("t")
    )
    return left, right


def _stored_rows(spark: SparkSession, sf: str) -> int:
    """Rows of both play logs, from the files' own counts."""
    return table(spark, sf, "scrobbles").count() + table(spark, sf, "library_scrobbles").count()


@REGISTRY.query("p5_found", _NEAREST_SQL + "SELECT scrobble_id, library_scrobble_id FROM pairs WHERE k = 1")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _plays_and_library(spark, sf)
    found = neartime.nearest_in_time(left, right, 120, rows=_stored_rows(spark, sf))
    return found.select(F.col("left_id").alias("scrobble_id"), F.col("right_id").alias("library_scrobble_id"))


@REGISTRY.query(
    "p5_all_plays",
    _NEAREST_SQL
    + """SELECT p.id AS scrobble_id, x.library_scrobble_id
         FROM plays p LEFT JOIN (SELECT * FROM pairs WHERE k = 1) x ON x.scrobble_id = p.id""",
)
def p5_all_plays(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _plays_and_library(spark, sf)
    found = neartime.nearest_in_time(left, right, 120, keep_unmatched=True, rows=_stored_rows(spark, sf))
    return found.select(F.col("left_id").alias("scrobble_id"), F.col("right_id").alias("library_scrobble_id"))


def _visible_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.distinct_texts(
        table(spark, sf, "scrobbles", "title"), table(spark, sf, "media_file", "title"), table(spark, sf, "media_file", "artist")
    )


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.equal_looking_pairs(_visible_texts(spark, sf))


@REGISTRY.query("p2_canonical")
def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.canonical_column(_visible_texts(spark, sf), "text")


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "end_pos").distinct()


@REGISTRY.query("p10_units")
def p10_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents", "doc_id", "text"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.leaked_items(
        table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items", "item_id", "text")
    )


@REGISTRY.query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


@REGISTRY.query("p9_coverage")
def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_lengths(table(spark, sf, "documents", "doc_id", "text")))


@REGISTRY.query("p8_packing")
def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


@REGISTRY.query("p8_summary")
def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_summary(_packed(spark, sf))


def _linked_names(spark: SparkSession, sf: str) -> DataFrame:
    plays = table(spark, sf, "scrobbles", "artist", "album_artist")
    written = plays.select(F.explode(F.array("artist", "album_artist")).alias("name")).where(F.col("name") != "")
    library = table(spark, sf, "artist", "name").where(F.col("name") != "")
    return names.link_names(written.unionByName(library).groupBy("name").agg(F.count(F.lit(1)).alias("n")))


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.spelling_pairs(_linked_names(spark, sf))


@REGISTRY.query("p1_entities")
def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _linked_names(spark, sf)


def _recordings(spark: SparkSession, sf: str) -> DataFrame:
    sync = table(spark, sf, "scrobble_sync", "scrobble_id", "target", "status")
    matched = sync.where((F.col("target") == "navidrome") & (F.col("status") == "matched"))
    answered = matched.select(F.col("scrobble_id").alias("play_id"))
    plays = table(spark, sf, "scrobbles", F.col("id").alias("play_id"), "artist", "title", "album", F.col("mbid_track").alias("identifier"))
    ids = F.array("mbz_recording_id", "mbz_track_id")
    tracks = table(spark, sf, "media_file", "id", "artist", "title", "album", "mbz_recording_id", "mbz_track_id").select(
        F.col("id").alias("track_id"), "artist", "title", "album", F.filter(ids, lambda x: present(x)).alias("identifiers")
    )
    return linkage.link_recordings(plays, tracks, answered=answered)


@REGISTRY.query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _recordings(spark, sf).select(
        F.col("play_id").alias("scrobble_id"), F.col("track_id").alias("media_file_id")
    ).distinct()


@REGISTRY.query("p7_confidence")
def p7_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _recordings(spark, sf)
