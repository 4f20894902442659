"""JSON landing files of paged play-history and loved-track pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions.text import correction_or_null

_TEXT = T.StructType([T.StructField("#text", T.StringType()), T.StructField("mbid", T.StringType())])
_IMAGE = T.StructType([T.StructField("size", T.StringType()), T.StructField("#text", T.StringType())])
TRACK = T.StructType(
    [
        T.StructField("artist", _TEXT),
        T.StructField("album", _TEXT),
        T.StructField("name", T.StringType()),
        T.StructField("mbid", T.StringType()),
        T.StructField("loved", T.StringType()),
        T.StructField("image", T.ArrayType(_IMAGE)),
        T.StructField("date", T.StructType([T.StructField("uts", T.StringType())])),
        T.StructField("@attr", T.StructType([T.StructField("nowplaying", T.StringType())])),
    ]
)
PAGE = T.StructType([T.StructField("recenttracks", T.StructType([T.StructField("track", T.ArrayType(TRACK))]))])
ONE = T.StructType([T.StructField("recenttracks", T.StructType([T.StructField("track", TRACK)]))])


def recent_tracks(pages: DataFrame, user: str | None = None) -> DataFrame:
    """Plays of raw pages (value string), one page a row, of ``user`` or of the one in their column ``lastfm_user``.

    A page whose track is a single object counts as a list of one. Rows now playing and rows without a time are
    dropped; the last non-empty image is kept; an empty identifier is NULL.
    """
    of = [F.col("lastfm_user")] if user is None else [F.lit(user).alias("lastfm_user")]
    read = pages.select(
        *of,
        F.coalesce(
            F.from_json("value", PAGE)["recenttracks"]["track"],
            F.array(F.from_json("value", ONE)["recenttracks"]["track"]),
        ).alias("tracks")
    )
    t = read.select("lastfm_user", F.explode("tracks").alias("t")).where(F.col("t.@attr.nowplaying").isNull())
    uts = F.col("t.date.uts").cast("long")
    missing = lambda c: F.nullif(F.col(c), F.lit(""))
    return t.where(uts > 0).select(
        "lastfm_user",
        F.col("t.artist.#text").alias("artist"),
        F.col("t.name").alias("title"),
        F.col("t.album.#text").alias("album"),
        F.lit("").alias("album_artist"),
        missing("t.mbid").alias("mbid_track"),
        missing("t.artist.mbid").alias("mbid_artist"),
        missing("t.album.mbid").alias("mbid_album"),
        F.timestamp_seconds(uts).alias("played_at"),
        (F.col("t.loved") == "1").alias("loved"),
        F.get(F.filter(F.col("t.image.#text"), lambda x: x != ""), F.size(F.filter(F.col("t.image.#text"), lambda x: x != "")) - 1).alias("image_url"),
    )


def listed(pages: DataFrame, head: str, item: str, kind: str) -> DataFrame:
    """The items (column ``t``) under ``head``.``item`` of raw pages; a single object counts as a list of one."""
    many = F.from_json("value", f"struct<{head}:struct<{item}:array<{kind}>>>")[head][item]
    one = F.from_json("value", f"struct<{head}:struct<{item}:{kind}>>")[head][item]
    rows = pages.select(*[c for c in pages.columns if c != "value"], F.coalesce(many, F.array(one)).alias("_rows"))
    return rows.select("*", F.explode("_rows").alias("t")).drop("_rows").where(F.col("t").isNotNull())


def _missing(column: str):
    return F.nullif(F.col(column), F.lit(""))


def loved_tracks(pages: DataFrame, user: str | None = None) -> DataFrame:
    """(lastfm_user, artist, title, mbid_track, loved_at) of raw pages (value) of loved tracks; no time is NULL.

    The pages are those of ``user``, or name theirs in a column ``lastfm_user``.
    """
    kind = "struct<name:string,mbid:string,artist:struct<name:string,`#text`:string>,date:struct<uts:string>>"
    t = listed(pages, "lovedtracks", "track", kind)
    uts = F.col("t.date.uts").cast("long")
    return t.select(
        F.col("lastfm_user") if user is None else F.lit(user).alias("lastfm_user"), F.coalesce("t.artist.name", "t.artist.#text", F.lit("")).alias("artist"),
        F.coalesce("t.name", F.lit("")).alias("title"), _missing("t.mbid").alias("mbid_track"), F.when(uts > 0, F.timestamp_seconds(uts)).alias("loved_at"),
    )


def similar_artists(pages: DataFrame) -> DataFrame:
    """(seed, artist, mbid, match, url) of raw answers (seed, value); blank names are dropped."""
    t = listed(pages, "similarartists", "artist", "struct<name:string,mbid:string,match:string,url:string>")
    name = F.regexp_replace("t.name", "^\\s+|\\s+$", "")
    return t.where(name != "").select(
        "seed", name.alias("artist"), _missing("t.mbid").alias("mbid"), F.coalesce(F.col("t.match").cast("double"), F.lit(0.0)).alias("match"),
        F.coalesce("t.url", F.lit("")).alias("url"),
    )


def lookups(answers: DataFrame, path: str = "track") -> DataFrame:
    """(artist, title, mbid, corrected_artist, corrected_title) of raw answers (artist, title, value) about one track each.

    ``path`` is where the track stands in the answer, as ``track`` or ``corrections.correction.track``. Names count as
    corrected only if they differ by more than case. An answer of another form, as an error is, knows nothing.
    """
    node = F.get_json_object("value", f"$.{path}")
    at = lambda p: F.get_json_object(node, p)
    artist = F.coalesce(at("$.artist.name"), F.when(~F.coalesce(at("$.artist"), F.lit("")).startswith("{"), at("$.artist")))
    return answers.select(
        "artist", "title", F.nullif(at("$.mbid"), F.lit("")).alias("mbid"),
        correction_or_null(F.col("artist"), artist).alias("corrected_artist"), correction_or_null(F.col("title"), at("$.name")).alias("corrected_title"),
    )


def playlists(pages: DataFrame) -> DataFrame:
    """(id, name, owner, song_count) of raw answers (value) that list playlists."""
    kind = "struct<id:string,name:string,owner:string,songCount:long>"
    rows = F.from_json(F.get_json_object("value", "$.subsonic-response"), f"struct<playlists:struct<playlist:array<{kind}>>>")
    t = pages.select(F.explode(rows["playlists"]["playlist"]).alias("t"))
    return t.select("t.id", "t.name", "t.owner", F.coalesce("t.songCount", F.lit(0)).alias("song_count"))


def playlist_tracks(pages: DataFrame) -> DataFrame:
    """(playlist_id, name, position, id, title, artist) of raw answers (value) that hold one playlist each."""
    kind = "struct<id:string,title:string,artist:string>"
    row = F.from_json(F.get_json_object("value", "$.subsonic-response"), f"struct<playlist:struct<id:string,name:string,entry:array<{kind}>>>")["playlist"]
    t = pages.select(row.alias("p")).select("p.id", "p.name", F.posexplode("p.entry").alias("pos", "t"))
    return t.select(F.col("id").alias("playlist_id"), "name", (F.col("pos") + 1).alias("position"), F.col("t.id").alias("id"), "t.title", "t.artist")


def playlist_named(lists: DataFrame, name: str, owner: str) -> DataFrame:
    """The first playlist of that name and owner."""
    return lists.where((F.col("name") == name) & (F.col("owner") == owner)).orderBy("id").limit(1)


def recommended_recordings(pages: DataFrame) -> DataFrame:
    """(recording, score) of raw answers (value); an empty answer recommends nothing."""
    rows = F.from_json("value", "struct<payload:struct<mbids:array<struct<recording_mbid:string,score:double>>>>")["payload"]["mbids"]
    t = pages.select(F.explode(rows).alias("t")).where(F.coalesce("t.recording_mbid", F.lit("")) != "")
    return t.select(F.col("t.recording_mbid").alias("recording"), F.coalesce("t.score", F.lit(0.0)).alias("score"))


def recording_artists(pages: DataFrame) -> DataFrame:
    """(recording, mbid, name) of raw answers (value), objects of recordings; artists without identifier or name are dropped."""
    kind = "map<string,struct<artist:struct<artists:array<struct<artist_mbid:string,name:string>>>>>"
    t = pages.select(F.explode(F.from_json("value", kind)).alias("recording", "x")).select("recording", F.explode("x.artist.artists").alias("t"))
    good = (F.coalesce("t.artist_mbid", F.lit("")) != "") & (F.coalesce("t.name", F.lit("")) != "")
    return t.where(good).select("recording", F.col("t.artist_mbid").alias("mbid"), "t.name").distinct()


def in_chunks(values: list[str], size: int = 50) -> list[list[str]]:
    """The different values in their order, in chunks of one request each."""
    once = list(dict.fromkeys(values))
    return [once[i : i + size] for i in range(0, len(once), size)]


def artist_candidates(pages: DataFrame) -> DataFrame:
    """(query, pos, mbid, name, score, aliases) of raw answers (query, value) to a search for an artist."""
    kind = "struct<id:string,name:string,score:int,aliases:array<struct<name:string>>>"
    rows = F.from_json("value", f"struct<artists:array<{kind}>>")["artists"]
    t = pages.select("query", F.posexplode(rows).alias("pos", "t")).where(F.coalesce("t.id", F.lit("")) != "")
    aliases = F.coalesce(F.col("t.aliases.name"), F.array().cast("array<string>"))
    return t.select("query", "pos", F.col("t.id").alias("mbid"), "t.name", F.coalesce("t.score", F.lit(0)).alias("score"), aliases.alias("aliases"))


def search_phrase(name: str) -> str | None:
    """The quoted search for an artist's name, or None for a blank one, for which nothing is asked."""
    name = name.strip()
    escaped = name.replace("\\", "\\\\").replace('"', '\\"')
    return f'artist:"{escaped}"' if name else None


def known_ids(pages: DataFrame) -> DataFrame:
    """(mbid) of raw answers (value), lists of artists that another collection holds already."""
    t = pages.select(F.explode(F.from_json("value", "array<struct<foreignArtistId:string>>")).alias("t"))
    return t.select(F.col("t.foreignArtistId").alias("mbid")).where(F.coalesce("mbid", F.lit("")) != "").distinct()


def read_landing(spark: SparkSession, path: str, user: str) -> DataFrame:
    return recent_tracks(spark.read.text(path, wholetext=True), user)


def fetch_window(last_played, now, explicit_from=None, explicit_to=None):
    """[from, to) of the next pull: explicit bounds, else an hour before the last play, else two days back."""
    from datetime import datetime, timedelta

    day = lambda s: isinstance(s, str) and len(s) == 10
    lo = explicit_from or (last_played - timedelta(hours=1) if last_played else now - timedelta(hours=48))
    hi = explicit_to
    if isinstance(lo, str):
        lo = datetime.fromisoformat(lo)
    if isinstance(hi, str):
        hi = datetime.fromisoformat(hi) + (timedelta(days=1) if day(explicit_to) else timedelta())
    return lo, hi
