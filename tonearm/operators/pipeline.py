"""The sync pipeline as one plan: aliases, memo, cascade, corrections and fuzzy lookup, classification, flush.

Where the rules ask one source after the other for one play at a time, here every source is a table and every stage a
join; the order of the stages is a number, and the smallest one wins. The first pending play of a couple (by time and
id) decides for all plays of the couple, as the memo of answers makes it do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators import matching, sync
from tonearm.session import durable
from tonearm.sources.tables import epoch_seconds, present

REQUEST = ["artist", "title", "album", "mbid_track"]
TRACK_ALIAS = "source_artist string, source_title string, target_id string"
ARTIST_ALIAS = "source_artist string, target_artist string"
CACHE = "artist_norm string, title_norm string, target_id string, strategy string, resolved_at timestamp_ntz"
#: What a lookup of a play's names answered: an identifier, or names spelled otherwise.
LOOKUP = "artist string, title string, mbid string, corrected_artist string, corrected_title string"


def stale(resolved: str, now: Column, days: int) -> Column:
    """Whether an answer has outlived ``days``; zero or less never ends."""
    return F.col(resolved) < now - F.expr(f"INTERVAL {int(days)} DAYS") if days > 0 else F.lit(False)


def variants(requests: DataFrame, corrections: DataFrame, infos: DataFrame) -> DataFrame:
    """(key, rank, artist, title, album, mbid_track) to try for each request, in order.

    0 as written; 1 with corrected names; 2 the identifier that the fuller lookup knows; 3 the names that it knows.
    """
    own = requests.select("key", F.lit(0).alias("rank"), *REQUEST)
    renamed = (F.coalesce("corrected_artist", "artist").alias("artist"), F.coalesce("corrected_title", "title").alias("title"), "album")
    spelled = present("corrected_artist") | present("corrected_title")
    asked = lambda lookup: requests.join(lookup, ["artist", "title"])
    mbid = F.coalesce(F.nullif("mbid", F.lit("")), "mbid_track").alias("mbid_track")
    first = asked(corrections).where(spelled).select("key", F.lit(1).alias("rank"), *renamed, mbid)
    known, none = asked(infos), F.lit(None).cast("string")
    second = known.where(present("mbid")).select("key", F.lit(2).alias("rank"), none.alias("artist"), none.alias("title"), none.alias("album"), F.col("mbid").alias("mbid_track"))
    third = known.where(spelled).select("key", F.lit(3).alias("rank"), *renamed, mbid)
    return own.unionByName(first).unionByName(second).unionByName(third)


def run_cascade(requests: DataFrame, library: DataFrame, corrections: DataFrame | None = None, infos: DataFrame | None = None, fuzzy: int = 0) -> DataFrame:
    """(key, target_id, strategy) of the requests (key, artist, title, album, mbid_track) that some stage answers."""
    spark = requests.sparkSession
    none = spark.createDataFrame([], LOOKUP)
    tried = durable(variants(requests, corrections or none, infos or none))
    table = durable(matching.norm_table(tried, library))
    prepared, owned = durable(matching.prepared_requests(tried, table)), durable(matching.prepared_library(library, table))
    hits = matching.answered(prepared, owned).join(prepared.select("request", *REQUEST), "request")
    same = reduce(Column.__and__, [F.col(f"v.{c}").eqNullSafe(F.col(f"h.{c}")) for c in REQUEST])
    met = tried.alias("v").join(hits.alias("h"), same).select("key", "rank", F.col("h.b").alias("b"))
    best = met.groupBy("key").agg(F.min(F.struct("rank", "b.stage", "b.id")).alias("x"))
    stage = F.element_at(F.array(F.lit("mbid"), F.lit("triplet"), F.lit("couple")), F.col("x.stage"))
    found = best.select("key", F.col("x.id").alias("target_id"), F.when(F.col("x.rank") > 0, "correction").otherwise(stage).alias("strategy"))
    if fuzzy <= 0:
        return found
    left = requests.join(found, "key", "left_anti")
    for column, into in (("artist", "a"), ("title", "t")):
        left = matching.with_norm(left, F.col(column), into, table)
    near = matching.fuzzy_match(left, owned, fuzzy)
    return found.unionByName(left.join(near, ["a", "t"]).select("key", F.col("id").alias("target_id"), F.lit("fuzzy").alias("strategy")))


def match(
    plays: DataFrame, library: DataFrame, now: Column, *, track_aliases: DataFrame | None = None, artist_aliases: DataFrame | None = None,
    cache: DataFrame | None = None, corrections: DataFrame | None = None, infos: DataFrame | None = None, fuzzy: int = 0, ttl_days: int = 30,
) -> DataFrame:
    """(id, artist_norm, title_norm, target_id, strategy, source) of ``plays`` (id, artist, title, album, mbid_track, played_at).

    ``source`` tells what decided: ``alias``, ``skip``, ``cache`` (positive, for ever), ``negative`` (until it is
    stale), ``cascade``. A track alias is looked up under the artist as played, everything after it under the artist
    that an artist alias puts in its place.
    """
    spark = plays.sparkSession
    track_aliases = track_aliases if track_aliases is not None else spark.createDataFrame([], TRACK_ALIAS)
    artist_aliases = artist_aliases if artist_aliases is not None else spark.createDataFrame([], ARTIST_ALIAS)
    cache = cache if cache is not None else spark.createDataFrame([], CACHE)
    raws = [plays.select("artist"), plays.select("title"), track_aliases.select("source_artist"), track_aliases.select("source_title"), artist_aliases.select("source_artist"), artist_aliases.select("target_artist")]
    norm = durable(matching.norms(*raws))
    named = lambda df, column, into: matching.with_norm(df, F.col(column), into, norm)
    played = named(named(plays.select("id", *REQUEST, "played_at"), "artist", "own"), "title", "title_norm")
    tracks = named(named(track_aliases, "source_artist", "own"), "source_title", "title_norm").where(present("own") & present("title_norm"))
    tracks = tracks.groupBy("own", "title_norm").agg(F.min("target_id").alias("alias_id"), F.lit(True).alias("aliased"))
    artists = named(artist_aliases, "source_artist", "own").where(present("own")).groupBy("own").agg(F.min("target_artist").alias("instead"))
    renamed = played.join(tracks, ["own", "title_norm"], "left").join(artists, "own", "left")
    renamed = renamed.withColumn("artist", F.coalesce(F.nullif("instead", F.lit("")), "artist")).drop("instead", "own")
    keyed = named(renamed, "artist", "artist_norm")
    memo = cache.select("artist_norm", "title_norm", F.col("target_id").alias("memo_id"), F.col("strategy").alias("memo"), stale("resolved_at", now, ttl_days).alias("stale"))
    keyed = durable(keyed.join(memo, ["artist_norm", "title_norm"], "left"))

    source = (
        F.when(F.col("aliased") & F.col("alias_id").isNull(), "skip")
        .when(F.col("aliased"), "alias")
        .when(F.col("memo_id").isNotNull(), "cache")
        .when(F.col("memo").isNotNull() & ~F.col("stale"), "negative")
        .otherwise("cascade")
    )
    decided = keyed.withColumn("source", source)
    known = present("artist_norm") & present("title_norm")
    # Names that normalise to nothing have no couple to share an answer.
    couple = F.when(known, F.xxhash64("artist_norm", "title_norm", F.lit(-1))).otherwise(F.xxhash64("id"))
    open_ = decided.where("source = 'cascade'").withColumn("key", couple)
    first = open_.groupBy("key").agg(F.min_by(F.struct(*REQUEST), F.struct("played_at", "id")).alias("r")).select("key", "r.*")
    answers = run_cascade(durable(first), library, corrections, infos, fuzzy)
    columns = ["id", "artist_norm", "title_norm", "target_id", "strategy", "source"]
    answered = open_.join(answers, "key", "left").select(*columns)
    other = decided.where("source <> 'cascade'")
    target = F.when(F.col("source") == "alias", F.col("alias_id")).when(F.col("source") == "cache", F.col("memo_id")).alias("target_id")
    strategy = F.when(F.col("source") == "cache", F.col("memo")).alias("strategy")
    return answered.unionByName(other.select("id", "artist_norm", "title_norm", target, strategy, "source"))


def memo_rows(matched: DataFrame, now: Column) -> DataFrame:
    """The memo's new entries: what the cascade answered, or did not (strategy ``negative``), per couple."""
    own = matched.where("source = 'cascade'").where(present("artist_norm") & present("title_norm"))
    one = own.groupBy("artist_norm", "title_norm").agg(F.min("target_id").alias("target_id"), F.min("strategy").alias("strategy"))
    return one.select("artist_norm", "title_norm", "target_id", F.coalesce("strategy", F.lit("negative")).alias("strategy"), now.alias("resolved_at"))


def remember(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The memo after new entries; one row per couple, the newest."""
    return sync.upsert(cache, rows, ["artist_norm", "title_norm"], "resolved_at")


def forget(cache: DataFrame, couples: DataFrame | None = None, artists: DataFrame | None = None, negative_only: bool = False) -> DataFrame:
    """The memo without the couples (artist_norm, title_norm), the artists (artist_norm), or, with neither, without all.

    ``negative_only`` keeps the positive entries of what would go.
    """
    kept = cache.where(F.col("target_id").isNotNull()) if negative_only else cache.limit(0)
    loose = cache.where(F.col("target_id").isNull()) if negative_only else cache
    if couples is not None:
        return kept.unionByName(sync.purge(loose, couples, ["artist_norm", "title_norm"]))
    if artists is not None:
        return kept.unionByName(sync.purge(loose, artists, ["artist_norm"]))
    return kept


def classify(matched: DataFrame, plays: DataFrame, existing: DataFrame, tolerance: int = 60, dry_run: bool = False) -> DataFrame:
    """(id, status, target_id, strategy, user_id, t) of matched plays.

    ``plays`` is (id, user_id, t); ``existing`` (user_id, media_file_id, t) are the library's plays. A play is a
    duplicate if the library has one of the same user and track within the tolerance, or if this run accepts one. A
    dry run accepts nothing, so its plays are compared with the library alone.
    """
    rows = durable(matched.select("id", "target_id", "strategy", "source").join(plays.select("id", "user_id", "t"), "id"))
    entity = lambda c: F.concat_ws("|", "user_id", c).alias("entity")
    found = rows.where(F.col("target_id").isNotNull()).select("id", entity("target_id"), "t")
    there = sync.near_existing(found, existing.select(entity("media_file_id"), "t"), tolerance).select("id")
    fresh = found.join(there, "id", "left_anti")
    taken = fresh.select("id", F.lit(True).alias("accepted")) if dry_run else sync.suppress_near_duplicates(fresh, tolerance)
    status = (
        F.when(F.col("source") == "skip", "skipped")
        .when(F.col("target_id").isNull(), "unmatched")
        .when(F.coalesce("accepted", F.lit(False)), "matched")
        .otherwise("duplicate")
    )
    return rows.join(taken, "id", "left").select("id", status.alias("status"), "target_id", "strategy", "user_id", "t")


def flush(outcome: DataFrame, existing: DataFrame, annotation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new library plays, annotations of the touched tracks) of an outcome; sync rows follow from the outcome itself."""
    new = outcome.where("status = 'matched'").select("user_id", F.col("target_id").alias("media_file_id"), F.col("t").alias("submission_time"))
    touched = new.select("user_id", "media_file_id").distinct()
    both = existing.select("user_id", "media_file_id", "submission_time").unionByName(new)
    counted = both.join(touched, ["user_id", "media_file_id"], "left_semi")
    own = annotation.join(touched.withColumnRenamed("media_file_id", "item_id"), ["user_id", "item_id"], "left_semi")
    ts = F.expr("timestampadd(SECOND, submission_time, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return new, sync.reconcile(own, counted.select("user_id", "media_file_id", ts.alias("ts")))


def pending_plays(plays: DataFrame, states: DataFrame, users: DataFrame, target: str) -> DataFrame:
    """Plays whose row for the target is missing or pending, with the library's ``user_id`` and epoch ``t``."""
    open_ = sync.pending(plays, states.select("scrobble_id", "target", "status"), target).drop("status")
    named = open_.join(users.select(F.col("user_name").alias("lastfm_user"), F.col("id").alias("user_id")), "lastfm_user")
    return named.withColumn("t", epoch_seconds("played_at"))


def report(outcome: DataFrame) -> DataFrame:
    """(matched, duplicates, unmatched, skipped, considered): one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    return outcome.agg(n("matched").alias("matched"), n("duplicate").alias("duplicates"), n("unmatched").alias("unmatched"), n("skipped").alias("skipped"), F.count(F.lit(1)).alias("considered"))


def counter_sync(outcome: DataFrame, songs: DataFrame) -> DataFrame:
    """Songs (id, playcount, lastplayed) of a target that keeps counters, after the outcome's matched plays."""
    plays = outcome.where("status = 'matched'").select(F.col("target_id").cast(dict(songs.dtypes)["id"]).alias("id"), F.col("t").alias("epoch"))
    return sync.counter_deltas(songs, plays)


def match_counters(requests: DataFrame, songs: DataFrame) -> DataFrame:
    """(key, id) of a target with counters: identifier, then exact names, then names without guests and markers.

    Titles are equal in lower case and by their norm, artists by their norm; of several songs the one with most plays,
    then the smallest id. ``songs`` is (id, artist, title, mbz_track_id, mbz_recording_id, playcount).
    """
    from tonearm.functions import text

    bare = text.strip_title_featuring(text.strip_version(F.col("title")))
    plain = text.strip_featured(F.col("artist"))
    pair = lambda a, t, s: F.struct(F.lit(s).alias("stage"), a.alias("va"), t.alias("vt"))
    options = F.array(*[pair(a, t, 2 if (a is plain or t is bare) else 1) for a in (F.col("artist"), plain) for t in (F.col("title"), bare)])
    asked = requests.select("key", F.explode(options).alias("o")).select("key", "o.*").where(present("va") & present("vt"))
    norm = durable(matching.norms(asked.select("va"), asked.select("vt"), songs.select("artist"), songs.select("title")))
    named = lambda df, c, into: matching.with_norm(df, F.col(c), into, norm)
    left = named(named(asked, "va", "a"), "vt", "n").withColumn("lt", F.lower("vt"))
    right = named(named(songs, "artist", "a"), "title", "n").withColumn("lt", F.lower("title")).select("a", "n", "lt", "id", "playcount")
    names = left.join(right, ["a", "n", "lt"]).select("key", "stage", "id", "playcount")
    ids = F.explode(F.array_distinct(F.array("mbz_track_id", "mbz_recording_id"))).alias("mbid_track")
    known = songs.select("id", "playcount", ids).where(present("mbid_track"))
    by_id = requests.where(present("mbid_track")).join(known, "mbid_track").select("key", F.lit(0).alias("stage"), "id", "playcount")
    order = Window.partitionBy("key").orderBy("stage", F.col("playcount").desc(), "id")
    return names.unionByName(by_id).withColumn("k", F.row_number().over(order)).where("k = 1").select("key", "id")
