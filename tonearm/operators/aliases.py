"""Aliases for couples and artists that the cascade does not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators import matching
from tonearm.session import durable
from tonearm.sources.tables import present

#: Order in which a couple's strategies are asked.
STRATEGIES = ("album-exact", "album-fuzzy", "artist-fuzzy")


def unique_best(hits: DataFrame) -> DataFrame:
    """(key, step, id, ambiguous) of hits (key, step, id, distance): the id of the least distance, if it is one."""
    least = Window.partitionBy("key", "step")
    best = hits.withColumn("least", F.min("distance").over(least)).where("distance = least")
    one = best.groupBy("key", "step").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return one.select("key", "step", F.when(F.col("n") == 1, F.col("id")).alias("id"), (F.col("n") > 1).alias("ambiguous"))


def near_in_bucket(asked: DataFrame, bucket: DataFrame, most: int) -> DataFrame:
    """(key, b, id, distance) of asked (key, b, t) and bucket (b, id, t) rows of one bucket within ``most`` edits.

    Bucket and title meet as one string on its segments, so a large bucket is not crossed with what asks for it.
    """
    joined = lambda df: df.withColumn("s", F.concat("b", F.lit("\u0001"), "t"))
    short = (F.octet_length("t") <= 255) & present("t") & present("b")
    left = joined(asked.where(short).select("key", "b", "t"))
    right = joined(bucket.where(short).select("b", "id", "t")).select(F.col("b").alias("rb"), "id", F.col("t").alias("rt"), F.col("s").alias("rs"))
    near = matching.near_strings(left.select("s"), right.select("rs"), most)
    met = near.join(left.withColumnRenamed("s", "l"), "l").join(right.withColumnRenamed("rs", "r"), "r")
    return met.where("b = rb").select("key", "b", "id", "distance")


def track_aliases(couples: DataFrame, library: DataFrame, existing: DataFrame, album_most: int = 5, artist_most: int = 2) -> DataFrame:
    """(artist, title, plays, id, strategy, state) of unmatched couples (artist, title, albums array, plays).

    ``library`` is (id, artist, title, mbz_album_id); ``existing`` the normalised couples (a, t) that have an alias.
    ``state`` is ``alias``, ``ambiguous``, ``existing``, ``resolvable`` (the artist has that very title) or ``none``.
    Album by album, in the order of their identifiers: the title alone in the album, or nearest in it; then the nearest
    title of the artist.
    """
    norm = durable(matching.norms(couples.select("artist"), couples.select("title"), library.select("artist"), library.select("title")))
    named = lambda df: matching.with_norm(matching.with_norm(df, F.col("artist"), "a", norm), F.col("title"), "t", norm)
    asked = named(couples).where(present("t")).withColumn("key", F.xxhash64("artist", "title"))
    owned = durable(named(library).select("id", "a", "t", "mbz_album_id"))
    known = asked.join(existing.select("a", "t").distinct().withColumn("exists", F.lit(True)), ["a", "t"], "left")
    own = owned.select("a", "t").where(present("a")).distinct().withColumn("owned", F.lit(True))
    marked = durable(known.join(own, ["a", "t"], "left"))
    open_ = marked.where("exists IS NULL AND owned IS NULL")

    albums = open_.select("key", "t", F.posexplode("albums").alias("pos", "b")).where(present("b"))
    in_album = owned.where(present("mbz_album_id")).select(F.col("mbz_album_id").alias("b"), "id", "t")
    place = lambda hits, strategy: hits.join(albums.select("key", "b", "pos"), ["key", "b"]).select("key", F.struct(F.lit(strategy).alias("s"), "pos").alias("step"), "id", "distance")
    exact = place(albums.join(in_album, ["b", "t"]).select("key", "b", "id", F.lit(0).alias("distance")), 0)
    fuzzy = place(near_in_bucket(albums, in_album, album_most), 1)
    by_artist = owned.where(present("a")).select(F.col("a").alias("b"), "id", "t")
    asked_artist = open_.where(present("a")).select("key", F.col("a").alias("b"), "t")
    third = near_in_bucket(asked_artist, by_artist, artist_most).select("key", F.struct(F.lit(2).alias("s"), F.lit(0).alias("pos")).alias("step"), "id", "distance")
    steps = unique_best(exact.unionByName(fuzzy).unionByName(third))
    first = steps.groupBy("key").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("step", "id"))).alias("x"), F.max("ambiguous").alias("ambiguous"))
    out = marked.join(first, "key", "left")
    hit = F.col("x.id").isNotNull()
    state = (
        F.when(F.col("exists").isNotNull(), "existing").when(F.col("owned").isNotNull(), "resolvable")
        .when(hit, "alias").when(F.col("ambiguous"), "ambiguous").otherwise("none")
    )
    name = F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("x.step.s") + 1)
    return out.select("artist", "title", "plays", F.col("x.id").alias("id"), F.when(hit, name).alias("strategy"), state.alias("state"))


def candidate_names(candidates: DataFrame) -> DataFrame:
    """(query, mbid, score, name) of candidates with aliases: every different name once, its first spelling kept."""
    named = candidates.select("query", "mbid", "score", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "n"))
    named = named.where(present(F.trim("n")))
    order = Window.partitionBy("query", "mbid", F.lower(F.trim("n"))).orderBy("pos")
    return named.withColumn("k", F.row_number().over(order)).where("k = 1").select("query", "mbid", "score", F.col("n").alias("name"))


def suggest(unmatched: DataFrame, candidates: DataFrame, library: DataFrame, aliased: DataFrame, least_plays: int = 0, least_score: int = 80) -> DataFrame:
    """(source, plays, kind, targets) for unmatched artists (artist, plays) from looked-up candidates.

    ``candidates`` is (query, mbid, name, score, aliases), ``library`` (name), ``aliased`` (source_artist). A good
    candidate whose name or alias is an owned artist points at it, under the owned name's first spelling; one target is
    an alias (``unique``), several are ``ambiguous``, none is ``none``. Owned and aliased artists are not asked about.
    """
    norm = durable(matching.norms(unmatched.select("artist"), library.select("name"), aliased.select("source_artist"), candidates.select("name"), candidates.select(F.explode("aliases"))))
    named = lambda df, c: matching.with_norm(df, F.col(c), "a", norm).where(present("a"))
    owned = named(library, "name").groupBy("a").agg(F.min("name").alias("target"))
    asked = named(unmatched, "artist").where(F.col("plays") >= least_plays)
    asked = asked.join(owned, "a", "left_anti").join(named(aliased, "source_artist").select("a"), "a", "left_anti")
    good = named(candidate_names(candidates.where(F.col("score") >= least_score)), "name")
    targets = good.join(owned, "a").select(F.col("query").alias("artist"), "target").distinct()
    grouped = targets.groupBy("artist").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    n = F.size(F.coalesce("targets", F.array().cast("array<string>")))
    kind = F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("none")
    return asked.join(grouped, "artist", "left").select(F.col("artist").alias("source"), "plays", kind.alias("kind"), "targets")
