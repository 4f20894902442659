"""The matching cascade: identifiers, unique triplets, prioritised couples, bounded edit distance, diagnosis.

Every stage is an equi-join. The steps of the couple stage are rows of one request table, each with a priority, so
the whole cascade is one join and one minimum instead of a chain of lookups; OR conditions never reach the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.session import durable
from tonearm.sources.tables import present


def norms(*columns: DataFrame) -> DataFrame:
    """(raw, norm) of every different string of the one-column tables; each passes the normaliser once."""
    raw = reduce(DataFrame.union, [c.toDF("raw") for c in columns]).where(present("raw")).distinct()
    return raw.withColumn("norm", text.normalize(F.col("raw")))


def with_norm(df: DataFrame, column: Column, into: str, table: DataFrame) -> DataFrame:
    # Rows without the string are spread over the tasks.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(997)).cast("string"))
    keyed = df.withColumn("_raw", F.when(present(column), column).otherwise(spread))
    joined = keyed.join(table.select(F.col("raw").alias("_raw"), F.col("norm").alias(into)), "_raw", "left")
    return joined.drop("_raw")


def by_identifier(requests: DataFrame, library: DataFrame) -> DataFrame:
    """(request, id): the smallest library id with the identifier in either identifier column."""
    keys = F.explode(F.array_distinct(F.array("mbz_track_id", "mbz_recording_id"))).alias("identifier")
    keyed = library.select("id", keys).where(present("identifier")).groupBy("identifier").agg(F.min("id").alias("id"))
    return requests.where(present("identifier")).join(keyed, "identifier").select("request", "id")


def unique_only(requests: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """(request, id, n): library rows by key; the id counts only where exactly one row has the key."""
    entries = library.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return requests.join(entries, keys).select("request", F.when(F.col("n") == 1, F.col("id")).alias("id"), "n")


def by_triplet(requests: DataFrame, library: DataFrame) -> DataFrame:
    """Exact artist, title and album; without any exact row, the same on albums without decoration."""
    exact = unique_only(requests, library, ["a", "t", "al"])
    rest = requests.join(exact, "request", "left_anti")
    stripped = unique_only(rest.drop("al").withColumnRenamed("al_bare", "al"), library.drop("al").withColumnRenamed("al_bare", "al"), ["a", "t", "al"])
    return exact.unionByName(stripped).where(F.col("id").isNotNull()).select("request", "id")


def couple_entries(library: DataFrame) -> DataFrame:
    """(mode, a, t, rank, id): the keys under which a track answers each kind of request."""
    # The text before each of the separators, not only before the first.
    words, marks = F.split("a", " "), ("feat", "ft", "featuring", "with")
    before = lambda w, i: F.when(w.isin(*marks) & (i > 0) & (i < F.size(words) - 1), F.array_join(F.slice(words, 1, i), " "))
    prefixes = F.explode(F.array_compact(F.transform(words, before))).alias("a")
    own = library.select(F.lit("any").alias("mode"), "a", "t", F.lit(0).alias("rank"), "id")
    album = library.where(present("aa")).select(F.lit("any").alias("mode"), F.col("aa").alias("a"), "t", F.lit(1).alias("rank"), "id")
    led = library.select(F.lit("feat").alias("mode"), prefixes, "t", F.lit(0).alias("rank"), "id")
    both = library.where(F.col("a") == F.col("aa")).select(F.lit("both").alias("mode"), "a", "t", F.lit(0).alias("rank"), "id")
    return own.unionByName(album).unionByName(led).unionByName(both).where(present("a") & present("t"))


def couple_requests(requests: DataFrame) -> DataFrame:
    """(request, priority, mode, a, t) of the seven steps; ``a``/``t`` in full, ``lead``, ``bare``, ``marked``."""
    steps = [
        (1, "any", "a", "t", F.lit(True)),
        (2, "any", "lead", "t", F.col("lead") != F.col("a")),
        (3, "any", "a", "bare", F.col("bare") != F.col("t")),
        (4, "feat", "a", "bare", F.col("marked")),
        (5, "any", "lead", "bare", (F.col("lead") != F.col("a")) & (F.col("bare") != F.col("t"))),
        (6, "feat", "a", "t", ~F.col("marked")),
        (7, "both", "lead", "t", F.col("lead") != F.col("a")),
    ]
    options = F.array(
        *[
            F.when(cond, F.struct(F.lit(p).alias("priority"), F.lit(m).alias("mode"), F.col(a).alias("a"), F.col(t).alias("t")))
            for p, m, a, t, cond in steps
        ]
    )
    return requests.select("request", F.explode(F.array_compact(options)).alias("s")).select("request", "s.*").where(
        present("a") & present("t")
    )


def by_couple(requests: DataFrame, library: DataFrame) -> DataFrame:
    met = couple_requests(requests).join(couple_entries(library), ["mode", "a", "t"])
    best = met.groupBy("request").agg(F.min(F.struct("priority", "rank", "id")).alias("b"))
    return best.select("request", F.col("b.id").alias("id"))


def prepared_requests(plays: DataFrame, table: DataFrame) -> DataFrame:
    """One request per different (artist, title, album, mbid_track) of ``plays``, with its normalised forms."""
    columns = ["artist", "title", "album", "mbid_track"]
    r = plays.select(*columns).distinct().withColumn("request", F.xxhash64(*columns))
    bare = text.strip_truncated(text.strip_title_featuring(text.strip_version(text.strip_track_number(F.col("title")))))
    for column, into in (
        (F.col("artist"), "a"), (F.col("title"), "t"), (F.col("album"), "al"), (text.strip_decoration(F.col("album")), "al_bare"),
        (text.strip_featured(text.lead_artist(F.col("artist"))), "lead"), (bare, "bare"),
    ):
        r = with_norm(r, column, into, table)
    return r.withColumn("marked", text.has_featuring(F.col("title"))).withColumn("identifier", F.col("mbid_track"))


def prepared_library(media_file: DataFrame, table: DataFrame) -> DataFrame:
    out = media_file
    for column, into in (
        (F.col("artist"), "a"), (F.col("album_artist"), "aa"), (F.col("title"), "t"), (F.col("album"), "al"),
        (text.strip_decoration(F.col("album")), "al_bare"),
    ):
        out = with_norm(out, column, into, table)
    return out


def norm_table(plays: DataFrame, media_file: DataFrame) -> DataFrame:
    bare = text.strip_truncated(text.strip_title_featuring(text.strip_version(text.strip_track_number(F.col("title")))))
    lead = text.strip_featured(text.lead_artist(F.col("artist")))
    forms = lambda df, *cs: [df.select(c) for c in cs]
    return norms(
        *forms(plays, "artist", "title", "album", text.strip_decoration(F.col("album")), lead, bare),
        *forms(media_file, "artist", "album_artist", "title", "album", text.strip_decoration(F.col("album"))),
    )


def answered(requests: DataFrame, library: DataFrame) -> DataFrame:
    """(request, b) of the requests that a stage answers; ``b`` is the first such stage and its id."""
    stages = [
        by_identifier(requests, library).select("request", "id", F.lit(1).alias("stage")),
        by_triplet(requests.where(present("album")), library).select("request", "id", F.lit(2).alias("stage")),
        by_couple(requests, library).select("request", "id", F.lit(3).alias("stage")),
    ]
    return reduce(DataFrame.unionByName, stages).groupBy("request").agg(F.min(F.struct("stage", "id")).alias("b"))


def match_cascade(plays: DataFrame, media_file: DataFrame) -> DataFrame:
    """(artist, title, album, mbid_track, media_file_id, strategy) of the requests that a stage answers."""
    # Several stages read all three, so each string is normalised once.
    table = durable(norm_table(plays, media_file))
    requests, library = durable(prepared_requests(plays, table)), durable(prepared_library(media_file, table))
    best = answered(requests, library)
    name = F.element_at(F.array(F.lit("mbid"), F.lit("triplet"), F.lit("couple")), F.col("b.stage"))
    return requests.join(best, "request").select(
        "artist", "title", "album", "mbid_track", F.col("b.id").alias("media_file_id"), name.alias("strategy")
    )


def near_strings(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(l, r, distance) of the strings of two one-column tables within ``most`` edits.

    ``most`` edits leave one of ``most + 1`` segments of the right-hand string whole, at a place moved by at most
    ``most``; only strings that share one are compared. Shorter strings than there are segments are compared on
    their whole block of lengths.
    """
    n = most + 1
    border = lambda size, i: F.floor(size * i / n)
    piece = lambda c, size, i, s: F.substring(c, (border(size, i) + s + 1).cast("int"), (border(size, i + 1) - border(size, i)).cast("int"))
    l, r = left.toDF("l").where(F.col("l").isNotNull()).distinct(), right.toDF("r").where(F.col("r").isNotNull()).distinct()
    # The places are rows, not one expression each, so the generated code stays small.
    place = lambda d, i, s: F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s"))
    moves = range(-most, most + 1)
    places = [place(d, i, s) for d in moves for i in range(n) for s in moves if abs(s) + abs(d + s) <= most]
    size = F.length("l") + F.col("p.d")
    probe = l.select("l", F.explode(F.array(*places)).alias("p")).where((size >= 0) & (border(size, F.col("p.i")) + F.col("p.s") >= 0))
    index = r.select("r", F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("i"))
    met = (
        probe.select("l", F.xxhash64(size, "p.i", piece(F.col("l"), size, F.col("p.i"), F.col("p.s"))).alias("k"))
        .join(
            index.select("r", F.xxhash64(F.length("r"), "i", piece(F.col("r"), F.length("r"), F.col("i"), F.lit(0))).alias("k")), "k"
        )
        .select("l", "r")
        .distinct()
    )
    distance = text.byte_levenshtein(F.col("l"), F.col("r"), most)
    return met.withColumn("distance", distance).where(F.col("distance") >= 0)


def fuzzy_match(requests: DataFrame, library: DataFrame, most: int) -> DataFrame:
    """(a, t, id, distance): the nearest track by the sum of artist and title distance, smallest id on ties.

    Both tables hold normalised ``a`` and ``t``. As in the rules matched, artist or title must share three letters
    at the beginning, and no string may exceed 255 bytes.
    """
    short = (F.octet_length("a") <= 255) & (F.octet_length("t") <= 255) & present("a") & present("t")
    asked = requests.select("a", "t").where(short).distinct()
    tracks = library.select(F.col("a").alias("la"), F.col("t").alias("lt"), "id").where(
        (F.octet_length("a") <= 255) & (F.octet_length("t") <= 255) & present("a") & present("t")
    )
    # The edits of artist and title add up to no less than those of the two as one string, so couples meet on segments
    # of that string, and a title that many artists share crosses none of them.
    couple = lambda a, t: F.concat(F.col(a), F.lit("\u0001"), F.col(t))
    asked, tracks = asked.withColumn("l", couple("a", "t")), tracks.withColumn("r", couple("la", "lt"))
    near = near_strings(asked.select("l"), tracks.select("r"), most).select("l", "r")
    prefix = lambda x, y: F.substring(x, 1, 3) == F.substring(y, 1, 3)
    met = near.join(asked, "l").join(tracks, "r").where(prefix("a", "la") | prefix("t", "lt"))
    da, dt = text.byte_levenshtein(F.col("a"), F.col("la"), most), text.byte_levenshtein(F.col("t"), F.col("lt"), most)
    scored = met.withColumn("da", da).withColumn("dt", dt).where("da >= 0 AND dt >= 0").where(F.col("da") + F.col("dt") <= most)
    best = scored.groupBy("a", "t").agg(F.min(F.struct((F.col("da") + F.col("dt")).alias("distance"), "id")).alias("b"))
    return best.select("a", "t", "b.id", "b.distance")


def nearest_names(names: DataFrame, library: DataFrame, most: int, limit: int = 3) -> DataFrame:
    """(name, near, distance, k): up to ``limit`` nearest different library names with the same first letter."""
    near = near_strings(names, library, most).where((F.col("distance") > 0) & (F.substring("l", 1, 1) == F.substring("r", 1, 1)))
    order = Window.partitionBy("l").orderBy("distance", "r")
    ranked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    return ranked.select(F.col("l").alias("name"), F.col("r").alias("near"), "distance", "k")


def diagnose(couples: DataFrame, library: DataFrame) -> DataFrame:
    """(a, t, verdict) of normalised unmatched couples: what stands in the way of a match."""
    owned = library.select("a").union(library.select("aa")).where(present("a")).distinct().toDF("a").withColumn("owned", F.lit(True))
    asked = couples.select("a", "t").distinct()
    names = asked.select("a").join(owned, "a", "left_anti")
    close = nearest_names(names, library.select("a").where(present("a")), 2, 1).select(F.col("name").alias("a"), F.lit(True).alias("close"))
    held = couple_entries(library).where("mode = 'any'").select("a", "t").distinct().withColumn("held", F.lit(True))
    titles = near_strings(asked.select("t"), library.select("t"), 3).where("distance > 0").select(F.col("l").alias("t"), F.col("r"))
    entries = couple_entries(library).where("mode = 'any'").select("a", F.col("t").alias("r")).distinct()
    almost = asked.join(titles, "t").join(entries, ["a", "r"], "left_semi").select("a", "t").distinct().withColumn("almost", F.lit(True))
    out = asked.join(owned, "a", "left").join(close, "a", "left").join(held, ["a", "t"], "left").join(almost, ["a", "t"], "left")
    verdict = (
        F.when(~(present("a") & present("t")), "unknown")
        .when(F.col("owned").isNull() & F.col("close").isNotNull(), "artist_near_match")
        .when(F.col("owned").isNull(), "artist_unknown")
        .when(F.col("held").isNotNull(), "matcher_gap")
        .when(F.col("almost").isNotNull(), "title_near_match")
        .otherwise("track_missing")
    )
    return out.select("a", "t", verdict.alias("verdict"))


def artist_aliases(unmatched: DataFrame, library: DataFrame) -> DataFrame:
    """(source, target) from a shared artist identifier; the source is not owned, the first spelling wins.

    ``unmatched`` is (artist, mbid_artist, plays) with norms in ``a``; ``library`` is (artist, mbid, a).
    """
    candidates = unmatched.where(present("mbid_artist")).join(library.select("a"), "a", "left_anti")
    targets = library.where(present("mbid")).select(F.col("mbid").alias("mbid_artist"), F.col("artist").alias("target"), F.col("a").alias("ta"))
    met = candidates.join(targets, "mbid_artist").where(F.col("a") != F.col("ta"))
    order = Window.partitionBy("a").orderBy(F.col("plays").desc(), "artist", "target")
    return met.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("artist").alias("source"), "target", "a")
