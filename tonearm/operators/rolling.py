"""Rolling totals over trailing periods, kept as versioned daily state.

The state has one row per entity and day from the entity's first day on: the day's own amount ``n`` and a total per
window. A total over the last w days obeys total(d) = total(d - 1) + arrivals(d) - arrivals(d - w), and ``step`` does
just that: per entity it joins yesterday's totals (the state's row before the first affected date) with what arrives
and with the amounts of the state that expire, and carries the sum forward over the affected dates. It returns only
rows of affected dates, under a new version; nothing is rewritten, and the state as of now is the newest version of
every entity and day (``current``).

One step takes a day's arrivals (``advance``), late or withdrawn amounts of any age (``correct``), or a whole period
of both at once, as ``maintain`` does with the amounts of each fetch period in turn.

Affected are the days from a changed amount to w - 1 days later for the longest window, and the days without activity
between what the state covered and a day it did not: a late amount before the first known day adds all days up to it,
one after the newest day all days from there on.

Defined cases: an event without entity (NULL or empty) or without time belongs to no total; an entity with one event
has one day; repeated events count as given (deduplicate first where the data repeat); a play without fetch time
counts as fetched when it was played; an empty table gives an empty state; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import durable
from tonearm.sources.tables import present

WINDOWS = (7, 30)


def distinct_plays(plays: DataFrame) -> DataFrame:
    """(entity, day, n, version): distinct (lastfm_user, played_at, artist, title) per user, UTC day and version.

    A play belongs to the version in which it was first fetched: the half-year of its earliest ``fetched_at``, counted
    from year 0. The wide shuffle carries two 64-bit hashes of the four columns in place of the strings; the pair
    identifies a play (chance of any collision among 10^12 plays of one user and second: below 10^-14).
    """
    own = plays.where(present("lastfm_user") & F.col("played_at").isNotNull())
    identity = [F.coalesce(F.col("artist"), F.lit("\u0000")), F.coalesce(F.col("title"), F.lit("\u0000"))]
    keys = own.select(
        F.col("lastfm_user").alias("entity"),
        F.col("played_at"),
        F.xxhash64(*identity).alias("h1"),
        F.xxhash64(F.lit(1), *identity).alias("h2"),
        F.coalesce(F.col("fetched_at"), F.col("played_at")).alias("at"),
    )
    once = keys.groupBy("entity", "played_at", "h1", "h2").agg(F.min("at").alias("at"))
    version = (F.year("at") * 2 + F.floor((F.month("at") - 1) / 6).cast("int")).alias("version")
    return daily_amounts(once.select("entity", F.to_date("played_at").alias("day"), F.lit(1).alias("amount"), version), "version")


def daily_amounts(events: DataFrame, *further: str) -> DataFrame:
    """(entity, day, n) from rows (entity, day, amount); the partial sums run before the shuffle."""
    return events.groupBy("entity", "day", *further).agg(F.sum("amount").cast("long").alias("n")).select("entity", "day", "n", *further)


def empty_state(spark, windows: Sequence[int] = WINDOWS) -> DataFrame:
    totals = ", ".join(f"t{w} long" for w in windows)
    return spark.createDataFrame([], f"entity string, day date, n long, {totals}, version int")


def current(log: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The newest version of every entity and day; partitioned by entity, so what follows per entity does not shuffle."""
    fields = ["n", *[f"t{w}" for w in windows], "version"]
    newest = log.repartition("entity").groupBy("entity", "day").agg(F.max_by(F.struct(*fields), "version").alias("s"))
    return newest.select("entity", "day", *[F.col(f"s.{f}").alias(f) for f in fields])


def spans(state: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """(entity, start, end, known_first, known_last): the dates to recompute for each entity of ``batch``."""
    known = state.groupBy("entity").agg(F.min("day").alias("known_first"), F.max("day").alias("known_last"))
    asked = batch.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    newest = F.greatest("hi", "known_last")
    reach = F.greatest(F.date_add("hi", longest - 1), F.date_sub("known_first", 1))
    return asked.join(known, "entity", "left").select(
        "entity",
        F.least("lo", F.date_add("known_last", 1)).alias("start"),
        F.least(newest, reach).alias("end"),
        "known_first",
        "known_last",
    )


def step(state: DataFrame, batch: DataFrame, version: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The rows (entity, day, n, t<w>..., version) of the dates that ``batch`` (entity, day, n) affects.

    ``state`` holds one row per entity and day (``current``). One entity has at most one row per calendar day, so a
    window over one entity stays small however many events it has.
    """
    longest = max(windows)
    totals = [f"t{w}" for w in windows]
    batch = daily_amounts(batch.select("entity", "day", F.col("n").alias("amount")))
    none = [F.lit(None).cast("long").alias(t) for t in totals]
    both = state.select("entity", "day", "n", *totals, F.lit(False).alias("fresh")).unionByName(
        batch.select("entity", "day", "n", *none, F.lit(True).alias("fresh"))
    )
    near = both.join(spans(state, batch, longest), "entity").where(
        F.col("day").between(F.date_sub("start", longest), F.col("end"))
    )

    def change(day: Column, gain: dict[int, Column] | None = None, own: Column | None = None, touch: Column | None = None) -> Column:
        zero = F.lit(0).cast("long")
        gains = [(gain or {}).get(w, zero).alias(f"d{w}") for w in windows]
        return F.struct(day.alias("day"), *gains, (zero if own is None else own).alias("n"), (F.lit(0) if touch is None else touch).alias("touch"))

    n, fresh = F.col("n"), F.col("fresh")
    changes = [
        # What arrives, what of it expires, and yesterday's totals.
        F.when(F.col("day") >= F.col("start"), change(F.col("day"), dict.fromkeys(windows, n), n, fresh.cast("int"))),
        *[change(F.date_add("day", w), {w: -n}) for w in windows],
        F.when(
            ~fresh & (F.col("day") == F.date_sub("start", 1)), change(F.col("start"), {w: F.col(f"t{w}") for w in windows})
        ),
        # Where a changed amount stops to matter, and where days begin that the state did or did not cover.
        F.when(fresh, change(F.date_add("day", longest), touch=F.lit(-1))),
        *[F.when(fresh & d.isNotNull(), change(d)) for d in (F.col("start"), F.col("known_first"), F.date_add("known_last", 1))],
    ]
    bounds = ["start", "end", "known_first", "known_last"]
    on = near.select("entity", *bounds, F.explode(F.array_compact(F.array(*changes))).alias("c")).where(
        F.col("c.day").between(F.col("start"), F.col("end"))
    )
    summed = on.groupBy("entity", F.col("c.day").alias("day")).agg(
        *[F.sum(f"c.d{w}").alias(f"d{w}") for w in windows],
        F.sum("c.n").alias("n"), F.sum("c.touch").alias("touch"), *[F.first(b).alias(b) for b in bounds],
    )
    through = Window.partitionBy("entity").orderBy("day")
    running = through.rowsBetween(Window.unboundedPreceding, 0)
    runs = summed.select(
        "entity", "day", "n", "known_first", "known_last",
        F.coalesce(F.date_sub(F.lead("day").over(through), 1), F.col("end")).alias("until"),
        *[F.sum(f"d{w}").over(running).alias(f"t{w}") for w in windows],
        F.sum("touch").over(running).alias("touched"),
    )
    outside = (F.col("day") < F.col("known_first")) | (F.col("day") > F.col("known_last"))
    affected = runs.where((F.col("touched") > 0) | F.coalesce(outside, F.lit(True)))
    days = affected.withColumn("at", F.explode(F.sequence("day", "until")))
    own = F.when(F.col("at") == F.col("day"), F.col("n")).otherwise(0).cast("long").alias("n")
    return days.select("entity", F.col("at").alias("day"), own, *totals, F.lit(version).alias("version"))


def advance(state: DataFrame, arrivals: DataFrame, day: str, version: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The rows of ``day``: for each entity with arrivals (entity, day, n) that day or with a total still above zero.

    An entity whose longest total has fallen to zero gets no further rows; when it returns, the days between are
    filled.
    """
    today = F.lit(day).cast("date")
    last = state.groupBy("entity").agg(F.max("day").alias("last"), F.max_by(f"t{max(windows)}", "day").alias("t"))
    live = last.where((F.col("t") != 0) & (F.col("last") < today))
    idle = live.select("entity", today.alias("day"), F.lit(0).cast("long").alias("n"))
    return step(state, arrivals.where(F.col("day") == today).select("entity", "day", "n").unionByName(idle), version, windows)


def correct(state: DataFrame, late: DataFrame, version: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The rows that late amounts (entity, day, n; n < 0 withdraws) change or add, of any day."""
    return step(state, late, version, windows)


def maintain(arrivals: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """All versions of the state of ``arrivals`` (entity, day, n, version), each made from the one before.

    The versions are fetch periods, a number that grows with time and not with the data; every one is a step over
    the entities and dates it affects, written once to the shared folder.
    """
    arrivals = durable(arrivals)
    parts: list[DataFrame] = []
    for v in sorted(r[0] for r in arrivals.select("version").distinct().collect()):
        state = current(reduce(DataFrame.unionByName, parts), windows) if parts else empty_state(arrivals.sparkSession, windows)
        parts.append(durable(step(state, arrivals.where(F.col("version") == v), v, windows)))
    return reduce(DataFrame.unionByName, parts) if parts else empty_state(arrivals.sparkSession, windows)


def with_averages(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(entity, day, t<w>..., avg<w>...) up to each entity's last day with activity."""
    last = F.max(F.when(F.col("n") != 0, F.col("day"))).over(Window.partitionBy("entity"))
    days = state.withColumn("last", last).where(F.col("day") <= F.col("last"))
    averages = [(F.col(f"t{w}") / F.lit(float(w))).alias(f"avg{w}") for w in windows]
    return days.select("entity", "day", *[f"t{w}" for w in windows], *averages)


def quiet_and_peak_days(state: DataFrame) -> DataFrame:
    """(lastfm_user, day, kind): quiet days and peaks of full 30-day history, from ``current``."""
    whole = Window.partitionBy("entity")
    quiet = (F.col("t7") == 0) & (F.col("t30") > 0)
    peak = (F.col("t7") >= 10) & (F.col("t7") * 30 > F.col("t30") * 14)
    marked = state.select(
        F.col("entity").alias("lastfm_user"), "day",
        F.when(quiet, F.lit("quiet")).when(peak, F.lit("peak")).alias("kind"),
        F.min("day").over(whole).alias("first"), F.max(F.when(F.col("n") != 0, F.col("day"))).over(whole).alias("last"),
    )
    inside = F.col("day").between(F.date_add("first", 29), F.col("last"))
    return marked.where(F.col("kind").isNotNull() & inside).select("lastfm_user", F.date_format("day", "yyyy-MM-dd").alias("day"), "kind")
