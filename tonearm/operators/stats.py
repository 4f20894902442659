"""Counts, top lists and time series over plays.

``plays`` is a play log with a zone-less UTC timestamp ``ts``; library plays also carry the track's columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.filters import between, moment
from tonearm.sources.tables import present


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``n``: distinct combinations, NULL being a value like any other."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n"))


def of_known(groups: DataFrame, item: str, known: DataFrame | None) -> DataFrame:
    """The groups whose item is in ``known`` (id); plays are counted first, so the join meets groups and not plays."""
    return groups if known is None else groups.join(known.select(F.col("id").alias(item)), item, "left_semi")


def top(
    df: DataFrame, keys: Sequence, order: Sequence[Column], limit: int | None, known: DataFrame | None = None, **aggregates: Column
) -> DataFrame:
    """Groups with ``plays`` and further aggregates, ranked by a total order.

    Sort and limit become one TakeOrderedAndProject: each task keeps ``limit`` rows. With ``known``, the first key
    must be one of its ids.
    """
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("plays"), *[c.alias(n) for n, c in aggregates.items()])
    out = of_known(out, keys[0], known) if known is not None else out
    return out.orderBy(*order).limit(limit) if limit else out


def in_windows(plays: DataFrame, windows: DataFrame) -> DataFrame:
    """Plays inside any of the [start, end) windows; overlapping windows do not count a play twice.

    ``windows`` is a list that the caller wrote; it is small by nature and joined as a filter on the timestamp.
    """
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    return plays.join(F.broadcast(windows), inside, "left_semi")


def series(counts: DataFrame, spark, column: str, days: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """``counts`` on every key of the dense axis ``days`` (a short list), zero where nothing happened."""
    axis = spark.createDataFrame([(d,) for d in days], f"{column} string")
    joined = axis.join(counts, column, "left")
    return joined.select(column, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in fill])


def month_axis(first: datetime, last: datetime) -> list[str]:
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in months]


def day_axis(first: datetime, last: datetime, step: int = 1) -> list[str]:
    n = (last.date() - first.date()).days // step
    return [(first.date() + timedelta(days=step * i)).isoformat() for i in range(n + 1)]


def months_filled(plays: DataFrame, spark, first: datetime, last: datetime, distinct: str | None = None) -> DataFrame:
    """(month, plays[, distinct count]) for every month of [first's month, last's month]."""
    axis = month_axis(first, last)
    aggregates = [F.count(F.lit(1)).alias("plays")]
    if distinct:
        aggregates.append(F.countDistinct(F.when(present(distinct), F.col(distinct))).alias("different"))
    counts = plays.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(*aggregates)
    return series(counts, spark, "month", axis, ["plays"] + (["different"] if distinct else []))


def weeks_filled(plays: DataFrame, spark, now: datetime, weeks: int) -> DataFrame:
    """(week, plays) of the last weeks, each named by its Monday."""
    monday = now - timedelta(days=now.weekday())
    first = monday - timedelta(days=7 * (weeks - 1))
    counts = plays.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("plays"))
    return series(counts, spark, "week", day_axis(first, monday, 7), ["plays"])


def days_filled(plays: DataFrame, spark, now: datetime, days: int) -> DataFrame:
    first = now - timedelta(days=days - 1)
    counts = plays.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("plays"))
    return series(counts, spark, "day", day_axis(first, now), ["plays"])


def day_hour(plays: DataFrame, spark) -> DataFrame:
    """(dow, hour, plays): the dense 7 by 24 matrix, Sunday being 0."""
    cells = spark.createDataFrame([(d, h) for d in range(7) for h in range(24)], "dow int, hour int")
    counts = plays.groupBy((F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("plays"))
    return cells.join(counts, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("plays", F.lit(0)).alias("plays"))


def heatmap(plays: DataFrame, spark, today: datetime) -> DataFrame:
    """(day, plays, level) of the year up to ``today``, from a Monday on; levels by quartiles of non-zero days.

    A quartile is the value at place floor((n - 1) q) of the sorted non-zero days, at most 372 values.
    """
    first = today - timedelta(days=364)
    first -= timedelta(days=first.weekday())
    inside = between(plays, "ts", datetime(first.year, first.month, first.day), today + timedelta(days=1))
    counts = inside.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("plays"))
    filled = series(counts, spark, "day", day_axis(first, today), ["plays"])
    ordered = F.array_sort(F.collect_list(F.when(F.col("plays") > 0, F.col("plays")))).alias("v")
    at = lambda q: F.coalesce(F.get("v", F.floor((F.size("v") - 1) * q).cast("int")), F.lit(0))
    cuts = filled.agg(ordered).select(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    level = (
        F.when(F.col("plays") <= 0, 0)
        .when(F.col("plays") <= F.col("q1"), 1)
        .when(F.col("plays") <= F.col("q2"), 2)
        .when(F.col("plays") <= F.col("q3"), 3)
        .otherwise(4)
    )
    one = filled.withColumn("k", F.lit(1)).join(F.broadcast(cuts.withColumn("k", F.lit(1))), "k")
    return one.select("day", "plays", level.alias("level"))


def streaks(plays: DataFrame, entity: str) -> DataFrame:
    """(entity, start, end, days): runs of consecutive days with plays."""
    days = plays.select(entity, F.to_date("ts").alias("d")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(entity).orderBy("d")))
    return (
        days.withColumn("island", island)
        .groupBy(entity, "island")
        .agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).alias("days"))
        .drop("island")
    )


def streak_summary(plays: DataFrame, entity: str, today: datetime) -> DataFrame:
    """Longest run (the earliest of equals) and the current one, which ends today or yesterday."""
    runs = streaks(plays, entity)
    day = F.lit(today.date().isoformat()).cast("date")
    longest = F.max(F.struct("days", (-F.unix_date("start")).alias("early"), "start", "end"))
    current = F.max(F.when(F.col("end").between(F.date_sub(day, 1), day), F.col("days")))
    return runs.groupBy(entity).agg(longest.alias("l"), F.coalesce(current, F.lit(0)).alias("current")).select(
        entity,
        F.col("l.days").alias("longest"),
        F.date_format("l.start", "yyyy-MM-dd").alias("longest_start"),
        F.date_format("l.end", "yyyy-MM-dd").alias("longest_end"),
        "current",
    )


def kickstart(plays: DataFrame, item: str, limit: int) -> DataFrame:
    """Items by how often they were the first play of a day; plays of the same second all count.

    A grouped minimum joined back, so no day is ranked in one task.
    """
    day = plays.withColumn("day", F.to_date("ts"))
    first = day.groupBy("day").agg(F.min("ts").alias("ts"))
    hits = day.join(first, ["day", "ts"], "left_semi")
    return top(hits, [item], [F.col("plays").desc(), F.col("last").desc(), F.col(item)], limit, last=F.max("ts"))


def discovered(plays: DataFrame, item: str, since: datetime, limit: int, known: DataFrame | None = None) -> DataFrame:
    seen = plays.groupBy(item).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("plays"))
    return of_known(seen, item, known).where(F.col("first") >= moment(since)).orderBy(F.col("first").desc(), item).limit(limit)


def rediscovered(plays: DataFrame, item: str, window: datetime, silence: datetime, recent: datetime, limit: int, known: DataFrame | None = None) -> DataFrame:
    """Items heard before the silence, not during it, and again since ``recent``."""
    at = lambda lo, hi: F.count_if((F.col("ts") >= moment(lo)) & ((F.col("ts") < moment(hi)) if hi else F.lit(True)))
    g = plays.groupBy(item).agg(
        at(window, silence).alias("before"), at(silence, recent).alias("during"), at(recent, None).alias("again"), F.max("ts").alias("last")
    )
    kept = of_known(g, item, known).where((F.col("before") > 0) & (F.col("during") == 0) & (F.col("again") > 0))
    return kept.select(item, "before", "again", "last").orderBy(F.col("last").desc(), item).limit(limit)


def consistent(plays: DataFrame, item: str, limit: int, known: DataFrame | None = None) -> DataFrame:
    order = [F.col("days").desc(), F.col("plays").desc(), F.col(item)]
    return top(plays, [item], order, limit, known, days=F.countDistinct(F.to_date("ts")))


def forgotten(plays: DataFrame, entity: str, least: int, before: datetime, now: datetime, limit: int) -> DataFrame:
    """Entities with many plays and none since ``before``, by plays times days idle."""
    g = plays.where(present(entity)).groupBy(entity).agg(F.count(F.lit(1)).alias("plays"), F.max("ts").alias("last"))
    idle = F.floor(F.expr(f"timestampdiff(SECOND, last, TIMESTAMP_NTZ'{now:%Y-%m-%d %H:%M:%S}')") / 86400)
    kept = g.where((F.col("plays") >= least) & (F.col("last") < moment(before))).withColumn("idle_days", idle)
    return kept.orderBy((F.col("plays") * F.col("idle_days")).desc(), entity).limit(limit)


def hit_parade(plays: DataFrame, item: str, now: datetime, weeks: int = 52, per_week: int = 3, known: DataFrame | None = None) -> DataFrame:
    """(week, rank, item): the best of each trailing week, newest first, an item only where it first appears."""
    seconds = F.expr(f"timestampdiff(SECOND, ts, TIMESTAMP_NTZ'{now:%Y-%m-%d %H:%M:%S}')")
    week = F.ceil(seconds / (7 * 86400)).cast("int")
    inside = plays.where(F.col("ts") < moment(now)).withColumn("week", week).where(F.col("week").between(1, weeks))
    counts = inside.groupBy("week", item).agg(F.count(F.lit(1)).alias("plays"), F.max("ts").alias("last"))
    order = Window.partitionBy("week").orderBy(F.col("plays").desc(), F.col("last").desc(), F.col(item))
    best = of_known(counts, item, known).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_week)
    first = best.groupBy(item).agg(F.min(F.struct("week", "rank")).alias("at"))
    return first.select("at.week", "at.rank", item)


def anniversaries(plays: DataFrame, spark, item: str, now: datetime, years: int, per_year: int = 10, known: DataFrame | None = None) -> DataFrame:
    """(year_back, item, plays): the best of the 30 days that end at each anniversary; the nearest year wins."""
    rows = []
    for y in range(1, years + 1):
        end = now.replace(year=now.year - y)
        rows.append((y, end - timedelta(days=30), end))
    windows = spark.createDataFrame(rows, "year_back int, start timestamp_ntz, end timestamp_ntz")
    hit = plays.join(F.broadcast(windows), (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    counts = hit.groupBy("year_back", item).agg(F.count(F.lit(1)).alias("plays"), F.max("ts").alias("last"))
    order = Window.partitionBy("year_back").orderBy(F.col("plays").desc(), F.col("last").desc(), F.col(item))
    best = of_known(counts, item, known).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_year)
    return best.groupBy(item).agg(F.min_by(F.struct("year_back", "plays"), "year_back").alias("b")).select("b.year_back", item, "b.plays")


def coverage(local: DataFrame, library: DataFrame) -> DataFrame:
    """(month, local, library, gap, coverage) from two month series, merged in full."""
    both = local.withColumnRenamed("plays", "local").join(library.withColumnRenamed("plays", "library"), "month", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return gap_row(both.select("month", zero("local").alias("local"), zero("library").alias("library")))


def gap_row(df: DataFrame) -> DataFrame:
    share = F.when(F.col("local") > 0, F.least(F.lit(100), F.round(F.col("library") / F.col("local") * 100)))
    return df.withColumn("gap", F.greatest(F.lit(0), F.col("local") - F.col("library"))).withColumn(
        "coverage", F.coalesce(share, F.lit(100)).cast("int")
    )


def coverage_by_year(months: DataFrame) -> DataFrame:
    years = months.groupBy(F.substring("month", 1, 4).alias("year")).agg(
        F.sum("local").alias("local"), F.sum("library").alias("library")
    )
    return gap_row(years).where(F.col("gap") >= 1).orderBy(F.col("gap").desc(), F.col("year").desc()).limit(10)
