"""Snapshots of statistics: sections computed together, kept as one row per key, read back or computed when missing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, section string, payload string, computed_at timestamp_ntz"


def section(name: str, rows: DataFrame, order: list | None = None) -> DataFrame:
    """(section, payload): one section as a JSON list. Sections are short: counts, top lists and axes with a bound."""
    listed = F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))) if order is None else None
    if order is not None:
        from pyspark.sql import Window

        placed = rows.select(F.row_number().over(Window.orderBy(*order)).alias("_k"), F.struct(*rows.columns).alias("_r"))
        sorted_rows = F.array_sort(F.collect_list(F.struct("_k", "_r")))
        return placed.agg(F.to_json(F.transform(sorted_rows, lambda x: x["_r"])).alias("payload")).select(F.lit(name).alias("section"), "payload")
    return rows.agg(listed.alias("payload")).select(F.lit(name).alias("section"), "payload")


def compute(key: str, sections: dict[str, DataFrame], now: datetime, orders: dict[str, list] | None = None) -> DataFrame:
    """(key, section, payload, computed_at) of all sections."""
    out = None
    for name, rows in sections.items():
        one = section(name, rows, (orders or {}).get(name))
        out = one if out is None else out.unionByName(one)
    at = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz").alias("computed_at")
    return out.select(F.lit(key).alias("key"), "section", "payload", at)


def store(snapshots: DataFrame, fresh: DataFrame) -> DataFrame:
    """The snapshots with those of the fresh keys replaced."""
    return snapshots.join(fresh.select("key").distinct(), "key", "left_anti").unionByName(fresh)


def get(snapshots: DataFrame, key: str, otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The sections of a key, computed where there are none and a way to do it is given."""
    own = snapshots.where(F.col("key") == key)
    return otherwise() if otherwise is not None and own.isEmpty() else own


def top_list(snapshots: DataFrame, key: str, name: str, live: Callable[[], DataFrame], filtered: bool) -> DataFrame:
    """A top list: live if it is filtered or no snapshot holds it, else the rows of the snapshot."""
    held = snapshots.where((F.col("key") == key) & (F.col("section") == name))
    if filtered or held.isEmpty():
        return live()
    rows = live()
    return held.select(F.explode(F.from_json("payload", f"array<{rows.schema.simpleString()}>")).alias("r")).select("r.*")


def record_day(history: DataFrame, day: str, counts: DataFrame) -> DataFrame:
    """The daily history (day date, ...) with the day's row added or replaced."""
    row = counts.select(F.lit(day).cast("date").alias("day"), *[c for c in history.columns if c != "day"])
    return history.where(F.col("day") != F.lit(day).cast("date")).unionByName(row)


def put(settings: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) settings with one set."""
    row = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.where(F.col("key") != key).unionByName(row)


def setting(settings: DataFrame, key: str, default: str = "") -> str:
    row = settings.where(F.col("key") == key).select("value").first()
    return default if row is None else row[0]


def started(kind: str, reference: str, label: str, at: datetime) -> dict:
    return {"type": kind, "reference": reference, "label": label, "started_at": at, "status": "running"}


def recorded(spark, kind: str, reference: str, label: str, clock: Callable[[], datetime], action: Callable[[], dict]) -> DataFrame:
    """One row of the run log: the action's status, how long it took and the numbers that it returns, as JSON.

    An action that raises is logged as an error and does not raise here.
    """
    import json

    begun = clock()
    row = started(kind, reference, label, begun)
    try:
        row |= {"status": "success", "metrics": json.dumps(action(), sort_keys=True), "message": None}
    except Exception as gone:  # noqa: BLE001 - the log is where it is told
        row |= {"status": "error", "metrics": None, "message": str(gone)}
    row["duration_ms"] = int((clock() - begun).total_seconds() * 1000)
    schema = "type string, reference string, label string, started_at timestamp_ntz, status string, metrics string, message string, duration_ms long"
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], schema)


def without_older(runs: DataFrame, column: str, cutoff: datetime) -> DataFrame:
    """The run log without rows that began before the cutoff."""
    at = F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return runs.where(F.col(column).isNull() | (F.col(column) >= at))
