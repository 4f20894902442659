"""Copies of tables before they are written, and the checks and the tidying around them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession


def quick_check(spark: SparkSession, path: str, columns: list[str]) -> int:
    """The table's number of rows; an error if it cannot be read or lacks one of the columns."""
    df = spark.read.parquet(path)
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    return df.count()


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _copies(spark: SparkSession, target: str) -> list[str]:
    files, at = _folder(spark, target)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def backup(spark: SparkSession, path: str, target: str, label: str, now: datetime, keep: int | None = None) -> str:
    """A copy of the table under ``target``, named by label and time; it appears under its name only when it is whole.

    With ``keep``, only so many of the label's newest copies stay.
    """
    name = f"{label}-{now:%Y%m%dT%H%M%S}"
    spark.read.parquet(path).write.mode("overwrite").parquet(f"{target}/.{name}")
    files, whole = _folder(spark, f"{target}/{name}")
    if not files.rename(_folder(spark, f"{target}/.{name}")[1], whole):
        raise OSError(f"cannot rename the copy to {name}")
    if keep is not None:
        own = [n for n in _copies(spark, target) if n.startswith(f"{label}-")]
        for old in own[: max(len(own) - keep, 0)]:
            files.delete(_folder(spark, f"{target}/{old}")[1], True)
    return f"{target}/{name}"


def prune_older_than(spark: SparkSession, target: str, days: int, now: datetime) -> list[str]:
    """Deletes the copies older than ``days`` and tells their names; zero or less deletes none."""
    if days <= 0:
        return []
    limit = f"{now - timedelta(days=days):%Y%m%dT%H%M%S}"
    old = [n for n in _copies(spark, target) if not n.startswith(".") and n.rpartition("-")[2] < limit]
    for n in old:
        files, at = _folder(spark, f"{target}/{n}")
        files.delete(at, True)
    return old


def due(last: datetime | None, now: datetime, seconds: int = 600) -> bool:
    """Whether a long run has gone on for so long that it should be backed up in between."""
    return last is None or (now - last).total_seconds() >= seconds
