"""References to records that do not exist.

Distinct non-null foreign keys are counted before any wide shuffle, anti-joined against the parent's keys, and
only the orphan keys go back to the child rows. The most frequent orphan keys (a fixed number, so a bounded
broadcast) are joined map-side; every other key then has at most ``rows / HOT_KEYS`` rows, so no reduce task can
be handed a hot key.

Defined cases: a NULL or empty reference is no reference; a NULL period column gives the period ``none``;
a NULL parent key matches nothing; repeated parent keys count once; repeated child rows each come out; an empty
child gives no rows; an empty parent makes every reference an orphan; other columns of either table are not
read, so they may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.session import durable
from tonearm.sources.tables import present, present_any, utc

#: Orphan keys joined by broadcast: the most frequent ones, never more than this many.
HOT_KEYS = 1000


def month_or_none(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit("none"))


def orphan_keys(child: DataFrame, ref: str, parent: DataFrame, key: str) -> DataFrame:
    """(ref_key, n_rows) of the references of ``child`` that equal no ``key`` of ``parent``."""
    kind = dict(child.dtypes)[ref]
    refs = (
        child.where(present_any(child, ref))
        .groupBy(F.col(f"`{ref}`").alias("ref_key"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    keys = parent.select(F.col(f"`{key}`").cast(kind).alias("parent_key")).where(F.col("parent_key").isNotNull())
    return refs.join(keys, refs.ref_key == keys.parent_key, "left_anti")


def orphan_rows(
    child: DataFrame, row_key: str, ref: str, period: Column, parent: DataFrame, key: str, table_name: str
) -> DataFrame:
    """(table_name, row_key, period, ref_key as text) of every child row with a dangling reference."""
    found = durable(orphan_keys(child, ref, parent, key))
    hot = found.orderBy(F.col("n_rows").desc(), F.col("ref_key")).limit(HOT_KEYS).select("ref_key")
    cold = found.select("ref_key").join(F.broadcast(hot), "ref_key", "left_anti")
    rows = child.where(present_any(child, ref)).select(
        F.lit(table_name).alias("table_name"),
        F.col(f"`{row_key}`").cast("string").alias("row_key"),
        period.alias("period"),
        F.col(f"`{ref}`").alias("ref_key"),
    )
    by_hot = rows.join(F.broadcast(hot), "ref_key", "left_semi")
    by_cold = rows.join(F.broadcast(hot), "ref_key", "left_anti").join(cold, "ref_key", "left_semi")
    columns = ["table_name", "row_key", "period", F.col("ref_key").cast("string").alias("ref_key")]
    return by_hot.select(*columns).unionByName(by_cold.select(*columns))


def orphan_report(rows: DataFrame) -> DataFrame:
    """(table_name, period, n_rows, n_keys) over the rows of ``orphan_rows``."""
    return rows.groupBy("table_name", "period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ref_key").alias("n_keys")
    )


def library_orphans(
    scrobble_sync: DataFrame,
    scrobbles: DataFrame,
    library_scrobbles: DataFrame,
    media_file: DataFrame,
    annotation: DataFrame,
    artist: DataFrame,
) -> DataFrame:
    """The dangling references of sync state, library plays and annotations.

    An annotation points to the table of its item_type; a row of any other item_type refers to no known table
    and does not come out.
    """
    submitted = utc("submission_time")
    parts = [
        orphan_rows(
            scrobble_sync, "id", "scrobble_id", month_or_none(F.col("attempted_at")), scrobbles, "id", "scrobble_sync"
        ),
        orphan_rows(
            library_scrobbles, "id", "media_file_id", month_or_none(submitted), media_file, "id", "library_scrobbles"
        ),
    ]
    for item_type, parent, key in (
        ("media_file", media_file, "id"),
        ("album", media_file.where(present("album_id")), "album_id"),
        ("artist", artist, "id"),
    ):
        own = annotation.where(F.col("item_type") == item_type)
        parts.append(orphan_rows(own, "ann_id", "item_id", month_or_none(F.col("play_date")), parent, key, "annotation"))
    return reduce(DataFrame.unionByName, parts)
