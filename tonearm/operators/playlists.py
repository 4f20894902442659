"""Playlists: definitions by slug, generated into (position, id) lists, and the sink they are kept in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import durable

#: A definition makes the ranked ids (position, id) of a playlist.
Definition = Callable[[], DataFrame]


@dataclass
class Run:
    """What became of one definition: ``action`` is dry-run, empty, replaced, created or error."""

    slug: str
    action: str
    tracks: DataFrame | None = None
    error: str | None = None


def ranked(rows: DataFrame, order: list, item: str = "media_file_id") -> DataFrame:
    """(position, id) of a short ranked list."""
    place = F.row_number().over(Window.orderBy(*order))
    return rows.select(place.alias("position"), F.col(item).alias("id"))


def shuffled(tracks: DataFrame, seed: int) -> DataFrame:
    """The list in a random order, the same for the same seed."""
    place = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    return tracks.select(place.alias("position"), "id")


def random_stars(annotation: DataFrame, tracks: DataFrame, limit: int, seed: int) -> DataFrame:
    """(position, id) of a random handful of starred tracks."""
    stars = annotation.where("item_type = 'media_file' AND starred").select(F.col("item_id").alias("id")).distinct()
    drawn = stars.join(tracks.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit)
    return shuffled(drawn, seed)


def enabled(slug: str, settings: dict[str, str]) -> bool:
    """A definition is on unless a setting says otherwise."""
    return settings.get(f"playlist.{slug}.enabled", "1") not in ("0", "false", "")


def generate(
    definitions: dict[str, Definition], existing: DataFrame, slug: str | None = None, dry_run: bool = False, settings: dict[str, str] | None = None
) -> list[Run]:
    """Runs every enabled definition, or the named one whatever its setting; one that fails does not stop the others.

    ``existing`` is (name, position, id). An empty result leaves an existing playlist as it is.
    """
    if slug is not None and slug not in definitions:
        raise ValueError(f"no playlist {slug!r}")
    wanted = [slug] if slug is not None else [s for s in definitions if enabled(s, settings or {})]
    held = {r[0] for r in existing.select("name").distinct().where(F.col("name").isin(wanted)).collect()}
    runs = []
    for s in wanted:
        try:
            tracks = durable(definitions[s]())
            if dry_run:
                runs.append(Run(s, "dry-run", tracks))
            elif tracks.isEmpty():
                runs.append(Run(s, "empty"))
            else:
                runs.append(Run(s, "replaced" if s in held else "created", tracks))
        except Exception as gone:  # noqa: BLE001 - whatever a definition raises is its own result
            runs.append(Run(s, "error", error=str(gone)))
    return runs


def kept(existing: DataFrame, runs: list[Run]) -> DataFrame:
    """(name, position, id) of all playlists after the runs that wrote one."""
    written = [r for r in runs if r.action in ("replaced", "created")]
    out = existing.where(~F.col("name").isin([r.slug for r in written])) if written else existing
    for r in written:
        out = out.unionByName(r.tracks.select(F.lit(r.slug).alias("name"), "position", "id"))
    return out


def mix_of_week(seeds: DataFrame, similar: DataFrame, plays: DataFrame, tracks: DataFrame, limit: int, most_plays: int = 5) -> DataFrame:
    """(position, id): half most played tracks of late, half hardly played ones that are near several of them.

    ``seeds`` is the ranked (position, id), ``similar`` (query, near, distance), ``plays`` (id, n). Tracks that the
    library does not hold fall out of both halves.
    """
    near = similar.join(seeds.select(F.col("id").alias("query")), "query", "left_semi")
    grouped = near.groupBy(F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.min("distance").alias("distance"))
    fresh = grouped.join(seeds.select("id"), "id", "left_anti").join(plays, "id", "left")
    fresh = fresh.where(F.coalesce("n", F.lit(0)) <= most_plays)
    half = -(-limit // 2)
    found = fresh.orderBy(F.col("hits").desc(), "distance", "id").limit(half)
    found = ranked(found, [F.col("hits").desc(), "distance", "id"], "id").withColumn("part", F.lit(1))
    both = seeds.where(F.col("position") <= limit - half).select("position", "id", F.lit(0).alias("part")).unionByName(found)
    return ranked(both.join(tracks.select("id"), "id", "left_semi"), ["part", "position"], "id")
