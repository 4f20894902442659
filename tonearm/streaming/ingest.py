"""The play log as a stream: deduplicated ingestion and daily counts with late data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.sync import PLAY_KEY
from tonearm.session import ensure_checkpoint_dir

#: Late arrivals that are still joined to their day; must exceed the overlap that every pull reads again.
LATENESS = "2 days"


def play_stream(spark: SparkSession, sf_dir: str, name: str = "scrobbles", time: str = "played_at") -> DataFrame:
    """File stream of one table with an event-time column ``at`` (zone-less UTC read as UTC)."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each play once, while its key is within the lateness: insert-or-ignore as a streaming operator."""
    return stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(PLAY_KEY)


def daily_counts(stream: DataFrame, entity: str, lateness: str = LATENESS) -> DataFrame:
    """(entity, day, plays) in tumbling days."""
    day = F.window("at", "1 day")
    return stream.withWatermark("at", lateness).groupBy(day.alias("w"), entity).agg(F.count(F.lit(1)).alias("plays")).select(
        entity, F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "plays"
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, for a stream's state and output."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what has arrived, append what it gives to a parquet table, and return that table.

    State and output stand in ``folder``, which every executor must reach; run again with the same folder, the stream
    goes on where it stopped and gives no row twice.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_totals(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Like ``run_to_table`` for totals that later rows still change: the newest total of every key.

    Each batch writes the totals that it changed under its own number, and writes them again under the same number if
    it is repeated after a failure.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode("update").trigger(availableNow=True)
    query.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{v}").alias(v) for v in values])
