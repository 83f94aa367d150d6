"""Cubes kept up to date from a stream of events; an addition, batch has no counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.operators.cube import from_rows
from trendloom.sources import tables

COUNTS = "topic string, year int, venue string, count long"


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", topic: str = "event_type") -> DataFrame:
    """Counts by window and topic; events later than ``late`` are left out by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", window), F.col(topic).alias("topic")).agg(F.count("*").alias("count")).select("topic", F.col("window.start").alias("start"), "count")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("topic", "year", "venue").agg(F.sum("count").alias("count"))


def _recent(spark: SparkSession, path: str, after: int) -> dict[int, str]:
    """Folders of the batches after that number that were written to their end."""
    store, at = tables._at(spark, f"{path}/recent")
    found = {}
    if store.exists(at):
        for s in store.listStatus(at):
            name = s.getPath().getName()
            if name.isdigit() and int(name) > after and store.exists(tables._at(spark, f"{path}/recent/{name}/_SUCCESS")[1]):
                found[int(name)] = f"{path}/recent/{name}"
    return found


def _merged(spark: SparkSession, path: str) -> int:
    """Number of the last batch that the table holds."""
    state = tables.present(spark, path)
    return int(state["made_from"]) if state else -1


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The cube as of the last batch that ended: the table, and the batches since."""
    path = path.rstrip("/")
    done = _merged(spark, path)
    parts = spark.createDataFrame([], COUNTS) if done < 0 else tables.read(spark, path)
    recent = list(_recent(spark, path, done).values())
    return _summed(parts.unionByName(spark.read.schema(COUNTS).parquet(*recent)) if recent else parts)


def upsert(batch: DataFrame, number: int, path: str, every: int = 16) -> None:
    """Adds the rows (topic, year, venue) of a batch to the cube at path, once, however often the batch comes.

    A batch's counts go to a folder of its number, which a repeated one writes
    anew.  After ``every`` batches these are merged into the table, which names the
    last one it holds, in the same step in which it is replaced; batches up to
    that number are passed over.  Late rows count like others.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    done = _merged(spark, path)
    if number <= done:
        return
    from_rows(batch).write.mode("overwrite").parquet(f"{path}/recent/{number}")
    if number - done >= every:
        old = _recent(spark, path, -1)
        tables.publish(read_kept(spark, path), path, str(number))
        for k, folder in old.items():
            store, at = tables._at(spark, folder)
            if k <= number:
                store.delete(at, True)


def keep_cube(rows: DataFrame, path: str, checkpoint: str, every: int = 16, **trigger: bool | str) -> StreamingQuery:
    """Starts the stream that keeps the cube at path; ``rows`` has topic, year and venue.  Restarts go on from the checkpoint."""
    stream = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: upsert(batch, number, path, every))
    return (stream.trigger(**trigger) if trigger else stream).start()
