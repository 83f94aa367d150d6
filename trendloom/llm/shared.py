"""What the operators of this subpackage share: tables in the cluster's folder, bitmaps, components."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET_BITS = 32768  # fixed value: bits in one bitmap of bitmap_construct_agg


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all run on one machine."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="trendloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here.

    Unlike a local checkpoint, the rows survive the loss of any executor.  The
    table is removed by ``released``, or else when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trendloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes stored tables that no plan still to be run reads."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bounds what a Python worker holds of a table with long texts: rows and bytes of a batch, whichever comes first.

    Spark reads these settings when a plan runs, so they stay with the session;
    smaller ones that are set already are kept.
    """
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str, rows: int, bits_a_key: int = 32, most_bits: int = 1 << 26) -> DataFrame:
    """Adds the boolean column ``name``: false only where ``key`` is surely not in the one column of ``keys``.

    A one-hash Bloom filter of ``bits_a_key`` bits for each of ``rows`` keys, at
    most ``most_bits`` (8 MB): that bound is why it may be broadcast.  Full or
    not, it only lets more rows through; callers check those exactly.
    """
    bits = min(most_bits, max(_BUCKET_BITS, 1 << math.ceil(math.log2(max(1, rows * bits_a_key)))))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = (
        keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits)).alias("__bit"))
        .groupBy(F.expr("bitmap_bucket_number(__bit)").alias("__bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__bit))").alias("__map"))
    )
    byte = F.expr("conv(hex(substring(__map, CAST(bitmap_bit_position(__place) DIV 8 + 1 AS INT), 1)), 16, 10)").cast("int")
    hit = F.coalesce(F.expr("shiftright({0}, CAST(bitmap_bit_position(__place) % 8 AS INT))".format("__byte")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return (
        df.withColumn("__place", place)
        .withColumn("__at", F.expr("bitmap_bucket_number(__place)"))
        .join(F.broadcast(maps), F.col("__at") == F.col("__bucket"), "left")
        .withColumn("__byte", byte)
        .withColumn(name, hit)
        .drop("__place", "__at", "__bucket", "__map", "__byte")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node of its component.

    Alternates large-star and small-star steps, each written to the shared
    folder, until no edge changes; O(log^2 n) rounds.  No node, edge or component
    list is brought to the driver, only a count and a checksum a round.  Least
    neighbours are combined before the shuffle.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least_of(s: DataFrame, own: bool) -> DataFrame:
        """Each node's least neighbour, or itself if that is less; a table, so that the join with it may split a node of very many edges."""
        found = s.groupBy("a").agg(F.min("b").alias("m"))
        return stored(found.select("a", F.least("a", "m").alias("m")) if own else found, "least")

    def starred(e: DataFrame) -> DataFrame:
        """A large-star and a small-star step."""
        s = both(e)
        first = least_of(s, True)
        moved = s.where("b > a").join(first, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        wide = stored(moved.distinct(), "edges")
        second = least_of(wide, False)
        moved = wide.join(second, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        out = stored(moved.union(second.select("a", F.col("m").alias("b"))).distinct(), "edges")
        released(first, wide, second)
        return out

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % (1 << 30)).cast("long"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = sign(now)
    while before[0]:
        last, now = now, starred(now)
        released(last)
        after = sign(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
