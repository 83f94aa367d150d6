"""Session settings that results depend on."""

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings stay otherwise."""
    builder = SparkSession.builder.appName("trendloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bounds what a Python worker holds of a table with long texts: rows and bytes of a batch, whichever comes first.

    Spark reads these settings when a plan runs, so they stay with the session;
    smaller ones that are set already are kept.
    """
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
