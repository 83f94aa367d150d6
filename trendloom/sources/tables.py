"""Tables that are replaced in one step and know what they were made from.

A table is a folder of versions, each a Parquet folder of its own, and a small
document that names the present one.  A new version is written beside the
others; then the document is replaced by a rename, which a store does in one
step.  A reader therefore always finds a whole table, and a write that dies
leaves the former one.  The document also holds a fingerprint of the plan and of
the files that the version was made from.  One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

POINTER = "_present.json"


def _at(spark: SparkSession, path: str):
    """The store of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def replaced(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Writes the chunks, one after another, to a file beside path, and renames it over path in one step.

    Local files are renamed below the layer that keeps checksums in files of
    their own, whose renames take several steps.
    """
    folder, _, name = path.rpartition("/")
    beside = f"{folder}{'/' if folder or path.startswith('/') else ''}_{name}.{uuid.uuid4().hex}"
    (store, at), to = _at(spark, beside), _at(spark, path)[1]
    local = is_instance_of(spark.sparkContext._gateway, store, "org.apache.hadoop.fs.ChecksumFileSystem")
    if local:
        store.delete(store.getChecksumFile(to), False)
        store = store.getRawFileSystem()
    stream = store.create(at, False)
    try:
        for chunk in chunks:
            stream.write(bytearray(chunk))
        stream.close()
    except BaseException:
        stream.close()
        store.delete(at, False)
        raise
    if local:
        if not store.rename(at, to):
            raise OSError(f"{beside} could not be renamed")
        return
    fs = spark._jvm.org.apache.hadoop.fs
    over = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, to, how)


def present(spark: SparkSession, path: str) -> dict | None:
    """version and made_from of the table at path; None where there is none."""
    store, at = _at(spark, f"{path.rstrip('/')}/{POINTER}")
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The present version."""
    found = present(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{found['version']}")


def publish(df: DataFrame, path: str, made_from: str = "", keep: int = 1) -> DataFrame:
    """Writes df, which may read the table itself, as its next version, and returns that.

    The ``keep`` versions before it stay for those who still read them; older
    ones, and what writes that died have left, are removed.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    replaced(spark, f"{base}/{POINTER}", [json.dumps({"version": version, "made_from": made_from}).encode()])
    store, at = _at(spark, base)
    former = sorted(n for s in store.listStatus(at) if re.match(r"v\d{20}-", n := s.getPath().getName()) and n < version)
    for name in former[: max(0, len(former) - keep)]:
        store.delete(_at(spark, f"{base}/{name}")[1], True)
    return spark.read.parquet(f"{base}/{version}")


def fingerprint(df: DataFrame) -> str:
    """A digest of df's plan and of the path, length and time of each file that it reads.

    Rows that are held in memory are told apart by their columns only.
    """
    spark, digest = df.sparkSession, hashlib.sha256()
    # The numbers of columns and of functions' arguments differ each time a plan is made.
    names: dict[str, int] = {}
    plan = re.sub(r"#\d+L?|plan_id=\d+", "#", df._jdf.queryExecution().analyzed().toString())
    plan = re.sub(r"\blambda (\w+_\d+)#", lambda m: f"lambda {names.setdefault(m[1], len(names))}#", plan)
    digest.update(f"{plan}\n{df.schema.json()}".encode())
    for f in sorted(df.inputFiles()):
        store, at = _at(spark, f)
        s = store.getFileStatus(at)
        digest.update(f"\n{f} {s.getLen()} {s.getModificationTime()}".encode())
    return digest.hexdigest()


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, written anew where its plan or any file that it was made from has changed."""
    df = build()
    mark, found = fingerprint(df), present(spark, path)
    if found is not None and found["made_from"] == mark:
        return read(spark, path)
    return publish(df, path, mark)
