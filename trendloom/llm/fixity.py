"""Merkle fixity audit of WARC replicas.

A manifest lists records: file, offset, length, content.  Each record is hashed;
within a file, records fall into leaves by ranges of their offset, ``fan_out``
leaves or nodes make a node, up to the file's root; files, by ranges of their
number, make the tree's upper part.  Two replicas are compared from the root
down: only children of nodes that differ are looked at, so sound branches cost
one comparison at their top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import stored

LEAF_BYTES = 1 << 16
FAN_OUT = 16
NO_ID_FILES = 1 << 16  # of rows without an id; numbered downwards from -1


def _laid_out(pages: DataFrame, records_a_file: int, id_col: str, url_col: str, html_col: str, replica: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The columns of a manifest and each record's hash, made before rows move: without content, no text is shuffled.

    With replica, which makes another replica's bytes of a record's content and
    number, also the hash of these as ``replica``.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    record = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    content = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")
    )
    rows = pages.select(F.col(id_col).isNull().alias("none"), record.alias("record"), content.alias("content"))
    rows = rows.withColumn("length", F.octet_length("content").cast("long")).withColumn("hash", F.sha2("content", 256))
    more = ["replica"] if replica else []
    if replica:
        rows = rows.withColumn("replica", F.sha2(replica(F.col("content"), F.col("record")), 256))
    # Rows without an id are spread over files of their own by hash, so that no file holds them all.
    rows = rows.withColumn("file", F.when(F.col("none"), -1 - F.pmod(F.xxhash64("hash"), F.lit(NO_ID_FILES))).otherwise(F.floor(F.col("record") / records_a_file)).cast("long"))
    before = Window.partitionBy("file").orderBy("record", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "record", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "content", "hash", *more)


def manifest(pages: DataFrame, records_a_file: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """file, record, offset, length, content of every row of pages, laid out as WARC response records.

    File = record div records_a_file; rows with a null id have record -1 and one of
    ``NO_ID_FILES`` files from -1 downwards, by hash; rows that repeat an id follow
    each other by the hash of their content.  The content is a WARC header with
    the target URI and the page's bytes; nulls are empty.  Offsets
    need all records of a file only, a bounded group for ids that do not repeat.
    """
    return _laid_out(pages, records_a_file, id_col, url_col, html_col).drop("hash")


def page_hashes(pages: DataFrame, records_a_file: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", replica: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``record_hashes`` of the manifest of pages, stored: the audit's passes read hashes, not pages.

    replica (content, record) tells the bytes that another replica holds in a
    record's place; their hash is the column ``replica``.
    """
    rows = _laid_out(pages, records_a_file, id_col, url_col, html_col, replica)
    return stored(rows.select("file", "record", "offset", "hash", *(["replica"] if replica else [])), "record-hashes")


def record_hashes(records: DataFrame) -> DataFrame:
    """file, record, offset and SHA-256 of each record of a manifest."""
    return records.select("file", "record", "offset", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def heights(replicas: list[DataFrame], leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> tuple[int, int]:
    """Levels above the leaves within files, and above files, that hold the largest of all replicas."""
    most = [r.agg(F.max(F.floor(F.col("offset") / leaf_bytes)), F.max(F.abs("file"))).first() for r in replicas]
    out = []
    for k in (0, 1):
        n, high = 0, max((int(m[k]) for m in most if m[k] is not None), default=0)
        while high > 0:
            n, high = n + 1, high // fan_out
        out.append(n)
    return out[0], out[1]


def tree(hashes: DataFrame, height: tuple[int, int], leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels from the leaves up, each stored: file, node, hash, and the parent's up_file, up_node.

    A node hashes its children's numbers and hashes in order, at most ``fan_out``
    (a leaf: its records' offsets, numbers and hashes).  Each level shuffles only
    what the level below has left, a ``fan_out``-th of it.
    """

    def level(below: DataFrame, keys: list[Column], part: Column, kind: str, up: list[Column]) -> DataFrame:
        made = below.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))
        made = made.select("file", "node", F.sha2(F.concat(F.lit(kind), F.array_join("parts", ",")), 256).alias("hash"))
        return stored(made.select("*", up[0].cast("long").alias("up_file"), up[1].cast("long").alias("up_node")), kind)

    above = lambda c: F.floor(F.col(c) / fan_out).cast("long")
    zero = F.lit(0).cast("long")
    inner, outer = [F.col("file"), above("node")], [zero, above("file")]
    record = F.concat_ws(":", F.format_string("%020d", "offset"), F.col("record").cast("string"), F.col("hash"))
    child = F.concat_ws(":", F.format_string("%020d", "node"), F.col("hash"))
    leaf = F.floor(F.col("offset") / leaf_bytes).cast("long").alias("node")
    levels = [level(hashes, [F.col("file"), leaf], record, "leaf", inner if height[0] else outer)]
    for k in range(height[0]):
        levels.append(level(levels[-1], [F.col("file"), above("node").alias("node")], child, "node", inner if k + 1 < height[0] else outer))
    by_file = levels[-1].select("file", F.col("file").alias("node"), "hash")
    for _ in range(height[1]):
        levels.append(level(by_file, [zero.alias("file"), above("node").alias("node")], child, "files", [zero, above("node")]))
        by_file = levels[-1]
    return levels


def audit(master: DataFrame, replica: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """file, record, offset, damage ('changed', 'missing', 'extra') of each record in which the replica differs.

    Both are tables of record hashes.  From the highest level down, children of
    the nodes that differ are compared; at the bottom, the records of differing
    leaves.  Records that repeat (file, record, offset) are held against each
    other as sets of hashes.  Equal replicas, empty ones too, give no row.
    """
    height = heights([master, replica], leaf_bytes, fan_out)
    wanted: DataFrame | None = None
    for x, y in reversed(list(zip(tree(master, height, leaf_bytes, fan_out), tree(replica, height, leaf_bytes, fan_out), strict=True))):
        if wanted is not None:
            x, y = (t.join(wanted, ["up_file", "up_node"], "left_semi") for t in (x, y))
        left, right = x.select("file", "node", F.col("hash").alias("__a")), y.select("file", "node", F.col("hash").alias("__b"))
        unlike = left.join(right, ["file", "node"], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
        wanted = stored(unlike.select(F.col("file").alias("up_file"), F.col("node").alias("up_node")), "unlike")
    found = []
    for t in (master, replica):
        own = t.withColumn("up_file", F.col("file")).withColumn("up_node", F.floor(F.col("offset") / leaf_bytes).cast("long"))
        own = own.join(wanted, ["up_file", "up_node"], "left_semi")
        found.append(own.groupBy("file", "record", "offset").agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("hash")))
    a, b = found[0].withColumnRenamed("hash", "__a"), found[1].withColumnRenamed("hash", "__b")
    damage = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("changed")
    return a.join(b, ["file", "record", "offset"], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("file", "record", "offset", damage.alias("damage"))
