"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

All of it is built-in functions.  The first pass counts byte lengths, after
map-side combination; lengths that occur twice become a bitmap of bounded size.
The second pass hashes the first characters of the rows whose length may occur
twice, and of no others, and counts (length, prefix hash) in the same way.  The
third hashes in full, and deals out by that hash, only rows whose length and
prefix may occur twice.  All other rows never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import maybe_in, stored

PREFIX_CHARS = 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; a text of ASCII alone takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, keep_row: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of docs, and the row itself as the struct ``row`` if keep_row.

    Texts are equal if identical after lower-casing A-Z; null is the empty text,
    so nulls and empty texts form one group.  The row with the largest id stays;
    null ids come before all others; of rows that repeat the id as well, one
    stays.  ``digest`` is the SHA-256 of the normalised text: of rows that reach
    the full hash only, or of all with digest_all.  Columns of docs are only
    touched inside ``row``, so no name can clash.  An empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("__text"),
        F.octet_length(text).alias("__length"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []),
    )
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    lengths = stored(twice(rows, "__length"), "lengths")
    rows = maybe_in(rows, F.col("__length"), lengths, "__same_length", lengths.count())
    rows = rows.withColumn("__key", F.when(F.col("__same_length"), F.xxhash64("__length", F.xxhash64(ascii_lower(F.substring("__text", 1, PREFIX_CHARS))))))
    alike = stored(twice(rows.where("__same_length"), "__length", "__key").select("__key"), "alike")
    tested = maybe_in(rows, F.col("__key"), alike, "__same_prefix", alike.count()).withColumn("__again", F.col("__same_length") & F.col("__same_prefix"))
    digest = F.sha2(ascii_lower(F.col("__text")), 256)
    last = ["row"] if keep_row else []
    alone = tested.where("NOT __again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), (digest if digest_all else F.lit(None).cast("string")).alias("digest"), *last
    )
    again = tested.where("__again").select("doc_id", digest.alias("digest"), *last)
    # Rows that repeat both text and id are numbered; every id of a group of copies is its own small window.
    again = again.withColumn("__nth", F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("doc_id")))
    sizes = tested.where("__again").select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sizes = stored(sizes, "sizes")  # a table, so that the join below may split a digest that holds many rows
    joined = again.join(sizes, "digest").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1)).alias("kept"), "digest", *last)
    return alone.unionByName(joined)
