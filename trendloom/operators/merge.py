"""Union of sources with precedence, and appending what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.schema import PAPER_COLUMNS


def aligned(df: DataFrame, columns: list[str] = PAPER_COLUMNS) -> DataFrame:
    """The stated columns in order; those that are absent are empty."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def kept_in_order(df: DataFrame, order: list[str] = PAPER_COLUMNS) -> DataFrame:
    """Of the stated columns those that df has, in the stated order."""
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns])


def with_defaults(df: DataFrame, **defaults: str) -> DataFrame:
    """df with the columns that it lacks at their defaults."""
    return df.select("*", *[F.lit(v).alias(c) for c, v in defaults.items() if c not in df.columns])


def merge_papers(sources: list[DataFrame], keys: tuple[str, ...] = ("conference", "year", "title"), order: str = "title") -> DataFrame:
    """Rows of all sources, one a key: of the first source that has it, then by ``order``, then by a hash of the row.

    Rows of a key are combined before the shuffle, so a key that very many rows
    have is no burden.
    """
    columns = list(dict.fromkeys(c for s in sources for c in s.columns))
    rows = None
    for k, s in enumerate(sources):
        part = aligned(s, columns).withColumn("__source", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.groupBy(*keys).agg(F.min_by(row, F.struct("__source", order, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))).alias("__row")).select("__row.*")


def append_missing(base: DataFrame, more: DataFrame, prefix: int = 100) -> DataFrame:
    """base, and the rows of more whose (conference, year, start of the title) base lacks, one a key; nulls are equal to nulls."""
    key = {"__c": F.col("conference"), "__y": F.col("year"), "__k": F.lower(F.substring("title", 1, prefix))}
    have = base.select(*[v.alias(k) for k, v in key.items()]).distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    new = more.withColumn("__key", key["__k"]).join(have, same("conference", "__c") & same("year", "__y") & same("__key", "__k"), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in more.columns])
    new = new.groupBy("conference", "year", "__key").agg(F.min_by(row, F.struct("title", F.xxhash64(*[F.col(f"`{c}`") for c in more.columns]))).alias("__row")).select("__row.*")
    return base.unionByName(new)
