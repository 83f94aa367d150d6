"""Papers to label mentions: track filter, tokenisers, canonical names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text as X


@dataclass(frozen=True)
class Tokeniser:
    """How a keyword cell is split: separators, collapsing of inner space, one mention a paper, junk left out."""

    split: str
    collapse: bool = False
    once: bool = False
    junk_free: bool = False


TOKENISERS = {
    "t1": Tokeniser(r"\s*[;,]\s*", collapse=True),
    "t2": Tokeniser("[;,]"),
    "t3": Tokeniser("[;,]"),
    "t4": Tokeniser(r";\s*", once=True),
    "t5": Tokeniser(r";\s*", once=True, junk_free=True),
}


def main_track(papers: DataFrame, strip: bool = True) -> DataFrame:
    """Papers of the main track; without the column all are."""
    if "paper_type" not in papers.columns:
        return papers
    kind = F.lower(X.strip(F.col("paper_type")) if strip else F.col("paper_type"))
    return papers.where(kind == "main")


def labelled(papers: DataFrame) -> DataFrame:
    """Papers with keywords that are not the 'Topic: ... Methods: ...' form."""
    return papers.where(F.col("keywords").isNotNull() & ~X.strip(F.col("keywords")).startswith("Topic:"))


def tokens(cell: Column, mode: Tokeniser) -> Column:
    one = (lambda k: X.normalise_keyword(k)) if mode.collapse else (lambda k: X.strip(F.lower(k)))
    return F.filter(F.transform(F.split(cell, mode.split, -1), one), lambda k: k != "")


def mentions(papers: DataFrame, mode: str, canonical: DataFrame | None = None) -> DataFrame:
    """conference, year, title, k: a row for each label of each paper.

    ``canonical`` (surface, label) is a dictionary.  In the modes with once,
    mentions are distinct.
    """
    how = TOKENISERS[mode]
    out = papers.select("conference", "year", "title", F.explode(tokens(F.col("keywords"), how)).alias("k"))
    if how.junk_free:
        out = out.where(~X.is_junk(F.col("k")))
    if canonical is not None:
        out = canonicalised(out, canonical, "k")
    return out.dropDuplicates(["conference", "year", "title", "k"]) if how.once else out


def canonicalised(df: DataFrame, canonical: DataFrame, column: str) -> DataFrame:
    """``column`` mapped by canonical (surface, label); values that it does not list stay.

    The dictionary's size decides how it is joined: the planner broadcasts a small one.
    """
    names = canonical.select(F.col("surface").alias("__surface"), F.col("label").alias("__label")).dropDuplicates(["__surface"])
    return df.join(names, F.col(column) == F.col("__surface"), "left").withColumn(column, F.coalesce("__label", column)).drop("__surface", "__label")


def top_labels(found: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n most frequent labels, ties by name, of all mentions or within each group."""
    from pyspark.sql import Window

    counts = found.groupBy(*(by or []), "k").agg(F.count("*").alias("count"))
    if not by:
        return counts.orderBy(F.desc("count"), "k").limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "k"))
    return counts.withColumn("rank", place).where(F.col("rank") <= n)
