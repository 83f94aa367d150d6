"""The topic x year x venue cube and its shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import phrases as H
from trendloom.operators.labels import canonicalised
from trendloom.scratch import written


def from_rows(rows: DataFrame) -> DataFrame:
    """One row a paper and topic to counts."""
    return rows.groupBy("topic", "year", "venue").agg(F.count("*").alias("count"))


def topic_year_shares(cube: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """topic, year, count, n_venues, total, share; null topics, years or counts are left out.

    One shuffle by (topic, year) with map-side sums; a year's total is a sum of
    the few rows of partial totals, joined back, so that no year's topics meet in
    one task.
    """
    rows = cube.where("topic IS NOT NULL AND year IS NOT NULL AND count IS NOT NULL").withColumn("topic", X.strip(F.lower("topic")))
    if canonical is not None:
        rows = canonicalised(rows, canonical, "topic")
    annual = rows.groupBy("topic", "year").agg(F.sum("count").alias("count"), F.count_distinct(F.when(F.col("count") > 0, F.col("venue"))).alias("n_venues"))
    totals = rows.groupBy("year").agg(F.sum("count").alias("total"))
    # A row a year: bounded by the calendar.
    return annual.join(F.broadcast(totals), "year").select("topic", "year", "count", "n_venues", "total", F.try_divide("count", "total").alias("share"))


def wide(shares: DataFrame, years: list[int], measure: str = "share") -> DataFrame:
    """One row a topic with the measure (v), count (c) and venues (n) of each year; an absent year is 0."""
    at = lambda y, c: F.coalesce(F.max(F.when(F.col("year") == y, F.col(c))), F.lit(0))
    return shares.groupBy("topic").agg(*[at(y, measure).cast("double").alias(f"v{y}") for y in years], *[at(y, "count").alias(f"c{y}") for y in years], *[at(y, "n_venues").alias(f"n{y}") for y in years])


def title_cube(papers: DataFrame, cube: DataFrame, canonical: DataFrame, least_total: int = 10, most_words: int = 5) -> DataFrame:
    """topic, year, venue, count from titles: runs of words that are phrases of frequent topics, once a paper each.

    Phrases are canonical names and their surface forms.  Titles meet them by an
    automaton, so that only runs that are phrases leave a task; what then meets
    the topics is a row for each of these.
    """
    rows = canonicalised(cube.withColumn("topic", X.strip(F.lower("topic"))), canonical, "topic")
    kept = rows.groupBy("topic").agg(F.sum("count").alias("n")).where(F.col("n") >= least_total).select("topic")
    surface = canonical.select(F.col("surface").alias("phrase"), F.col("label").alias("topic")).join(kept, "topic", "left_semi")
    phrases = kept.select(F.col("topic").alias("phrase"), "topic").unionByName(surface).select(X.normalise_title(F.col("phrase")).alias("phrase"), "topic").where((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) <= most_words)).distinct()
    phrases = written(phrases, "topic-phrases")  # read twice, once to build the automaton
    found = H.matches(papers, X.normalise_title(F.col("title")), phrases.select("phrase"), ["conference", "year", "paper"], whole_words=True)
    return found.join(phrases, "phrase").select("paper", "year", F.col("conference").alias("venue"), "topic").distinct().groupBy("topic", "year", "venue").agg(F.count("*").alias("count"))


def papers_by(papers: DataFrame, *keys: str) -> DataFrame:
    return papers.groupBy(*keys).agg(F.count("*").alias("papers"))


def year_grid(counts: DataFrame, keys: list[str], years: list[int], value: str = "count") -> DataFrame:
    """One row a key with a zero-filled column y<year> for each year."""
    return counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("year") == y, F.col(value))), F.lit(0)).alias(f"y{y}") for y in years])


def _buckets(value: Column, bounds: Sequence[float]) -> Column:
    """The number of bounds that a value is above; nulls come first."""
    return sum(((value > b).cast("int") for b in bounds), F.lit(1)) if bounds else F.lit(1)


def numbered(df: DataFrame, order: str, bounds: Sequence[float], ties: Sequence[Column], name: str) -> DataFrame:
    """df with the place of each row, from 1 on, by ``order`` from the greatest down, then ``ties``.

    Rows are dealt out by ranges of the value, as ``bounds`` cut it, and numbered
    within; what comes before a range is a sum over a row a range.
    """
    rows = df.withColumn("__range", -F.when(F.col(order).isNull(), 0).otherwise(_buckets(F.col(order), bounds)))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    # At most len(bounds) + 2 rows.
    before = counts.select(F.col("__range").alias("__r"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(order), *ties))
    return rows.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__range", "__r", "__before", "__own")


def cuts(df: DataFrame, columns: Sequence[str], ranges: int = 64) -> dict[str, list[float]]:
    """Values that part each column into about equal ranges, within a hundredth; a fixed number of them, and none that occurs twice."""
    found = df.approxQuantile(list(columns), [k / ranges for k in range(1, ranges)], 0.01)
    return {c: sorted(set(q)) for c, q in zip(columns, found, strict=True)}


def rank_average(df: DataFrame, column: str, name: str, bounds: Sequence[float]) -> DataFrame:
    """df with ranks of the column, ties averaged, scaled to 0..1; 0 for a single row.

    Equal values are added up before they move, and only distinct values are
    ordered: within ranges of ``bounds``, each in a task of its own, while a row a
    range says how many values lie before it.  Then each row looks up its value.
    """
    counted = df.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__same")).withColumn("__range", F.when(F.col("__value").isNull(), 0).otherwise(_buckets(F.col("__value"), bounds)))
    ranges = counted.groupBy("__range").agg(F.sum("__same").alias("__n"))
    # At most len(bounds) + 2 rows.
    before = ranges.select(F.col("__range").alias("__r"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    within = F.sum("__same").over(Window.partitionBy("__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.withColumn("__within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), F.col("__range") == F.col("__r"))
    place = F.col("__before") + F.col("__within") + (F.col("__same") - 1) / F.lit(2.0)
    ranked = ranked.select("__value", F.coalesce(F.try_divide(place, (F.col("__all") - 1).cast("double")), F.lit(0.0)).alias(name))
    return df.join(ranked, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")
