"""Series behind charts, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.cube import papers_by, year_grid
from trendloom.operators.labels import top_labels

YEARS = list(range(2017, 2026))


def venue_shares(papers: DataFrame) -> DataFrame:
    counts = papers_by(papers, "conference")
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("papers").alias("total")))).select("conference", "papers", F.try_divide("papers", "total").alias("share"))


def share_of(papers: DataFrame, venue: str, year: int) -> DataFrame:
    """One row: a venue's papers in a year, all others', and the share; null without papers."""
    one = papers.where(F.col("year") == year).agg(F.count_if(F.col("conference") == venue).alias("papers"), F.count_if(F.coalesce(F.col("conference") != venue, F.lit(True))).alias("others"))
    return one.withColumn("share", F.expr("try_divide(papers, papers + others)"))


def year_list(papers: DataFrame, first: int = 2017, last: int = 2025) -> DataFrame:
    """The years within the range that have papers, in order."""
    return papers.where(F.col("year").between(first, last)).select("year").distinct().orderBy("year")


def label_years(mentions: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A zero-filled row of years for each of the labels (a report's list, bounded by its length)."""
    keys = [*by, "k"]
    kept = mentions.join(F.broadcast(labels.select(*keys)), keys, "left_semi")
    return year_grid(kept.groupBy(*keys, "year").agg(F.count("*").alias("count")), keys, YEARS)


def top_by_year(mentions: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    return label_years(mentions, top_labels(mentions, n, list(by) or None), by)


def matching(mentions: DataFrame, test: Column) -> DataFrame:
    """year, mentions: of labels that pass, zero for years with other labels only."""
    return mentions.groupBy("year").agg(F.count_if(test).alias("mentions"))


def any_of(patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("k").contains(p)
    return out


def first_and_last(mentions: DataFrame, first: int, last: int) -> DataFrame:
    """conference, k and its counts in the two years, for labels that either has."""
    two = mentions.where(F.col("year").isin(first, last)).groupBy("conference", "k")
    return two.agg(F.count_if(F.col("year") == first).alias("first_count"), F.count_if(F.col("year") == last).alias("last_count"))


def classified(mentions: DataFrame, classes: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """class, mentions: the first class with a pattern that the label contains; others are left out."""
    case = None
    for name, patterns in classes:
        case = F.when(any_of(patterns), name) if case is None else case.when(any_of(patterns), name)
    return mentions.select(case.alias("class")).where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("mentions"))


def highlighted(mentions: DataFrame, n: int, test: Column) -> DataFrame:
    return top_labels(mentions, n).withColumn("highlight", test)


def consolidation(mentions: DataFrame, papers: DataFrame, n: int) -> DataFrame:
    """year, mentions of the n most frequent labels, papers, and their ratio."""
    top = top_labels(mentions, n)
    hits = mentions.join(F.broadcast(top.select("k")), "k", "left_semi").groupBy("year").agg(F.count("*").alias("mentions"))
    return papers_by(papers, "year").join(hits, "year", "left").select("year", F.coalesce("mentions", F.lit(0)).alias("mentions"), "papers", F.try_divide(F.coalesce("mentions", F.lit(0)), "papers").alias("ratio"))


def word_frequencies(mentions: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    return top_labels(mentions.where(F.length("k") > 1), n, list(by) or None)


def growth(papers: DataFrame) -> DataFrame:
    """year, papers, the year before and the change; absent years count as none."""
    counts = papers_by(papers, "year")
    # A row a year.
    return counts.withColumn("before", F.coalesce(F.sum("papers").over(Window.orderBy("year").rangeBetween(-1, -1)), F.lit(0)))


def figure_document(series: DataFrame, key: str = "k") -> DataFrame:
    """One JSON document {label: [count of each year]} of a bounded series."""
    years = F.array(*[F.col(f"y{y}") for y in YEARS])
    return series.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), years.alias("v")))))).alias("document"))


def published_figures(papers: DataFrame, mentions: DataFrame, venues: Sequence[str], phrases: Sequence[tuple[str, str, str | None]], labels: Sequence[str], totals_of: tuple[str, Sequence[str]], top: int = 15, per_venue: int = 12) -> DataFrame:
    """One row: the JSON document of all published series, by year from 2017 to 2025.

    phrases are (name, part of a label, venue or None), labels exact labels, and
    totals_of a venue with labels whose mentions are counted over all years.  Every
    part is a table of some dozens of rows before it is put into the document.
    """
    zero = F.array(*[F.lit(0).cast("long")] * len(YEARS))
    counts = lambda df, test=F.lit(True): df.agg(F.array(*[F.count_if(test & (F.col("year") == y)) for y in YEARS]).alias("v"))

    def listed(found: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
        """A map of all that is wanted, zeros for what is not found."""
        return found.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("v")))).alias("m")).select(F.map_from_arrays(F.array(*[F.lit(w) for w in wanted]), F.array(*[F.coalesce(F.try_element_at("m", F.lit(w)), zero) for w in wanted])).alias("v"))

    every = F.array(*[F.coalesce(F.sum((F.col("year") == y).cast("long")), F.lit(0)) for y in YEARS]).alias("v")
    parts = {"papers_per_year": counts(papers)}
    parts["papers_per_year_by_venue"] = listed(papers.where(F.col("conference").isin(*venues)).groupBy("conference").agg(every), "conference", venues)
    for name, part, venue in phrases:
        test = F.col("k").contains(part)
        parts[name] = counts(mentions, test if venue is None else test & (F.col("conference") == venue))
    parts["labels"] = listed(mentions.where(F.col("k").isin(*labels)).groupBy("k").agg(every), "k", labels)
    grid = top_by_year(mentions, top).select("k", F.array(*[F.col(f"y{y}") for y in YEARS]).alias("v"))
    parts["top_labels"] = grid.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("v"))
    venue, names = totals_of
    own = mentions.where(F.col("conference") == venue).agg(*[F.count_if(F.col("k") == n).alias(f"n{i}") for i, n in enumerate(names)])
    parts["totals"] = own.select(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"n{i}") for i in range(len(names))])).alias("v"))
    tops = top_labels(mentions.where(F.col("conference").isin(*venues)), per_venue, ["conference"])
    each = tops.groupBy("conference").agg(F.array_sort(F.collect_list(F.struct("rank", "k", "count"))).alias("v"))
    entries = lambda c: F.struct(c["conference"], F.map_from_entries(F.transform(c["v"], lambda x: F.struct(x["k"], x["count"]))))
    parts["top_per_venue"] = each.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("conference", "v"))), entries)).alias("v"))
    out = None
    for name, part in parts.items():
        one = part.select(F.col("v").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.select(F.to_json(F.struct(F.array(*[F.lit(y) for y in YEARS]).alias("years"), *parts)).alias("document"))
