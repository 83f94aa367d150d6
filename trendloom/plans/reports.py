"""Whole analyses as one lazy plan each, on the derived tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.operators import cube as C
from trendloom.operators import labels as L
from trendloom.operators import signature as S
from trendloom.scratch import written
from trendloom.sources import files
from trendloom.sources import fixtures as T

#: Count rules for the small counts of the derived cube.
RULES = S.Rules(low=3, high=8, visible=3, recency=3)
# The sweep's settings.
MULTIPLIERS = (1.2, 1.3, 1.4, 1.5, 1.6, 1.75, 2.0, 2.5, 3.0)
FLOORS = (0.5, 0.75, 1.0, 1.5, 2.0)


def shares(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_year_shares(T.cube(spark, d))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return S.freeze_thresholds(shares(spark, d), RULES)


def backtest(spark: SparkSession, d: str) -> DataFrame:
    return S.backtest(shares(spark, d), thresholds(spark, d), window=RULES.window)


def mentions(spark: SparkSession, d: str, mode: str = "t4") -> DataFrame:
    return L.mentions(L.main_track(T.papers(spark, d)), mode)


def title_shares(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_year_shares(title_cube(spark, d))


def main_papers(spark: SparkSession, d: str) -> DataFrame:
    """The main track, as a table for plans that read it more than once."""
    return written(L.main_track(T.papers(spark, d)).select("paper", "conference", "year", "title", "keywords"), "main-papers")


def label_cube(spark: SparkSession, d: str, papers: DataFrame | None = None) -> DataFrame:
    found = L.mentions(L.main_track(T.papers(spark, d)) if papers is None else papers, "t4", T.canonical(spark, d))
    return found.withColumnRenamed("k", "topic").withColumnRenamed("conference", "venue").groupBy("topic", "year", "venue").agg(C.F.count("*").alias("count"))


def title_cube(spark: SparkSession, d: str, labels: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    papers = main_papers(spark, d) if papers is None else papers
    return C.title_cube(papers, label_cube(spark, d, papers) if labels is None else labels, T.canonical(spark, d))


def robustness(spark: SparkSession, d: str) -> DataFrame:
    """The label cube's backtest against all topics of the title cube, each with thresholds of its own."""
    rules = S.Rules(low=3, high=100_000, visible=3, recency=3, explosion=1.1)
    # Both cubes are read several times over; each is worked out once.
    papers = main_papers(spark, d)
    cube = written(label_cube(spark, d, papers), "label-cube")
    labels, titles = written(C.topic_year_shares(cube), "label-shares"), written(C.topic_year_shares(title_cube(spark, d, cube, papers)), "title-shares")
    main = S.backtest(labels, S.freeze_thresholds(labels, rules), window=rules.window)
    return S.robustness(main, S.evaluated(titles, S.freeze_thresholds(titles, rules), window=rules.window))


def summaries(spark: SparkSession, d: str, top: int = 10) -> dict[str, DataFrame]:
    """The summary tables of a report: papers by year and venue, the most frequent labels overall and by venue."""
    papers, found = L.main_track(T.papers(spark, d)), mentions(spark, d, "t1")
    return {
        "papers_per_year_per_venue": C.papers_by(papers, "year", "conference"),
        "top_topics_overall": L.top_labels(found, top),
        "top_topics_per_venue": L.top_labels(found, top, ["conference"]).select("conference", "k", "count"),
    }


def write_summaries(spark: SparkSession, d: str, folder: str, top: int = 10) -> None:
    for name, table in summaries(spark, d, top).items():
        files.write_csv(table, f"{folder.rstrip('/')}/{name}")
