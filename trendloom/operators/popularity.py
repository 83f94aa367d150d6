"""Popularity of a stated list of topics, and its superseded form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.cube import cuts, numbered, rank_average
from trendloom.scratch import written

EARLY, RECENT, YEARS = (2017, 2018, 2019, 2020), (2022, 2023, 2024, 2025), tuple(range(2017, 2026))


def _totals(papers: DataFrame) -> DataFrame:
    return papers.agg(*[F.count_if(F.col("year") == y).alias(f"p{y}") for y in YEARS])


def popularity(papers: DataFrame, mentions: DataFrame, topics: DataFrame) -> DataFrame:
    """Shares of papers a year, trend between two windows, averaged-rank scores and their rank.

    A topic absent from the early window gets one paper's share of the first year
    for it.  Topics without any mention stay.  Scores are ranked in ranges of
    their values, so that no task holds all topics.
    """
    hits = mentions.groupBy("k").agg(*[F.count_if(F.col("year") == y).alias(f"h{y}") for y in YEARS])
    rows = topics.join(hits, topics["topic"] == hits["k"], "left").drop("k").crossJoin(F.broadcast(_totals(papers)))
    share = {y: F.try_divide(F.coalesce(F.col(f"h{y}"), F.lit(0)).cast("double"), F.col(f"p{y}").cast("double")) for y in YEARS}
    total = lambda ys: sum((F.coalesce(share[y], F.lit(0.0)) for y in ys), F.lit(0.0))
    counted = sum(((F.col(f"p{y}") > 0).cast("int") for y in YEARS), F.lit(0))
    early, recent = total(EARLY), total(RECENT)
    out = rows.select(
        "topic",
        F.round(F.coalesce(F.try_divide(total(YEARS), counted), F.lit(0.0)), 10).alias("avg_share"),
        F.round(F.when(early > 0, F.try_divide(recent, early)).otherwise(recent * F.col(f"p{EARLY[0]}")), 10).alias("trend"),
        F.coalesce(F.col("h2025"), F.lit(0)).alias("count_2025"),
        F.coalesce(share[2025], F.lit(0.0)).alias("share_2025"),
        (early <= 0).alias("early_zero"),
    )
    out = written(out, "popularity")
    bounds = cuts(out, ["avg_share", "trend"])
    for column, name in (("avg_share", "S_NP"), ("trend", "S_NTr")):
        out = rank_average(out, column, name, bounds[column])
    # The score lies between 0 and 2.
    return numbered(out.withColumn("P_k", F.col("S_NP") + F.col("S_NTr")), "P_k", [k / 32 for k in range(1, 64)], [F.col("topic")], "rank")


def popularity_legacy(mentions: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Counts of mentions that contain a topic's name, min-max scores, the list's own order."""
    listed = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(i + 1).alias("rank")) for i, t in enumerate(topics)])
    base = mentions.sparkSession.range(1).select(F.inline(listed))
    hits = mentions.select("year", "k", F.explode(F.filter(listed, lambda t: F.col("k").contains(t["topic"]))).alias("t")).groupBy("t.topic").agg(*[F.count_if(F.col("year") == y).alias(f"h{y}") for y in YEARS])
    rows = base.join(hits, "topic", "left").na.fill(0)
    seen = mentions.agg(*[(F.count_if(F.col("year") == y) > 0).cast("int").alias(f"s{y}") for y in YEARS])
    rows = rows.crossJoin(F.broadcast(seen))
    add = lambda ys: sum((F.col(f"h{y}") for y in ys), F.lit(0))
    early, late = add([y for y in YEARS if y <= 2020]), add([y for y in YEARS if y > 2020])
    n = sum((F.col(f"s{y}") for y in YEARS), F.lit(0))
    out = rows.select("topic", "rank", F.try_divide(add(YEARS).cast("double"), n).alias("avg_prop"), F.when(early > 0, late / early).otherwise((late + 1).cast("double")).alias("trend"), F.col("h2025").alias("count_2025"))
    ends = out.agg(F.min("avg_prop").alias("a0"), F.max("avg_prop").alias("a1"), F.min("trend").alias("t0"), F.max("trend").alias("t1"))
    out = out.crossJoin(F.broadcast(ends)).withColumn("S_NP", F.try_divide(F.expr("avg_prop - a0"), F.expr("a1 - a0"))).withColumn("S_NTr", F.try_divide(F.expr("trend - t0"), F.expr("t1 - t0")))
    return out.withColumn("P_k", F.col("S_NP") + F.col("S_NTr")).drop("a0", "a1", "t0", "t1")
