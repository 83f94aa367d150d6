"""Frozen thresholds, the early-warning signature, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.cube import wide


@dataclass(frozen=True)
class Rules:
    """Count rules that are turned into shares at the end of calibration, and the ratios."""

    low: int = 5
    high: int = 300
    visible: int = 10
    recency: int = 3
    accel: float = 2.5
    venues: int = 2
    explosion: float = 1.5
    window: int = 3


@dataclass(frozen=True)
class Periods:
    first: int = 2017
    calibration_end: int = 2021
    freeze: int = 2022
    outcome: tuple[int, ...] = (2023, 2024, 2025)
    splits: tuple[int, ...] = field(default=(2017, 2018))

    @property
    def years(self) -> list[int]:
        return list(range(self.first, max(*self.outcome, self.freeze) + 1))


def threshold_selectivity(shares: DataFrame, rules: Sequence[tuple[str, int]], year: int) -> DataFrame:
    """rule, count_thr, admitted, share_thr: the share that admits as many topics as a count does.

    Within a year shares are counts over a constant, so that is the least share of
    the admitted; the largest share of all if none is.
    """
    at = shares.where(F.col("year") == year)
    one = at.agg(*[x for name, n in rules for x in (F.count_if(F.col("count") >= n).alias(f"a_{name}"), F.coalesce(F.min(F.when(F.col("count") >= n, F.col("share"))), F.max("share")).alias(f"s_{name}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(n).alias("count_thr"), F.col(f"a_{name}").alias("admitted"), F.col(f"s_{name}").alias("share_thr")) for name, n in rules])))


def accel_cdf(shares: DataFrame, ratio: float, periods: Periods = Periods()) -> DataFrame:
    """n, quantile: where the ratio lies among the yearly share ratios of the calibration years."""
    years = list(range(periods.first, periods.calibration_end + 1))
    ratios = F.array(*[F.when(F.col(f"v{a}") > 0, F.col(f"v{b}") / F.col(f"v{a}")) for a, b in zip(years, years[1:], strict=False)])
    found = wide(shares.where(F.col("year") <= periods.calibration_end), years).select(F.explode(ratios).alias("r")).where("r IS NOT NULL")
    return found.agg(F.count("*").alias("n"), F.avg((F.col("r") < ratio).cast("double")).alias("quantile"))


def explosion_estimate(shares: DataFrame, periods: Periods = Periods(), least: int = 3, rise: float = 3.0) -> DataFrame:
    """n, base_rate, estimate: the share multiple that is as rare as a count's rise in the calibration splits.

    The quantile is a pair of order statistics whose ranks depend on the data.
    They are looked for in two steps: in a histogram of a bounded number of cells,
    then among the values of the two cells that hold them.
    """
    years = list(range(periods.first, periods.calibration_end + 1))
    w = wide(shares.where(F.col("year") <= periods.calibration_end), years)
    parts = []
    for s in periods.splits:
        after = [y for y in (s + 1, s + 2, s + 3) if y in years]
        if len(after) == 3 and s in years:
            parts.append(F.when(F.col(f"c{s}") >= least, F.struct((F.greatest(*[F.col(f"c{y}") for y in after]) / F.col(f"c{s}")).alias("gc"), (F.greatest(*[F.col(f"v{y}") for y in after]) / F.col(f"v{s}")).alias("gs"))))
    g = w.select(F.explode(F.array(*parts)).alias("g")).where("g IS NOT NULL").select("g.gc", "g.gs")
    base = g.agg(F.count("*").alias("n"), F.avg((F.col("gc") >= rise).cast("double")).alias("base_rate"))
    cell = F.coalesce(F.floor(F.log(F.when(F.col("gs") > 0, F.col("gs"))) * 1000), F.lit(-(1 << 20)))
    values = g.groupBy("gs").agg(F.count("*").alias("k")).withColumn("cell", cell)
    cells = values.groupBy("cell").agg(F.sum("k").alias("k"))
    # Thousandths of a logarithm: some ten thousands of cells, whatever the topics.
    cells = cells.withColumn("last", F.sum("k").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    h = F.expr("(n - 1) * (1 - base_rate)")
    ranks = base.select("n", "base_rate", F.floor(h).alias("lo"), F.least(F.floor(h) + 1, F.col("n") - 1).alias("hi"))
    wanted = cells.crossJoin(F.broadcast(ranks)).where("(last > lo AND last - k <= lo) OR (last > hi AND last - k <= hi)").select("cell", (F.col("last") - F.col("k")).alias("start"), "n", "base_rate", "lo", "hi")
    # At most two cells, each with its values.
    placed = values.join(F.broadcast(wanted), "cell")
    placed = placed.withColumn("end", F.col("start") + F.sum("k").over(Window.partitionBy("cell").orderBy("gs").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda r: F.min(F.when(F.col("end") > F.col(r), F.col("gs"))).alias(f"x_{r}")
    out = base.crossJoin(F.broadcast(placed.agg(at("lo"), at("hi"))))
    return out.select("n", "base_rate", (F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * (h - F.floor(h))).alias("estimate"))


def freeze_thresholds(shares: DataFrame, rules: Rules = Rules(), periods: Periods = Periods()) -> DataFrame:
    """One row: scale_low, scale_high, visible, recency (shares), accel, venues, explosion.

    The year is asked for row by row, and all columns are counted, so that the
    shares below are the same plan as the signature's and are worked out once for both.
    """
    now = F.col("year") == periods.calibration_end
    pick = lambda n, name: F.coalesce(F.min(F.when(now & (F.col("count") >= n), F.col("share"))), F.max(F.when(now, F.col("share")))).alias(name)
    one = shares.agg(pick(rules.low, "scale_low"), pick(rules.high, "scale_high"), pick(rules.visible, "visible"), pick(rules.recency, "recency_min"), *[F.count(c).alias(f"n_{c}") for c in ("topic", "n_venues", "total")])
    one = one.where("n_topic + n_n_venues + n_total >= 0").drop("n_topic", "n_n_venues", "n_total")
    return one.select("*", F.lit(rules.accel).alias("accel"), F.lit(rules.venues).alias("min_venues"), F.lit(rules.explosion).alias("explosion"))


def threshold_row(shares: DataFrame, rules: Rules = Rules(), periods: Periods = Periods()) -> DataFrame:
    """The thresholds with what they were estimated from: explosion_estimate and explosion_n, accel_quantile and the calibration's topics."""
    estimate = explosion_estimate(shares, periods).select(F.col("estimate").alias("explosion_estimate"), F.col("n").alias("explosion_n"))
    ratio = accel_cdf(shares, rules.accel, periods).select(F.col("quantile").alias("accel_quantile"))
    out = freeze_thresholds(shares, rules, periods)
    for one in (estimate, ratio, calibration_topics(shares, periods)):
        out = out.crossJoin(F.broadcast(one))
    return out


def calibration_topics(shares: DataFrame, periods: Periods = Periods()) -> DataFrame:
    """One row: the topics and rows of the calibration years."""
    return shares.where(F.col("year") <= periods.calibration_end).agg(F.count_distinct("topic").alias("topics"), F.count("*").alias("rows"))


def count_quantiles(shares: DataFrame, rules: Rules = Rules(), periods: Periods = Periods()) -> DataFrame:
    """One row: the part of the calibration's yearly counts below each count rule."""
    below = lambda n, name: F.avg((F.col("count") < n).cast("double")).alias(name)
    return shares.where(F.col("year") <= periods.calibration_end).agg(below(rules.low, "q_low"), below(rules.high, "q_high"), below(rules.visible, "q_visible"), below(rules.recency, "q_recency"))


def count_thresholds(like: DataFrame, rules: Rules) -> DataFrame:
    """The same row for the rules on raw counts."""
    return like.sparkSession.range(1).select(*[F.lit(float(v)).alias(n) for n, v in (("scale_low", rules.low), ("scale_high", rules.high), ("visible", rules.visible), ("recency_min", rules.recency), ("accel", rules.accel))], F.lit(rules.venues).alias("min_venues"), F.lit(rules.explosion).alias("explosion"))


def criteria(as_of: int, first: int, window: int) -> dict[str, Column]:
    """The four criteria on a row of ``wide`` and thresholds; a rise from zero is without bound."""
    v = lambda y: F.col(f"v{y}") if y >= first else F.lit(0.0)
    rises = lambda y: F.when(v(y - 1) > 0, v(y) / v(y - 1) >= F.col("accel")).otherwise(v(y) > 0)
    early = F.lit(False)
    for y in range(first, as_of - window + 1):
        early = early | (v(y) >= F.col("recency_min"))
    recent = F.lit(False)
    for y in range(max(first, as_of - window + 1), as_of + 1):
        recent = recent | (v(y) >= F.col("recency_min"))
    return {
        "recency": recent & ~early,
        "acceleration": rises(as_of) | rises(as_of - 1),
        "spread": F.col(f"n{as_of}") >= F.col("min_venues"),
        "scale": (v(as_of) >= F.col("scale_low")) & (v(as_of) <= F.col("scale_high")),
    }


def evaluated(shares: DataFrame, thresholds: DataFrame, periods: Periods = Periods(), window: int = 3, measure: str = "share") -> DataFrame:
    """Every topic with its criteria at the freeze, base, peak and thresholds: one shuffle by topic."""
    w = wide(shares, periods.years, measure).crossJoin(F.broadcast(thresholds))
    c = criteria(periods.freeze, periods.first, window)
    peak = F.greatest(*[F.col(f"v{y}") for y in periods.outcome]) if len(periods.outcome) > 1 else F.col(f"v{periods.outcome[0]}")
    return w.select("topic", *[x.alias(k) for k, x in c.items()], F.col(f"v{periods.freeze}").alias("base"), peak.alias("peak"), "visible", "explosion").withColumn("predicted_positive", F.expr("recency AND acceleration AND spread AND scale"))


def signature(shares: DataFrame, thresholds: DataFrame, as_of: int, periods: Periods = Periods(), window: int = 3) -> DataFrame:
    """Every topic's share and criteria as of a year; years after it do not count."""
    w = wide(shares, list(range(periods.first, as_of + 1))).crossJoin(F.broadcast(thresholds))
    out = w.select("topic", F.col(f"v{as_of}").alias("share"), "visible", *[x.alias(k) for k, x in criteria(as_of, periods.first, window).items()])
    return out.withColumn("predicted_positive", F.expr("recency AND acceleration AND spread AND scale"))


def backtest(shares: DataFrame, thresholds: DataFrame, periods: Periods = Periods(), measure: str = "share", window: int = 3) -> DataFrame:
    """Visible topics with prediction, outcome and criteria."""
    e = evaluated(shares, thresholds, periods, window, measure).where("base >= visible")
    return e.select("topic", "predicted_positive", F.expr("base > 0 AND peak >= explosion * base").alias("exploded"), "recency", "acceleration", "spread", "scale")


def confusion(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N, TP, FP, FN, TN, precision, recall, base, lift; a rate without a denominator is null."""
    p, e = F.col("predicted_positive"), F.col("exploded")
    counts = table.groupBy(*(by or [])).agg(F.count("*").alias("N"), F.count_if(p & e).alias("TP"), F.count_if(p & ~e).alias("FP"), F.count_if(~p & e).alias("FN"), F.count_if(~p & ~e).alias("TN"))
    d = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    out = counts.withColumn("precision", d("TP", "TP + FP")).withColumn("recall", d("TP", "TP + FN")).withColumn("base", d("TP + FN", "N"))
    return out.withColumn("lift", F.try_divide("precision", "base"))


def sensitivity(shares: DataFrame, thresholds: DataFrame, multipliers: Sequence[float], floors: Sequence[float], periods: Periods = Periods()) -> DataFrame:
    """Confusion for each explosion multiple, and for each factor on the visibility floor.

    The signature depends on neither and is computed once; settings are literals.
    """
    e = evaluated(shares, thresholds, periods)
    settings = [("multiplier", m, m, 1.0) for m in multipliers] + [("floor", f, None, f) for f in floors]
    params = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("value"), F.lit(m).cast("double").alias("m"), F.lit(f).alias("f")) for k, v, m, f in settings])
    rows = e.withColumn("s", F.explode(params)).where("base >= visible * s.f")
    rows = rows.select(F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), "predicted_positive", F.expr("base > 0 AND peak >= coalesce(s.m, explosion) * base").alias("exploded"))
    return confusion(rows, ["kind", "value"])


def sweep_ranges(swept: DataFrame) -> DataFrame:
    """kind, and the least and greatest recall and lift over its settings."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("recall", "lift") for n, f in (("least", F.min), ("most", F.max))]
    return swept.groupBy("kind").agg(*ends)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a proportion."""
    n, p = n.cast("double"), F.try_divide(hits.cast("double"), n.cast("double"))
    mid, den = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / den, (mid + half) / den


def lists_of(table: DataFrame) -> DataFrame:
    """Names of the true and false positives and false negatives, sorted: a report, as long as its topics."""
    p, e = F.col("predicted_positive"), F.col("exploded")
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("topic")))), "; ")
    return table.agg(named(p & e).alias("tp"), named(p & ~e).alias("fp"), named(~p & e).alias("fn"))


def robustness(main: DataFrame, other: DataFrame) -> DataFrame:
    """Confusion of another label source on the topics of the main backtest that it has, and what survives.

    ``other`` is ``evaluated`` of all its topics, visible or not.  flags and tps
    are the main backtest's positives and true positives that stay such, sorted
    and joined by "; " as a report's lists; main_flags is how many flags there were.
    Precision and recall have 1 for a denominator of 0, the base rate is null.
    """
    was = main.select("topic", F.col("predicted_positive").alias("p0"), F.col("exploded").alias("e0"))
    now = other.select("topic", "predicted_positive", F.expr("base > 0 AND peak >= explosion * base").alias("exploded"))
    both = was.join(now, "topic")
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("topic")))), "; ")
    p, e = F.col("predicted_positive"), F.col("exploded")
    counts = both.agg(F.count("*").alias("N"), F.count_if(p & e).alias("TP"), F.count_if(p & ~e).alias("FP"), F.count_if(~p & e).alias("FN"), F.count_if(~p & ~e).alias("TN"), named(F.col("p0") & p).alias("flags"), named(F.expr("p0 AND e0") & p & e).alias("tps"))
    guarded = lambda a, b: F.expr(f"CAST({a} AS DOUBLE) / greatest({b}, 1)")
    out = counts.withColumn("precision", guarded("TP", "TP + FP")).withColumn("recall", guarded("TP", "TP + FN")).withColumn("base", F.expr("try_divide(CAST(TP + FN AS DOUBLE), N)"))
    return out.crossJoin(F.broadcast(main.agg(F.count_if("predicted_positive").alias("main_flags"))))


def robustness_lines(found: DataFrame) -> DataFrame:
    """The summary of ``robustness`` as lines of text."""
    kept = F.when(F.col("flags") == "", 0).otherwise(F.size(F.split("flags", "; ")))
    lines = [
        F.lit("Robustness of the signature to keyword source"),
        F.format_string("topics scored: %d", "N"),
        F.format_string("TP=%d FP=%d FN=%d TN=%d", "TP", "FP", "FN", "TN"),
        F.format_string("precision=%.1f%%  recall=%.1f%%  base rate=%.1f%%", F.col("precision") * 100, F.col("recall") * 100, F.col("base") * 100),
        F.concat(F.format_string("flags still flagged: %d of %d: ", kept, "main_flags"), F.col("flags")),
        F.concat(F.lit("true positives still true positives: "), F.col("tps")),
    ]
    return found.select(F.explode(F.array(*lines)).alias("line"))
