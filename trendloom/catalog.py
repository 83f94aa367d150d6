"""All registered queries of the library's own operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import notes as N
from trendloom.functions import text as X
from trendloom.operators import cube as C
from trendloom.operators import keywords as K
from trendloom.operators import labels as L
from trendloom.operators import merge as M
from trendloom.operators import popularity as P
from trendloom.operators import series as V
from trendloom.operators import signature as S
from trendloom.plans import reports as R
from trendloom.registry import ORACLES, QUERIES, query
from trendloom.sources import files
from trendloom.sources import fixtures as T

# --- SQL building blocks: common table expressions ---------------------------

PERIOD = "CAST(2017 + least(8, floor(((year({0}) - 1995) * 12 + month({0}) - 1) / 9)) AS INT)"
CUBE = f"""cube AS (
  SELECT 'part ' || l_partkey AS topic, {PERIOD.format("l_shipdate")} AS year, r_name AS venue, count(*) AS count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
SHARES = """shares AS (
  SELECT topic, year, count, n_venues, total, count / total AS share FROM (
    SELECT topic, year, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT CASE WHEN count > 0 THEN venue END) AS n_venues FROM {0} GROUP BY topic, year)
  JOIN (SELECT year, CAST(sum(count) AS BIGINT) AS total FROM {0} GROUP BY year) USING (year))"""
PAPERS = f"""words AS (
  SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, p_name) AS keywords
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
papers AS (
  SELECT o_orderkey AS paper, r_name AS conference, {PERIOD.format("o_orderdate")} AS year, CASE WHEN o_orderstatus = 'P' THEN 'workshop' ELSE 'main' END AS paper_type,
    concat_ws(' ', 'on', replace(keywords, '; ', ' ')) AS title, keywords
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN words ON o_orderkey = l_orderkey),
main AS (SELECT * FROM papers WHERE paper_type = 'main')"""
ALL_MENTIONS = "found AS (SELECT conference, year, title, trim(k) AS k FROM main, unnest(string_split(lower(keywords), ';')) t(k) WHERE trim(k) <> '')"
MENTIONS = "mentions AS (SELECT DISTINCT conference, year, title, trim(k) AS k FROM main, unnest(string_split(lower(keywords), ';')) t(k) WHERE trim(k) <> '')"
CANONICAL = "canonical AS (SELECT DISTINCT p_name AS surface, regexp_replace(p_name, '^(small|large) ', '') AS label FROM part WHERE regexp_matches(p_name, '^(small|large) '))"
THRESHOLDS = """thresholds AS (
  SELECT coalesce(min(share) FILTER (count >= 3), max(share)) AS scale_low, coalesce(min(share) FILTER (count >= 8), max(share)) AS scale_high,
    coalesce(min(share) FILTER (count >= 3), max(share)) AS visible, coalesce(min(share) FILTER (count >= 3), max(share)) AS recency_min
  FROM shares WHERE year = 2021)"""


def _wide(years: range, value: str = "share") -> str:
    cols = ", ".join(f"coalesce(max({value}) FILTER (year = {y}), 0) AS v{y}, coalesce(max(count) FILTER (year = {y}), 0) AS c{y}, coalesce(max(n_venues) FILTER (year = {y}), 0) AS n{y}" for y in years)
    return f"wide AS (SELECT topic, {cols} FROM shares GROUP BY topic)"


def _criteria(as_of: int, window: int = 3, first: int = 2017) -> str:
    early = " OR ".join(f"v{y} >= recency_min" for y in range(first, as_of - window + 1))
    recent = " OR ".join(f"v{y} >= recency_min" for y in range(as_of - window + 1, as_of + 1))
    rise = lambda y: f"CASE WHEN v{y - 1} > 0 THEN v{y} / v{y - 1} >= 2.5 ELSE v{y} > 0 END"
    return f"(({recent}) AND NOT ({early})) AS recency, ({rise(as_of)} OR {rise(as_of - 1)}) AS acceleration, n{as_of} >= 2 AS spread, (v{as_of} >= scale_low AND v{as_of} <= scale_high) AS scale"


def _evaluated(value: str = "share") -> str:
    return f"""evaluated AS (SELECT *, recency AND acceleration AND spread AND scale AS predicted_positive FROM (
      SELECT topic, {_criteria(2022)}, v2022 AS base, greatest(v2023, v2024, v2025) AS peak, visible FROM wide, thresholds))"""


BACKTEST = "backtest AS (SELECT topic, predicted_positive, base > 0 AND peak >= {0} * base AS exploded, recency, acceleration, spread, scale FROM evaluated WHERE base >= visible)"
CONFUSION = """count(*) AS "N", count(*) FILTER (predicted_positive AND exploded) AS "TP", count(*) FILTER (predicted_positive AND NOT exploded) AS "FP",
  count(*) FILTER (NOT predicted_positive AND exploded) AS "FN", count(*) FILTER (NOT predicted_positive AND NOT exploded) AS "TN" """
RATES = """"TP" / nullif("TP" + "FP", 0) AS precision, "TP" / nullif("TP" + "FN", 0) AS recall, ("TP" + "FN") / nullif("N", 0) AS base,
  ("TP" / nullif("TP" + "FP", 0)) / nullif(("TP" + "FN") / nullif("N", 0), 0) AS lift"""
BASE = f"WITH {CUBE}, {SHARES.format('cube')}, {THRESHOLDS}, {_wide(range(2017, 2026))}, {_evaluated()}, {BACKTEST.format(1.5)}"
TEXT = f"WITH {PAPERS}, {MENTIONS}"

# --- shares, thresholds, signature -------------------------------------------


@query(f"WITH {CUBE}, {SHARES.format('cube')} SELECT * FROM shares")
def topic_year_shares(spark: SparkSession, d: str) -> DataFrame:
    return R.shares(spark, d)


@query("""WITH q AS (SELECT * FROM (VALUES ('low', 3), ('high', 8), ('fallback', 1000)) r(rule, count_thr)), """ + f"{CUBE}, {SHARES.format('cube')}" + """
  SELECT rule, CAST(count_thr AS INT) AS count_thr, count(*) FILTER (count >= count_thr) AS admitted, coalesce(min(share) FILTER (count >= count_thr), max(share)) AS share_thr
  FROM shares, q WHERE year = 2021 GROUP BY rule, count_thr""")
def threshold_selectivity(spark: SparkSession, d: str) -> DataFrame:
    return S.threshold_selectivity(R.shares(spark, d), [("low", 3), ("high", 8), ("fallback", 1000)], 2021)


@query(f"""WITH {CUBE}, {SHARES.format('cube')}, {_wide(range(2017, 2022))},
  ratios AS (SELECT unnest([CASE WHEN v2017 > 0 THEN v2018 / v2017 END, CASE WHEN v2018 > 0 THEN v2019 / v2018 END, CASE WHEN v2019 > 0 THEN v2020 / v2019 END, CASE WHEN v2020 > 0 THEN v2021 / v2020 END]) AS r FROM wide)
  SELECT count(*) AS n, round(avg(CASE WHEN r < 2.5 THEN 1.0 ELSE 0.0 END), 10) AS quantile FROM ratios WHERE r IS NOT NULL""")
def accel_cdf(spark: SparkSession, d: str) -> DataFrame:
    return S.accel_cdf(R.shares(spark, d), 2.5).withColumn("quantile", F.round("quantile", 10))


@query(f"""WITH {CUBE}, {SHARES.format('cube')}, {_wide(range(2017, 2022))},
  g AS (SELECT greatest(c2018, c2019, c2020) / c2017 AS gc, greatest(v2018, v2019, v2020) / v2017 AS gs FROM wide WHERE c2017 >= 3
    UNION ALL SELECT greatest(c2019, c2020, c2021) / c2018, greatest(v2019, v2020, v2021) / v2018 FROM wide WHERE c2018 >= 3),
  b AS (SELECT count(*) AS n, avg(CASE WHEN gc >= 3 THEN 1.0 ELSE 0.0 END) AS base_rate FROM g),
  o AS (SELECT gs, row_number() OVER (ORDER BY gs) - 1 AS i FROM g),
  h AS (SELECT n, base_rate, (n - 1) * (1 - base_rate) AS h FROM b)
  SELECT n, round(base_rate, 10) AS base_rate, round(max(CASE WHEN i = floor(h) THEN gs END) + (max(CASE WHEN i = least(floor(h) + 1, n - 1) THEN gs END) - max(CASE WHEN i = floor(h) THEN gs END)) * (h - floor(h)), 8) AS estimate
  FROM o, h GROUP BY n, base_rate, h""")
def explosion_quantile(spark: SparkSession, d: str) -> DataFrame:
    return S.explosion_estimate(R.shares(spark, d)).select("n", F.round("base_rate", 10).alias("base_rate"), F.round("estimate", 8).alias("estimate"))


@query(f"WITH {CUBE}, {SHARES.format('cube')}, {THRESHOLDS} SELECT *, CAST(2.5 AS DOUBLE) AS accel, CAST(2 AS INT) AS min_venues, CAST(1.5 AS DOUBLE) AS explosion FROM thresholds")
def freeze_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return R.thresholds(spark, d)


@query(f"""WITH {CUBE}, {SHARES.format('cube')}, {THRESHOLDS}, {_wide(range(2017, 2022))},
  g AS (SELECT greatest(c2018, c2019, c2020) / c2017 AS gc, greatest(v2018, v2019, v2020) / v2017 AS gs FROM wide WHERE c2017 >= 3
    UNION ALL SELECT greatest(c2019, c2020, c2021) / c2018, greatest(v2019, v2020, v2021) / v2018 FROM wide WHERE c2018 >= 3),
  b AS (SELECT count(*) AS n, avg(CASE WHEN gc >= 3 THEN 1.0 ELSE 0.0 END) AS base_rate FROM g), h AS (SELECT n, (n - 1) * (1 - base_rate) AS h FROM b),
  o AS (SELECT gs, row_number() OVER (ORDER BY gs) - 1 AS i FROM g),
  e AS (SELECT n, max(CASE WHEN i = floor(h) THEN gs END) + (max(CASE WHEN i = least(floor(h) + 1, n - 1) THEN gs END) - max(CASE WHEN i = floor(h) THEN gs END)) * (h - floor(h)) AS x FROM o, h GROUP BY n, h)
  SELECT scale_low AS "SCALE_LOW_SHARE", scale_high AS "SCALE_HIGH_SHARE", visible AS "MIN_VISIBLE_SHARE", recency_min AS "RECENCY_MIN_SHARE", CAST(2.5 AS DOUBLE) AS "ACCEL_RATIO", CAST(2 AS INT) AS "SPREAD_MIN_VENUES",
    CAST(1.5 AS DOUBLE) AS "EXPLOSION_RELATIVE_SHARE", round(x, 8) AS "_explosion_raw_quantile_estimate", n AS "_explosion_calib_n" FROM thresholds, e""")
def threshold_document(spark: SparkSession, d: str) -> DataFrame:
    rows = files.threshold_document(S.threshold_row(R.shares(spark, d), R.RULES))
    return rows.withColumn("_explosion_raw_quantile_estimate", F.round("_explosion_raw_quantile_estimate", 8))


@query(f"""WITH {CUBE}, {SHARES.format('cube')} SELECT count(DISTINCT topic) AS topics, count(*) AS rows, avg(CASE WHEN count < 3 THEN 1.0 ELSE 0.0 END) AS q_low, avg(CASE WHEN count < 8 THEN 1.0 ELSE 0.0 END) AS q_high,
  avg(CASE WHEN count < 3 THEN 1.0 ELSE 0.0 END) AS q_visible, avg(CASE WHEN count < 3 THEN 1.0 ELSE 0.0 END) AS q_recency FROM shares WHERE year <= 2021""")
def calibration_window(spark: SparkSession, d: str) -> DataFrame:
    s = R.shares(spark, d)
    return S.calibration_topics(s).crossJoin(F.broadcast(S.count_quantiles(s, R.RULES)))


@query(f"{BASE} SELECT topic, recency, acceleration, spread, scale, predicted_positive FROM evaluated")
def signature_criteria(spark: SparkSession, d: str) -> DataFrame:
    return S.evaluated(R.shares(spark, d), R.thresholds(spark, d)).select("topic", "recency", "acceleration", "spread", "scale", "predicted_positive")


@query(f"{BASE} SELECT * FROM backtest")
def backtest_eval(spark: SparkSession, d: str) -> DataFrame:
    return R.backtest(spark, d)


@query(f"{BASE} SELECT *, {RATES} FROM (SELECT {CONFUSION} FROM backtest)")
def confusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.confusion(R.backtest(spark, d))


@query(f"""{BASE} SELECT coalesce(string_agg(topic, '; ' ORDER BY topic) FILTER (predicted_positive AND exploded), '') AS tp, coalesce(string_agg(topic, '; ' ORDER BY topic) FILTER (predicted_positive AND NOT exploded), '') AS fp,
  coalesce(string_agg(topic, '; ' ORDER BY topic) FILTER (NOT predicted_positive AND exploded), '') AS fn FROM backtest""")
def confusion_lists(spark: SparkSession, d: str) -> DataFrame:
    return S.lists_of(R.backtest(spark, d))


@query(f"""{BASE}, c AS (SELECT {CONFUSION} FROM backtest), p AS (SELECT "TP" AS hits, "TP" + "FN" AS n, "TP" / nullif("TP" + "FN", 0) AS p FROM c)
  SELECT hits, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 10) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 10) AS high FROM p""")
def wilson_recall(spark: SparkSession, d: str) -> DataFrame:
    c = S.confusion(R.backtest(spark, d)).select(F.col("TP").alias("hits"), (F.col("TP") + F.col("FN")).alias("n"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return c.select("hits", "n", F.round(low, 10).alias("low"), F.round(high, 10).alias("high"))


_SWEEP = f"""{BASE}, s AS (SELECT 'multiplier' AS kind, CAST(m AS DOUBLE) AS value, CAST(m AS DOUBLE) AS m, 1.0 AS f FROM unnest([1.2, 1.3, 1.4, 1.5, 1.6, 1.75, 2.0, 2.5, 3.0]) t(m)
    UNION ALL SELECT 'floor', CAST(f AS DOUBLE), CAST(1.5 AS DOUBLE), f FROM unnest([0.5, 0.75, 1.0, 1.5, 2.0]) t(f)),
  r AS (SELECT kind, value, predicted_positive, base > 0 AND peak >= m * base AS exploded FROM evaluated, s WHERE base >= visible * CAST(f AS DOUBLE))
  SELECT *, {RATES} FROM (SELECT kind, value, {CONFUSION} FROM r GROUP BY kind, value)"""


@query(_SWEEP)
def sensitivity_sweep(spark: SparkSession, d: str) -> DataFrame:
    return S.sensitivity(R.shares(spark, d), R.thresholds(spark, d), R.MULTIPLIERS, R.FLOORS)


@query(f"SELECT kind, min(recall) AS least_recall, max(recall) AS most_recall, min(lift) AS least_lift, max(lift) AS most_lift FROM ({_SWEEP}) GROUP BY kind")
def sweep_ranges(spark: SparkSession, d: str) -> DataFrame:
    return S.sweep_ranges(sensitivity_sweep(spark, d))


@query(f"""SELECT (CASE WHEN value = 1.5 THEN '1.50*' ELSE printf('%.2f', value) END) || ' & ' || coalesce(printf('%.1f', base * 100), '--') || ' & ' || "TP" || ' & ' || "FP" || ' & ' || "FN" || ' ' || chr(92) || chr(92) AS line FROM ({_SWEEP}) WHERE kind = 'multiplier'""")
def sweep_latex(spark: SparkSession, d: str) -> DataFrame:
    rows = sensitivity_sweep(spark, d).where("kind = 'multiplier'")
    shown = rows.select(F.when(F.col("value") == 1.5, "1.50*").otherwise(F.format_string("%.2f", "value")).alias("value"), F.format_string("%.1f", F.col("base") * 100).alias("base"), "TP", "FP", "FN")
    return files.latex_rows(shown, ["value", "base", "TP", "FP", "FN"])


@query(f"""WITH {CUBE}, {SHARES.format('cube')}, {THRESHOLDS}, {_wide(range(2017, 2026))}
  SELECT topic, share, recency, acceleration, spread, scale FROM (SELECT topic, v2025 AS share, visible, {_criteria(2025)} FROM wide, thresholds) WHERE share >= visible AND recency AND acceleration AND spread AND scale""")
def candidates_latest(spark: SparkSession, d: str) -> DataFrame:
    out = S.signature(R.shares(spark, d), R.thresholds(spark, d), 2025)
    return out.where("share >= visible AND predicted_positive").select("topic", "share", "recency", "acceleration", "spread", "scale")


@query(f"""WITH {CUBE}, {SHARES.format('cube')}, thresholds AS (SELECT 5.0 AS scale_low, 300.0 AS scale_high, 3.0 AS visible, 3.0 AS recency_min), {_wide(range(2017, 2026), 'CAST(count AS DOUBLE)')}, {_evaluated()}, {BACKTEST.format(3.0)} SELECT * FROM backtest""")
def legacy_backtest(spark: SparkSession, d: str) -> DataFrame:
    rules = S.Rules(low=5, high=300, visible=3, recency=3, explosion=3.0)
    s = R.shares(spark, d)
    return S.backtest(s, S.count_thresholds(s, rules), measure="count")


@query(f"WITH {CUBE} SELECT topic, year, venue, count FROM cube")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.from_rows(T.cube_rows(spark, d))


# --- labels --------------------------------------------------------------------


@query(f"WITH {PAPERS} SELECT * FROM papers")
def derived_papers(spark: SparkSession, d: str) -> DataFrame:
    return T.papers(spark, d)


_SPLIT = "SELECT conference, k, count(*) AS count FROM ({0}) GROUP BY conference, k"
_ROWS = "SELECT {1} conference, year, title, {2} AS k FROM main, unnest(regexp_split_to_array({3}, '{0}')) t(k) WHERE trim(k) <> ''"


def _tokenise(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.mentions(spark, d, mode).groupBy("conference", "k").agg(F.count("*").alias("count"))

    run.__name__ = f"tokenise_{mode}"
    return run


for _mode, _by, _distinct, _k in (("t1", "[;,]", "", "trim(regexp_replace(lower(k), '\\s+', ' ', 'g'))"), ("t2", "[;,]", "", "trim(lower(k))"), ("t3", "[;,]", "", "trim(lower(k))"), ("t4", ";", "DISTINCT", "trim(lower(k))")):
    query(f"WITH {PAPERS} " + _SPLIT.format(_ROWS.format(_by, _distinct, _k, "keywords")))(_tokenise(_mode))
query(f"WITH {PAPERS} " + _SPLIT.format(_ROWS.format(";", "DISTINCT", "trim(lower(k))", "keywords")) .replace("WHERE trim(k) <> ''", f"WHERE trim(k) <> '' AND NOT regexp_matches(trim(lower(k)), '{X.JUNK_PATTERN}') AND trim(lower(k)) NOT IN ({', '.join(repr(g) for g in X.GENERIC_LABELS)})"))(_tokenise("t5"))


@query(f"WITH {PAPERS}, {ALL_MENTIONS}, {CANONICAL} SELECT coalesce(label, k) AS k, year, count(*) AS count FROM found LEFT JOIN canonical ON k = surface GROUP BY ALL")
def canonical_counts(spark: SparkSession, d: str) -> DataFrame:
    found = L.mentions(L.labelled(L.main_track(T.papers(spark, d))), "t2", T.canonical(spark, d))
    return found.groupBy("k", "year").agg(F.count("*").alias("count"))


@query(f"{TEXT} SELECT k, count(*) AS count FROM mentions GROUP BY k ORDER BY count DESC, k LIMIT 20")
def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.top_labels(R.mentions(spark, d), 20)


@query("SELECT p_partkey, p_name, regexp_matches(p_name, '" + X.JUNK_PATTERN + "') OR p_name IN (" + ", ".join(repr(g) for g in X.GENERIC_LABELS) + ") AS junk FROM part")
def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", "p_name", X.is_junk(F.col("p_name")).alias("junk"))


_PRESENT = "(keywords IS NULL OR trim(keywords) = '' OR starts_with(lower(trim(keywords)), 'topic'))"


@query(f"WITH {PAPERS} SELECT paper, {_PRESENT} AS regenerate, length(coalesce(keywords, '')) < 10 AS enrich FROM papers")
def keyword_predicates(spark: SparkSession, d: str) -> DataFrame:
    return T.papers(spark, d).select("paper", X.must_regenerate(F.col("keywords")).alias("regenerate"), X.is_short(F.col("keywords")).alias("enrich"))


# --- popularity ------------------------------------------------------------------

_Y = range(2017, 2026)
_POP = f"""WITH {PAPERS}, {ALL_MENTIONS}, {CANONICAL}, lab AS (SELECT * FROM main WHERE keywords IS NOT NULL),
t AS (SELECT DISTINCT label AS topic FROM canonical UNION ALL SELECT 'no such topic'),
m AS (SELECT coalesce(label, k) AS k, year FROM found LEFT JOIN canonical ON k = surface),
tot AS (SELECT {', '.join(f'count(*) FILTER (year = {y}) AS p{y}' for y in _Y)} FROM lab),
h AS (SELECT topic, {', '.join(f'count(k) FILTER (year = {y}) AS h{y}' for y in _Y)} FROM t LEFT JOIN m ON topic = k GROUP BY topic),
s AS (SELECT topic, h2025, p2025, p2017, {' + '.join(f'coalesce(h{y} / nullif(p{y}, 0), 0)' for y in _Y)} AS every, {' + '.join(f'coalesce(h{y} / nullif(p{y}, 0), 0)' for y in P.EARLY)} AS early,
  {' + '.join(f'coalesce(h{y} / nullif(p{y}, 0), 0)' for y in P.RECENT)} AS recent, {' + '.join(f'CAST(p{y} > 0 AS INT)' for y in _Y)} AS n FROM h, tot),
r AS (SELECT topic, round(coalesce(every / nullif(n, 0), 0), 10) AS avg_share, round(CASE WHEN early > 0 THEN recent / early ELSE recent * p2017 END, 10) AS trend, h2025 AS count_2025, coalesce(h2025 / nullif(p2025, 0), 0) AS share_2025, early <= 0 AS early_zero FROM s),
q AS (SELECT *, coalesce((rank() OVER (ORDER BY avg_share) + (count(*) OVER (PARTITION BY avg_share) - 1) / 2 - 1) / nullif(count(*) OVER () - 1, 0), 0) AS "S_NP",
  coalesce((rank() OVER (ORDER BY trend) + (count(*) OVER (PARTITION BY trend) - 1) / 2 - 1) / nullif(count(*) OVER () - 1, 0), 0) AS "S_NTr" FROM r)
SELECT *, "S_NP" + "S_NTr" AS "P_k", CAST(row_number() OVER (ORDER BY "S_NP" + "S_NTr" DESC, topic) AS INT) AS rank FROM q"""


@query(_POP)
def popularity(spark: SparkSession, d: str) -> DataFrame:
    lab = L.labelled(L.main_track(T.papers(spark, d)))
    names = T.canonical(spark, d)
    topics = names.select(F.col("label").alias("topic")).distinct().union(spark.range(1).select(F.lit("no such topic")))
    return P.popularity(lab, L.mentions(lab, "t2", names), topics)


_LEGACY = ("gear", "ring", "bolt", "small", "no such topic")


@query(f"""WITH {PAPERS}, {ALL_MENTIONS}, t AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {i + 1})" for i, t in enumerate(_LEGACY))}) v(topic, rank)),
h AS (SELECT topic, CAST(rank AS INT) AS rank, count(k) AS every, count(k) FILTER (year <= 2020) AS early, count(k) FILTER (year > 2020) AS late, count(k) FILTER (year = 2025) AS count_2025 FROM t LEFT JOIN found ON contains(k, topic) GROUP BY ALL),
r AS (SELECT topic, rank, every / nullif((SELECT count(DISTINCT year) FROM found), 0) AS avg_prop, CASE WHEN early > 0 THEN late / early ELSE CAST(late + 1 AS DOUBLE) END AS trend, count_2025 FROM h),
q AS (SELECT *, (avg_prop - min(avg_prop) OVER ()) / nullif(max(avg_prop) OVER () - min(avg_prop) OVER (), 0) AS "S_NP", (trend - min(trend) OVER ()) / nullif(max(trend) OVER () - min(trend) OVER (), 0) AS "S_NTr" FROM r)
SELECT *, "S_NP" + "S_NTr" AS "P_k" FROM q""")
def popularity_legacy(spark: SparkSession, d: str) -> DataFrame:
    return P.popularity_legacy(L.mentions(L.labelled(L.main_track(T.papers(spark, d))), "t3"), _LEGACY)


# --- merging -----------------------------------------------------------------------

_KEEP = "SELECT * EXCLUDE (src, place) FROM (SELECT *, row_number() OVER (PARTITION BY conference, year, title ORDER BY src, paper) AS place FROM s) WHERE place = 1"


@query(f"WITH {PAPERS}, s AS (SELECT paper, conference, year, title, keywords, 0 AS src FROM papers WHERE paper_type = 'main' UNION ALL SELECT paper, conference, year, title, keywords, 1 FROM papers) {_KEEP}")
def merge_keep_first(spark: SparkSession, d: str) -> DataFrame:
    every = T.papers(spark, d).select("paper", "conference", "year", "title", "keywords", "paper_type")
    return M.merge_papers([every.where("paper_type = 'main'").drop("paper_type"), every.drop("paper_type")], order="paper")


@query(f"""WITH {PAPERS}, b AS (SELECT DISTINCT conference, year, title FROM main), w AS (SELECT DISTINCT conference, year, title FROM papers WHERE paper_type = 'workshop'),
n AS (SELECT conference, year, min(title) AS title FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.conference = w.conference AND b.year = w.year AND lower(b.title[1:12]) = lower(w.title[1:12])) GROUP BY conference, year, lower(title[1:12]))
SELECT * FROM b UNION ALL SELECT * FROM n""")
def append_missing(spark: SparkSession, d: str) -> DataFrame:
    every = T.papers(spark, d)
    pick = lambda kind: every.where(F.col("paper_type") == kind).select("conference", "year", "title").distinct()
    return M.append_missing(pick("main"), pick("workshop"), prefix=12)


# --- titles ------------------------------------------------------------------------

_TITLES = f"""WITH {PAPERS}, {MENTIONS}, {CANONICAL},
labcube AS (SELECT k AS topic, year, conference AS venue, count(*) AS count FROM (SELECT DISTINCT conference, year, title, coalesce(label, k) AS k FROM mentions LEFT JOIN canonical ON k = surface) GROUP BY ALL),
kept AS (SELECT topic FROM labcube GROUP BY topic HAVING sum(count) >= 10),
phrases AS (SELECT topic AS phrase, topic FROM kept UNION SELECT surface, label FROM canonical WHERE label IN (SELECT topic FROM kept)),
w AS (SELECT paper, conference, year, string_split(trim(regexp_replace(regexp_replace(replace(replace(lower(title), '-', ' '), '_', ' '), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM main),
grams AS (SELECT DISTINCT paper, conference, year, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM w, unnest(range(1, len(w) + 1)) a(i), unnest([1, 2, 3, 4, 5]) b(n) WHERE i + n - 1 <= len(w)),
tcube AS (SELECT topic, year, venue, count(*) AS count FROM (SELECT DISTINCT paper, year, conference AS venue, topic FROM grams JOIN phrases USING (phrase)) GROUP BY ALL)"""


@query(f"{_TITLES} SELECT * FROM tcube")
def title_ngram_cube(spark: SparkSession, d: str) -> DataFrame:
    return R.title_cube(spark, d)


_ROBUST = """{0}shares AS (SELECT topic, year, count, n_venues, total, count / total AS share FROM (
    SELECT topic, year, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT CASE WHEN count > 0 THEN venue END) AS n_venues FROM {1} GROUP BY topic, year)
  JOIN (SELECT year, CAST(sum(count) AS BIGINT) AS total FROM {1} GROUP BY year) USING (year)),
{0}thresholds AS (SELECT coalesce(min(share) FILTER (count >= 3), max(share)) AS scale_low, max(share) AS scale_high, coalesce(min(share) FILTER (count >= 3), max(share)) AS visible, coalesce(min(share) FILTER (count >= 3), max(share)) AS recency_min
  FROM {0}shares WHERE year = 2021),
{0}""" + _wide(range(2017, 2026)).replace("FROM shares", "FROM {0}shares") + """,
{0}evaluated AS (SELECT *, recency AND acceleration AND spread AND scale AS predicted_positive, base > 0 AND peak >= 1.1 * base AS exploded FROM (
  SELECT topic, """ + _criteria(2022) + """, v2022 AS base, greatest(v2023, v2024, v2025) AS peak, visible FROM {0}wide, {0}thresholds))"""


@query(f"""{_TITLES}, {_ROBUST.format("l", "labcube")}, {_ROBUST.format("t", "tcube")},
m AS (SELECT topic, predicted_positive AS p0, exploded AS e0 FROM levaluated WHERE base >= visible), b AS (SELECT * FROM m JOIN tevaluated USING (topic)),
c AS (SELECT {CONFUSION}, coalesce(string_agg(topic, '; ' ORDER BY topic) FILTER (p0 AND predicted_positive), '') AS flags, coalesce(string_agg(topic, '; ' ORDER BY topic) FILTER (p0 AND e0 AND predicted_positive AND exploded), '') AS tps FROM b)
SELECT *, "TP" / greatest("TP" + "FP", 1) AS precision, "TP" / greatest("TP" + "FN", 1) AS recall, ("TP" + "FN") / nullif("N", 0) AS base, (SELECT count(*) FROM m WHERE p0) AS main_flags FROM c""")
def robustness_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The label cube's backtest against the title cube's, each with thresholds of its own."""
    return R.robustness(spark, d)


_LISTED = ", ".join("'" + p.replace("'", "''") + "'" for p in K.VOCABULARY)


@query(f"""WITH v AS (SELECT DISTINCT ON (n) regexp_replace(lower(p), '[\\s\\-]+', ' ', 'g') AS n, p, i FROM (SELECT unnest([{_LISTED}]) AS p, generate_subscripts([{_LISTED}], 1) AS i) ORDER BY n, i)
SELECT c_custkey, coalesce((SELECT string_agg(p, '; ' ORDER BY length(n) DESC, i) FROM v WHERE contains(regexp_replace(lower('deep reinforcement learning for ' || c_mktsegment || ' point-cloud registration with slam'), '[\\s\\-]+', ' ', 'g'), n)), '') AS keywords FROM customer""")
def vocab_match(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("deep reinforcement learning for "), "c_mktsegment", F.lit(" point-cloud registration with slam"))
    return T.table(spark, d, "customer").select("c_custkey", F.array_join(K.vocabulary_match(title), "; ").alias("keywords"))


_STOP = ", ".join(f"'{w}'" for w in sorted({*K.GENERIC, *K.COMMON_FREQUENT}))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM documents WHERE length(trim(text)) >= 10),
g AS (SELECT doc_id, CASE WHEN n = 1 THEN 1 ELSE 0 END AS kind, n, i, w[i:i + n - 1] AS g FROM w, unnest(range(1, len(w) + 1)) a(i), unnest([1, 2, 3]) b(n) WHERE i + n - 1 <= len(w)),
p AS (SELECT doc_id, kind, array_to_string(g, ' ') AS phrase, count(*) AS c, min((3 - n) * 100000000 + i) AS pos FROM g WHERE NOT list_has_any(g, [{_STOP}]) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY c DESC, pos) AS place FROM p),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, place) AS i FROM r WHERE place <= 15),
t AS (SELECT *, len(string_split(phrase, ' ')) AS size FROM l WHERE i <= 15),
k AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.doc_id = b.doc_id AND a.phrase <> b.phrase AND contains(b.phrase, a.phrase) AND (b.size > a.size OR (b.size = a.size AND b.i < a.i))))
SELECT d.doc_id, coalesce(string_agg(phrase, '; ' ORDER BY size DESC, i), '') AS keywords FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""")
def frequency_keywords(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", K.frequent_phrases(F.col("text")).alias("keywords"))


# --- series ------------------------------------------------------------------------


@query(f"WITH {PAPERS} SELECT year, conference, count(*) AS papers FROM main GROUP BY ALL")
def papers_by_year_venue(spark: SparkSession, d: str) -> DataFrame:
    return C.papers_by(L.main_track(T.papers(spark, d)), "year", "conference")


@query(f"WITH {PAPERS} SELECT conference, count(*) AS papers, count(*) / (SELECT count(*) FROM main) AS share FROM main GROUP BY conference")
def venue_shares(spark: SparkSession, d: str) -> DataFrame:
    return V.venue_shares(L.main_track(T.papers(spark, d)))


@query(f"{TEXT} SELECT conference, k, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conference ORDER BY count DESC, k) AS INT) AS rank FROM (SELECT conference, k, count(*) AS count FROM mentions GROUP BY ALL)) WHERE rank <= 10")
def top_per_venue(spark: SparkSession, d: str) -> DataFrame:
    return L.top_labels(R.mentions(spark, d), 10, ["conference"])


_GRID = ", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in _Y)


def _top_grid(n: int) -> str:
    return f"{TEXT} SELECT k, {_GRID} FROM mentions WHERE k IN (SELECT k FROM mentions GROUP BY k ORDER BY count(*) DESC, k LIMIT {n}) GROUP BY k"


@query(_top_grid(15))
def heatmap_top15(spark: SparkSession, d: str) -> DataFrame:
    return V.top_by_year(R.mentions(spark, d), 15)


@query(_top_grid(5))
def top5_over_years(spark: SparkSession, d: str) -> DataFrame:
    return V.top_by_year(R.mentions(spark, d), 5)


@query(_top_grid(30))
def top30_by_year(spark: SparkSession, d: str) -> DataFrame:
    return V.top_by_year(R.mentions(spark, d), 30)


_VENUE_GRID = TEXT + ", r AS (SELECT conference, k FROM (SELECT conference, k, row_number() OVER (PARTITION BY conference ORDER BY n DESC, k) AS place FROM (SELECT conference, k, count(*) AS n FROM mentions GROUP BY conference, k)) WHERE place <= {0}) SELECT conference, k, " + _GRID + " FROM mentions JOIN r USING (conference, k) GROUP BY conference, k"


@query(_VENUE_GRID.format(12))
def venue_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return V.top_by_year(R.mentions(spark, d), 12, ["conference"])


@query(_VENUE_GRID.format(25))
def venue_top25_clean(spark: SparkSession, d: str) -> DataFrame:
    return V.top_by_year(R.mentions(spark, d, "t5"), 25, ["conference"])


@query(f"WITH {PAPERS}, y AS (SELECT year, count(*) AS papers FROM main GROUP BY year) SELECT a.year, a.papers, coalesce(b.papers, 0) AS before FROM y a LEFT JOIN y b ON b.year = a.year - 1")
def total_growth(spark: SparkSession, d: str) -> DataFrame:
    return V.growth(L.main_track(T.papers(spark, d)))


@query(f"{TEXT} SELECT conference, k, count(*) FILTER (year = 2017) AS first_count, count(*) FILTER (year = 2025) AS last_count FROM mentions WHERE year IN (2017, 2025) GROUP BY conference, k")
def first_vs_last(spark: SparkSession, d: str) -> DataFrame:
    return V.first_and_last(R.mentions(spark, d), 2017, 2025)


@query(f"{TEXT} SELECT year, count(*) FILTER (contains(k, 'gear') OR contains(k, 'hot')) AS mentions FROM mentions GROUP BY year")
def mentions_any_of(spark: SparkSession, d: str) -> DataFrame:
    return V.matching(R.mentions(spark, d), V.any_of(["gear", "hot"]))


@query(f"{TEXT} SELECT year, count(*) FILTER (k = 'small gear') AS mentions FROM mentions WHERE conference = 'ASIA' GROUP BY year")
def label_in_venue(spark: SparkSession, d: str) -> DataFrame:
    return V.matching(R.mentions(spark, d).where("conference = 'ASIA'"), F.col("k") == "small gear")


@query(f"{TEXT} SELECT class, count(*) AS mentions FROM (SELECT CASE WHEN contains(k, 'gear') THEN 'gears' WHEN contains(k, 'ring') OR contains(k, 'small') THEN 'rings' WHEN contains(k, 'o') THEN 'other' END AS class FROM mentions) WHERE class IS NOT NULL GROUP BY class")
def three_way_case(spark: SparkSession, d: str) -> DataFrame:
    return V.classified(R.mentions(spark, d), [("gears", ["gear"]), ("rings", ["ring", "small"]), ("other", ["o"])])


@query(f"{TEXT} SELECT k, count(*) AS count, (contains(k, 'small') AND contains(k, 'g')) OR contains(k, 'ring') AS highlight FROM mentions GROUP BY k ORDER BY count DESC, k LIMIT 12")
def highlighted_top12(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return V.highlighted(R.mentions(spark, d), 12, (k.contains("small") & k.contains("g")) | k.contains("ring"))


@query(f"""{TEXT}, t AS (SELECT k FROM mentions GROUP BY k ORDER BY count(*) DESC, k LIMIT 5), h AS (SELECT year, count(*) AS n FROM mentions WHERE k IN (SELECT k FROM t) GROUP BY year)
SELECT year, coalesce(n, 0) AS mentions, papers, coalesce(n, 0) / papers AS ratio FROM (SELECT year, count(*) AS papers FROM main GROUP BY year) LEFT JOIN h USING (year)""")
def consolidation_top5(spark: SparkSession, d: str) -> DataFrame:
    return V.consolidation(R.mentions(spark, d), L.main_track(T.papers(spark, d)), 5)


@query(f"{TEXT} SELECT k, count(*) AS count FROM mentions WHERE length(k) > 1 GROUP BY k ORDER BY count DESC, k LIMIT 100")
def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return V.word_frequencies(R.mentions(spark, d), 100)


_VECTOR = "'[' || concat_ws(',', " + ", ".join(f"count(*) FILTER (year = {y})" for y in _Y) + ") || ']'"
_TOP15 = f"SELECT k, {_VECTOR} AS v FROM mentions WHERE k IN (SELECT k FROM mentions GROUP BY k ORDER BY count(*) DESC, k LIMIT 15) GROUP BY k"
_OBJECT = """'{{' || string_agg('"' || {0} || '":' || {1}, ',' ORDER BY {2}) || '}}'"""


@query(f"{TEXT} SELECT {_OBJECT.format('k', 'v', 'k')} AS document FROM ({_TOP15})")
def figure_document(spark: SparkSession, d: str) -> DataFrame:
    return V.figure_document(V.top_by_year(R.mentions(spark, d), 15))


_VENUES = ("AFRICA", "ASIA", "EUROPE", "NOWHERE")
_OWN = {"mentions_gear": "contains(k, 'gear')", "mentions_gear_asia": "contains(k, 'gear') AND conference = 'ASIA'", "mentions_ring": "contains(k, 'ring')"}
_WANTED = ["blue anvil", "small gear", "no such label"]


@query(f"""{TEXT}, v AS (SELECT unnest([{', '.join(f"'{x}'" for x in _VENUES)}]) AS venue, generate_subscripts([{', '.join(f"'{x}'" for x in _VENUES)}], 1) AS i),
l AS (SELECT unnest([{', '.join(f"'{x}'" for x in _WANTED)}]) AS label, generate_subscripts([{', '.join(f"'{x}'" for x in _WANTED)}], 1) AS i),
byvenue AS (SELECT venue, i, '[' || concat_ws(',', {', '.join(f'count(paper) FILTER (year = {y})' for y in _Y)}) || ']' AS v FROM v LEFT JOIN main ON conference = venue GROUP BY venue, i),
bylabel AS (SELECT label, i, '[' || concat_ws(',', {', '.join(f'count(k) FILTER (year = {y})' for y in _Y)}) || ']' AS v, count(k) FILTER (conference = 'ASIA') AS n FROM l LEFT JOIN mentions ON k = label GROUP BY label, i),
tops AS (SELECT conference, {_OBJECT.format('k', 'c', 'c DESC, k')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY conference ORDER BY c DESC, k) AS place FROM (SELECT conference, k, count(*) AS c FROM mentions WHERE conference IN {_VENUES} GROUP BY ALL)) WHERE place <= 3 GROUP BY conference)
SELECT '{{"years":[{','.join(map(str, _Y))}],"papers_per_year":' || (SELECT {_VECTOR} FROM main) || ',"papers_per_year_by_venue":' || (SELECT {_OBJECT.format('venue', 'v', 'i')} FROM byvenue)
  {' '.join(f"""|| ',"{n}":' || (SELECT {_VECTOR} FROM mentions WHERE {w})""" for n, w in _OWN.items())}
  || ',"labels":' || (SELECT {_OBJECT.format('label', 'v', 'i')} FROM bylabel) || ',"top_labels":' || (SELECT {_OBJECT.format('k', 'v', 'k')} FROM ({_TOP15}))
  || ',"totals":' || (SELECT {_OBJECT.format('label', 'n', 'i')} FROM bylabel) || ',"top_per_venue":' || (SELECT {_OBJECT.format('conference', 'v', 'conference')} FROM tops) || '}}' AS document""")
def published_figures(spark: SparkSession, d: str) -> DataFrame:
    phrases = [("mentions_gear", "gear", None), ("mentions_gear_asia", "gear", "ASIA"), ("mentions_ring", "ring", None)]
    return V.published_figures(L.main_track(T.papers(spark, d)), R.mentions(spark, d), _VENUES, phrases, _WANTED, ("ASIA", _WANTED), per_venue=3)


@query(f"WITH {PAPERS} SELECT count(*) FILTER (conference = 'ASIA') AS papers, count(*) FILTER (conference <> 'ASIA') AS others, count(*) FILTER (conference = 'ASIA') / count(*) AS share FROM main WHERE year = 2025")
def share_of_one_venue(spark: SparkSession, d: str) -> DataFrame:
    return V.share_of(L.main_track(T.papers(spark, d)), "ASIA", 2025)


@query(f"WITH {PAPERS} SELECT DISTINCT year FROM main WHERE year BETWEEN 2019 AND 2025")
def years_with_papers(spark: SparkSession, d: str) -> DataFrame:
    return V.year_list(L.main_track(T.papers(spark, d)), 2019, 2025)


@query(f"WITH {PAPERS}, {ALL_MENTIONS} SELECT k, count(*) AS count FROM found WHERE regexp_matches(k, 'gear|^hot') GROUP BY k ORDER BY count DESC, k LIMIT 20")
def excluded_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.top_labels(R.mentions(spark, d, "t3").where(F.col("k").rlike("gear|^hot")), 20)


# --- scalar functions --------------------------------------------------------------


@query("SELECT page_id, regexp_replace(replace(url, '://', ':/'), '^(https?):/([^/])', '\\1://\\2') AS url FROM pages")
def url_repair(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return T.table(spark, d, "pages").select("page_id", X.repair_url(F.replace(url, F.lit("://"), F.lit(":/"))).alias("url"))


@query("SELECT doc_id, regexp_replace(text || chr(1) || 'x', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g') AS text FROM documents")
def sanitise_text(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", X.sanitise(F.concat("text", F.lit("\x01x"))).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS bare, json_extract_string(props, '$.k') AS wrapped FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit('{"k": {"value": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return T.table(spark, d, "events").select("event_id", N.note_value(F.col("props"), "k").alias("bare"), N.note_value(wrapped, "k").alias("wrapped"))


# The queries of what is fetched, read, written and extracted.
from trendloom import catalog_files, catalog_sources  # noqa: E402, F401
