"""Registered queries of tables written to files in the library's formats and read again, and of labels that filters keep."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.catalog import BASE, PAPERS
from trendloom.operators import abstracts as A
from trendloom.operators import keywords, titles
from trendloom.operators import signature as S
from trendloom.plans import reports as R
from trendloom.registry import ORACLES, query
from trendloom.scratch import shared_folder
from trendloom.sources import files, tables, xlsx
from trendloom.sources import fixtures as T


def _folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/trendloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(ORACLES["cube_counts"])
def cube_file(spark: SparkSession, d: str) -> DataFrame:
    """The cube written as CSV and read with its schema."""
    path = _folder(spark, "cube")
    files.write_csv(T.cube(spark, d).select("topic", "year", "venue", "count"), path)
    return files.read_cube(spark, path)


@query(f"{BASE} SELECT topic, predicted_positive, exploded, recency, acceleration, spread, scale FROM backtest")
def evaluation_file(spark: SparkSession, d: str) -> DataFrame:
    """The backtest written as CSV and read with its flags as booleans."""
    path = _folder(spark, "evaluation")
    files.write_csv(R.backtest(spark, d).select("topic", "predicted_positive", "exploded", "recency", "acceleration", "spread", "scale"), path)
    return files.read_evaluation(spark, path)


@query(f"""SELECT "SCALE_LOW_SHARE" AS scale_low, "SCALE_HIGH_SHARE" AS scale_high, "MIN_VISIBLE_SHARE" AS visible, "RECENCY_MIN_SHARE" AS recency_min, "ACCEL_RATIO" AS accel, CAST("SPREAD_MIN_VENUES" AS DOUBLE) AS min_venues,
  "EXPLOSION_RELATIVE_SHARE" AS explosion, "_explosion_raw_quantile_estimate" AS explosion_estimate, CAST("_explosion_calib_n" AS DOUBLE) AS explosion_n FROM ({ORACLES['threshold_document']})""")
def threshold_file(spark: SparkSession, d: str) -> DataFrame:
    """The frozen thresholds written as a flat JSON document and read under the names that the signature takes."""
    path = f"{_folder(spark, 'thresholds')}.json"
    rows = files.threshold_document(S.threshold_row(R.shares(spark, d), R.RULES))
    files.write_json_report(rows.withColumn("_explosion_raw_quantile_estimate", F.round("_explosion_raw_quantile_estimate", 8)), path)
    return files.read_thresholds(spark, path)


# --- inputs of several kinds -------------------------------------------------------


def _inputs(spark: SparkSession, d: str) -> list[str | list[str]]:
    """Papers as a folder of CSV, Parquet and a workbook of counts; alternatives, an input that is missing, and a workbook that is none."""
    at = _folder(spark, "inputs")
    p = F.col("paper")
    rows = T.papers(spark, d).withColumn("as_text", F.when(p % 5 == 0, F.concat(F.col("year").cast("string"), F.lit(".0"))).when(p % 5 == 1, "n/a").otherwise(F.col("year").cast("string")))
    named = rows.select(F.concat_ws(", ", F.lit('a "title"'), p.cast("string")).alias("title"), F.col("as_text").alias("year"), "conference", p.alias("unread"), "paper")
    files.write_csv(named.where(p % 2 == 0).drop("paper"), f"{at}/even.csv")
    named.where(p % 2 == 1).select("conference", "title", F.expr("try_cast(try_cast(year AS DOUBLE) AS INT)").alias("year")).write.parquet(f"{at}/odd.parquet")
    xlsx.write(rows.groupBy("conference", "year").agg(F.count("*").alias("title")).select("title", "conference", "year"), f"{at}/counts.xlsx")
    tables.replaced(spark, f"{at}/broken.xlsx", [b"no workbook"])
    return [f"{at}/missing.csv", f"{at}/even.csv", [f"{at}/missing.parquet", f"{at}/odd.parquet", f"{at}/even.csv"], f"{at}/counts.xlsx", f"{at}/broken.xlsx"]


_READ = """i AS (SELECT 'a "title", ' || paper AS title, CASE WHEN paper % 5 <> 1 THEN year END AS year, conference, CASE WHEN paper % 2 = 0 THEN 1 ELSE 2 END AS source FROM papers
  UNION ALL SELECT CAST(count(*) AS VARCHAR), year, conference, 3 FROM papers GROUP BY year, conference)"""


@query(f"WITH {PAPERS}, {_READ} SELECT title, year, conference, CAST(NULL AS VARCHAR) AS abstract, CAST(source AS INT) AS source FROM i")
def papers_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Papers of inputs of several kinds; years that are no numbers are null, inputs that are missing or broken left out."""
    return files.read_papers(spark, *_inputs(spark, d), columns=["title", "year", "conference", "abstract"])


@query(f"""WITH {PAPERS}, {_READ} SELECT CAST(source AS INT) AS source, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad, CAST(NULL AS VARCHAR) AS error FROM i GROUP BY source
  UNION ALL SELECT 0, 0, 0, 'missing' UNION ALL SELECT 4, 0, 0, 'BadZipFile: File is not a zip file'""")
def ledger_of_files(spark: SparkSession, d: str) -> DataFrame:
    """What was read of each of the same inputs, and why of some nothing was."""
    read = files.read_ledger(spark, *_inputs(spark, d))
    return read.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"), F.max("error").alias("error"))


# --- tables that are replaced, reports ---------------------------------------------


@query(f"WITH {PAPERS} SELECT conference, year, CAST(2 * count(*) AS BIGINT) AS papers, CAST(1 AS BIGINT) AS builds FROM papers GROUP BY conference, year")
def replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that is twice asked for and built once, then replaced by what is read from itself."""
    path, builds = _folder(spark, "table"), set()

    def build() -> DataFrame:
        return T.papers(spark, d).groupBy("conference", "year").agg(F.count("*").alias("papers"))

    for _ in range(2):
        tables.cached(spark, path, build)
        builds.add(tables.present(spark, path)["version"])
    now = tables.publish(tables.read(spark, path).withColumn("papers", 2 * F.col("papers")), path)
    return now.withColumn("builds", F.lit(len(builds)).cast("long"))


@query(f"WITH {PAPERS} SELECT conference || ': ' || count(*) || ' papers, ' || min(year) || ' to ' || max(year) AS line FROM papers GROUP BY conference")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    """A report's lines written as text, in their order, and read again."""
    path = _folder(spark, "summary")
    lines = T.papers(spark, d).groupBy("conference").agg(F.count("*").alias("n"), F.min("year").alias("a"), F.max("year").alias("b")).orderBy("conference")
    files.write_text(lines.select(F.format_string("%s: %d papers, %d to %d", "conference", "n", "a", "b").alias("line")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"""WITH {PAPERS} SELECT 'line' AS mark, 'year' AS x, 'papers' AS y, 'conference' AS colour, year, conference, CAST(count(*) AS BIGINT) AS papers FROM papers GROUP BY year, conference""")
def chart_file(spark: SparkSession, d: str) -> DataFrame:
    """The document of a chart of papers by year and venue, written and read as data."""
    path = f"{_folder(spark, 'chart')}.json"
    series = T.papers(spark, d).groupBy("year", "conference").agg(F.count("*").alias("papers"))
    files.write_chart(files.chart(series, "line", "year", "papers", "conference"), path)
    kind = "mark string, data struct<values: array<struct<year: int, conference: string, papers: bigint>>>, encoding struct<x: struct<field: string>, y: struct<field: string>, color: struct<field: string>>"
    read = spark.read.option("multiLine", True).schema(kind).json(path)
    return read.select("mark", F.col("encoding.x.field").alias("x"), F.col("encoding.y.field").alias("y"), F.col("encoding.color.field").alias("colour"), F.inline("data.values"))


@query(f"""WITH {PAPERS}, m AS (SELECT conference, k FROM (SELECT conference, trim(k) AS k FROM main, unnest(string_split(lower(keywords), ';')) t(k)) WHERE k <> '')
SELECT 'papers_per_year_per_venue' AS name, conference, CAST(year AS VARCHAR) AS k, count(*) AS count FROM main GROUP BY conference, year
UNION ALL SELECT * FROM (SELECT 'top_topics_overall', NULL, k, count(*) FROM m GROUP BY k ORDER BY count(*) DESC, k LIMIT 10)
UNION ALL SELECT 'top_topics_per_venue', conference, k, n FROM (SELECT conference, k, count(*) AS n FROM m GROUP BY conference, k) QUALIFY row_number() OVER (PARTITION BY conference ORDER BY n DESC, k) <= 10""")
def summary_files(spark: SparkSession, d: str) -> DataFrame:
    """The three summary tables written as CSV, read again as one."""
    folder = _folder(spark, "summaries")
    R.write_summaries(spark, d, folder)
    read = {n: spark.read.option("header", True).csv(f"{folder}/{n}") for n in ("papers_per_year_per_venue", "top_topics_overall", "top_topics_per_venue")}
    parts = [t.select(F.lit(n).alias("name"), (F.col("conference") if "conference" in t.columns else F.lit(None).cast("string").alias("conference")), F.col("k" if "k" in t.columns else "year").alias("k"), F.col("count" if "count" in t.columns else "papers").cast("long").alias("count")) for n, t in read.items()]
    return functools.reduce(DataFrame.unionByName, parts)


# --- older pages, phrases ----------------------------------------------------------


@query(f"""WITH {PAPERS} SELECT paper, CASE paper % 4 WHEN 0 THEN CASE WHEN length(title) >= 31 THEN title END WHEN 1 THEN CASE WHEN length(title) >= 31 THEN title END
  WHEN 2 THEN title WHEN 3 THEN CASE WHEN length(title) >= 51 THEN title END END AS found FROM papers""")
def older_site_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts of the older layouts: by any id, by class, after a heading at any length, by class with a higher least length."""
    p, n = F.col("paper"), F.col("paper").cast("string")
    text = lambda before, after: F.concat(F.lit(before), "title", F.lit(after))
    layouts = [
        ("https://openaccess.thecvf.com/x", text('<section id="theAbstract">', "</section>")),
        ("https://aclanthology.org/x", text('<div class="card acl-abstract">', "</div>")),
        ("https://proceedings.mlr.press/v7/x", text("<h4>Abstract</h4><div>", "</div>")),
        ("https://papers.nips.cc/x", text('<p class="title">no</p><div class="wide abstracts">', "</div>")),
    ]
    url = html = F.lit(None).cast("string")
    for k, (start, page) in enumerate(layouts):
        url, html = F.when(p % 4 == k, F.concat(F.lit(start), n)).otherwise(url), F.when(p % 4 == k, page).otherwise(html)
    return A.abstracts(T.papers(spark, d).select("paper", url.alias("url"), html.alias("html")), A.OLDER_SITES).select("paper", "found")


_LISTED = ", ".join(f"'{p}'" for p in titles.KNOWN)


@query(f"""WITH {PAPERS}, v AS (SELECT [{_LISTED}] AS v), t AS (SELECT paper, title || ' ' || v[paper % len(v) + 1] || ' for ' || upper(v[paper * 7 % len(v) + 1]) AS title FROM papers, v),
k AS (SELECT p, i, trim(regexp_replace(lower(p), '[\\s\\-]+', ' ', 'g')) AS n FROM v, unnest(v) WITH ORDINALITY u(p, i))
SELECT t.paper, string_agg(p, '; ' ORDER BY length(n) DESC, i) AS found FROM t JOIN k ON contains(trim(regexp_replace(lower(t.title), '[\\s\\-]+', ' ', 'g')), n) GROUP BY t.paper""")
def known_title_phrases(spark: SparkSession, d: str) -> DataFrame:
    """All known phrases of titles, longest first, by built-in functions."""
    p, listed = F.col("paper"), F.array(*[F.lit(v) for v in titles.KNOWN])
    at = lambda k: F.element_at(listed, (k % len(titles.KNOWN) + 1).cast("int"))
    title = F.concat("title", F.lit(" "), at(p), F.lit(" for "), F.upper(at(p * 7)))
    return T.papers(spark, d).select("paper", F.array_join(keywords.vocabulary_match(title, titles.KNOWN, len(titles.KNOWN), 5), "; ").alias("found"))


_STOP = ", ".join(f"'{w}'" for w in keywords.GENERIC_SHORT)


@query(f"""WITH {PAPERS}, p AS (SELECT paper, trim(p) AS p, i FROM papers, unnest(string_split(coalesce(keywords, ''), '; ') || [' SemEval-' || year || ' Task ' || paper, 'in ' || year, 'Model', title, string_split(title, ' ')[2], string_split(title, ' ')[2], '']) WITH ORDINALITY u(p, i)),
g AS (SELECT paper, p, lower(p) AS low, i, len(regexp_split_to_array(p, '\\s+')) AS w FROM p WHERE p <> '' AND NOT regexp_matches(p, '{keywords.EXCLUDED}')),
k AS (SELECT * FROM g WHERE w > 1 OR low NOT IN ({_STOP})),
f AS (SELECT * FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.paper = x.paper AND (y.w > x.w OR y.w = x.w AND y.p < x.p) AND y.low <> x.low AND contains(y.low, x.low)))
SELECT papers.paper, coalesce(string_agg(f.p, '; ' ORDER BY f.w DESC, f.p), '') AS kept FROM papers LEFT JOIN f ON papers.paper = f.paper GROUP BY papers.paper""")
def filtered_labels(spark: SparkSession, d: str) -> DataFrame:
    """What the filter of phrases keeps of keywords, contests, years, lone stop words, and phrases that lie within others or are repeated."""
    year, second = F.col("year").cast("string"), F.get(F.split("title", " "), 1)
    more = F.array(F.concat(F.lit(" SemEval-"), year, F.lit(" Task "), F.col("paper").cast("string")), F.concat(F.lit("in "), year), F.lit("Model"), F.col("title"), *[F.coalesce(second, F.lit(""))] * 2, F.lit(""))
    phrases = F.concat(F.split(F.coalesce("keywords", F.lit("")), "; "), more)
    return T.papers(spark, d).select("paper", F.array_join(keywords.filtered_phrases(phrases, keywords.GENERIC_SHORT), "; ").alias("kept"))
