"""Readers and writers; paths may be on any store that Spark reads."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.schema import CUBE, EVALUATION, PAPER, PAPER_COLUMNS
from trendloom.sources import xlsx
from trendloom.sources.tables import _at, replaced


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or any path of a pattern, is there."""
    store, at = _at(spark, path)
    found = store.globStatus(at)
    return found is not None and len(found) > 0


def resolved(spark: SparkSession, *inputs: str | Sequence[str]) -> list[str]:
    """Of each input, a path or a list of alternatives, the first that exists; inputs that are missing are left out."""
    out = []
    for i in inputs:
        out += next(([p] for p in ([i] if isinstance(i, str) else i) if exists(spark, p)), [])
    return out


def required(spark: SparkSession, *paths: str) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def read_papers(spark: SparkSession, *inputs: str | Sequence[str], columns: Sequence[str] = PAPER_COLUMNS) -> DataFrame:
    """Papers of CSV files with a header or, by suffix, Parquet or spreadsheets, each with the column ``source``, its place in the order of inputs.

    An input may be a list of alternatives.  Missing inputs are left out, as are
    files that cannot be read; only the stated columns are read.  Absent columns
    are null, years that are no numbers too.
    """
    kinds = {f.name: f.dataType for f in PAPER.fields}
    parts = []
    for k, i in enumerate(inputs):
        for p in resolved(spark, i):
            suffix = p.rstrip("/").rsplit(".", 1)[-1].lower()
            if suffix == "xlsx":
                part = xlsx.read(spark, p, columns, skip_bad=True)
            else:
                reader = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
                try:
                    # By the files' own header, so that the order of columns does not matter; the sample is of names only.
                    part = reader.parquet(p) if suffix == "parquet" else reader.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
                except AnalysisException:
                    continue  # no column can be made out: an empty or broken file
            own = [F.col(f"`{c}`") if c in part.columns else F.lit(None) for c in columns]
            cast = lambda v, c: v.cast("string").try_cast("double").try_cast("int") if c == "year" else v.cast(kinds.get(c, "string"))
            parts.append(part.select(*[cast(v, c).alias(c) for v, c in zip(own, columns, strict=True)], F.lit(k).alias("source")))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` {kinds[c].simpleString() if c in kinds else 'string'}" for c in columns) + ", source int")
    return functools.reduce(DataFrame.unionByName, parts)


LEDGER = "path string, source int, rows long, bad long, error string"


def read_ledger(spark: SparkSession, *inputs: str | Sequence[str]) -> DataFrame:
    """path, source, rows, bad, error of every file that ``read_papers`` would read: what was read of it, and what could not be.

    bad counts the rows of a CSV file whose fields are more or fewer than its
    header's; error says why a file gave no rows at all, and is null otherwise.
    Inputs that are missing have a row with the error "missing".
    """
    parts = []
    own = lambda c: F.regexp_replace(c, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")  # noqa: E731  stores spell the same place in several ways
    for k, i in enumerate(inputs):
        paths = resolved(spark, i)
        for p in paths:
            suffix = p.rstrip("/").rsplit(".", 1)[-1].lower()
            there = spark.createDataFrame(_listed(spark, p), "path string, length long")
            if suffix == "xlsx":
                read = xlsx.row_counts(spark, p)
            else:
                read = _row_counts(spark, p, suffix)
            none = F.when(F.col("length") == 0, "empty").otherwise("no row could be read")
            found = there.join(read.withColumnRenamed("path", "__path"), own("path") == own("__path"), "left")
            rows = F.coalesce("rows", F.lit(0).cast("long"))
            parts.append(found.select("path", F.lit(k).alias("source"), rows.alias("rows"), F.coalesce("bad", F.lit(0).cast("long")).alias("bad"), F.coalesce("error", F.when(rows == 0, none)).alias("error")))
        if not paths:
            parts.append(spark.createDataFrame([(i if isinstance(i, str) else ", ".join(i), k, 0, 0, "missing")], LEDGER))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LEDGER)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of the files at a path, a folder or a pattern; empty files, which Spark's readers pass over, too."""
    store, at = _at(spark, path)
    out = []
    for s in store.globStatus(at):
        if s.isDirectory():
            found = store.listFiles(s.getPath(), True)
            while found.hasNext():
                f = found.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append((f.getPath().toString(), f.getLen()))
        else:
            out.append((s.getPath().toString(), s.getLen()))
    return out


def _row_counts(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, rows, bad, error of the files at path that give rows."""
    reader, file = spark.read.option("ignoreCorruptFiles", True), F.col("_metadata.file_path").alias("path")
    none = F.lit(None).cast("string").alias("error")
    try:
        if suffix == "parquet":
            return reader.parquet(path).select(file).groupBy("path").agg(F.count("*").alias("rows")).select("path", "rows", F.lit(0).cast("long").alias("bad"), none)
        csv = lambda r: r.option("header", True).option("multiLine", True).option("escape", '"')
        names = csv(reader).csv(path).columns
        if not names:
            return spark.createDataFrame([], "path string, rows long, bad long, error string")
        kind = ", ".join(f"`{c}` string" for c in names)
        # The column of broken records is filled only where the others are read, too.
        rows = csv(reader).option("columnNameOfCorruptRecord", "__broken").schema(f"{kind}, __broken string").csv(path)
        read = rows.select(file, (F.col("__broken").isNotNull() & (F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in names])) >= 0)).alias("broken"))
        return read.groupBy("path").agg(F.count("*").alias("rows"), F.count_if("broken").alias("bad")).select("path", "rows", "bad", none)
    except AnalysisException as e:
        return spark.createDataFrame([], "path string, rows long, bad long, error string") if "infer" in str(e).lower() else spark.createDataFrame([(path, 0, 0, str(e)[:200])], "path string, rows long, bad long, error string")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUBE).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


# The names in the document of thresholds, and those that the signature takes.
THRESHOLDS = {"SCALE_LOW_SHARE": "scale_low", "SCALE_HIGH_SHARE": "scale_high", "MIN_VISIBLE_SHARE": "visible", "RECENCY_MIN_SHARE": "recency_min", "ACCEL_RATIO": "accel", "SPREAD_MIN_VENUES": "min_venues", "EXPLOSION_RELATIVE_SHARE": "explosion", "_explosion_raw_quantile_estimate": "explosion_estimate", "_explosion_calib_n": "explosion_n"}


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """One row from the flat JSON document of thresholds, under the names that the signature takes."""
    rows = spark.read.option("multiLine", True).schema(", ".join(f"{k} double" for k in THRESHOLDS)).json(path)
    return rows.select(*[F.col(k).alias(v) for k, v in THRESHOLDS.items()])


def threshold_document(thresholds: DataFrame) -> DataFrame:
    """The row of thresholds under the document's names."""
    return thresholds.select(*[F.col(v).alias(k) for k, v in THRESHOLDS.items() if v in thresholds.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each; quotes within a value are doubled, as the readers here and elsewhere take them."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str) -> None:
    """The one column of a report, a line a row in the order of df."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """The one row of a report as a flat document, a file of any store that replaces a former one in one step."""
    row = df.first()
    replaced(df.sparkSession, path, [json.dumps(row.asDict(recursive=True) if row else {}, indent=2).encode()])


def write_chart(document: str, path: str) -> None:
    """A chart's document as a file of any store."""
    replaced(SparkSession.active(), path, [document.encode()])


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column ``line`` with the named columns as a row of a LaTeX table."""
    text = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("--")), "([&%_#$])", r"\\$1") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *text), F.lit(" \\\\")).alias("line"))


def console_rows(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """A column ``line`` with the named columns set to widths: numbers to the right, texts to the left."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "float")}
    cell = lambda c, w: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("--")), w, " ") if c in numbers else F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("--")), w, " ")
    return df.select(F.concat_ws(" ", *[cell(c, w) for c, w in widths.items()]).alias("line"))


def chart(df: DataFrame, mark: str, x: str, y: str, colour: str | None = None) -> str:
    """A chart of a bounded series as a Vega-Lite document, which browsers and notebooks draw; of at most 5,000 rows."""
    rows = [r.asDict() for r in df.limit(5001).collect()]
    if len(rows) > 5000:
        raise ValueError("a chart takes 5,000 rows at most")
    axes = {"x": {"field": x, "type": "ordinal"}, "y": {"field": y, "type": "quantitative"}} | ({"color": {"field": colour, "type": "nominal"}} if colour else {})
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": mark, "data": {"values": rows}, "encoding": axes}, default=str)
