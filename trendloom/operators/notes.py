"""Papers from review-site notes: accepted submissions by their replies, and notes as paper rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import notes as N
from trendloom.functions import text as X
from trendloom.schema import PAPER_COLUMNS


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """A dump of notes, a JSON object a line."""
    return spark.read.schema(N.NOTE).json(path)


def parsed(rows: DataFrame, column: str = "note") -> DataFrame:
    """Notes from a column of JSON texts."""
    return rows.select(F.from_json(column, f"struct<{N.NOTE}>").alias("n")).select("n.*")


def paper_rows(notes: DataFrame, year: Column, venue_id: Column, conference: Column) -> DataFrame:
    """A row of the paper table for each note."""
    c = F.col("content")
    forum = F.coalesce(F.nullif(F.col("forum"), F.lit("")), F.col("id"), F.lit(""))
    made = {
        "conference": conference,
        "year": year.cast("int"),
        "venue": venue_id,
        "paper_type": X.paper_type_of(venue_id),
        "title": N.text_of(c, "title"),
        "abstract": N.text_of(c, "abstract"),
        "TLDR": N.first_text(c, "TLDR", "tldr"),
        "keywords": N.first_list(c, "keywords", "keyword"),
        "authors": N.first_list(c, "authors"),
        "track_or_subject_areas": N.first_text(c, "track", "subject areas"),
        "submission_date": F.coalesce(F.when(F.col("tcdate") != 0, X.date_of_millis(F.col("tcdate"))), F.lit("")),
        "openreview_url": F.when(forum != "", F.concat(F.lit("https://openreview.net/forum?id="), forum)).otherwise(""),
        "pdf_url": N.file_of(c),
        "openreview_id": F.coalesce("id", F.lit("")),
        "paper_number": F.coalesce(F.nullif(F.col("number"), F.lit("0")), F.lit("")),
    }
    return notes.select(*[made[k].alias(k) for k in PAPER_COLUMNS])


def of_venue(notes: DataFrame, venue_id: str) -> DataFrame:
    """Notes whose content names the venue as theirs: the accepted ones of the newer interface."""
    return notes.where(N.text_of(F.col("content"), "venueid") == venue_id)


def _once(notes: DataFrame) -> DataFrame:
    """Of notes that repeat an id, the one with the least hash, whatever the order of rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in notes.columns])
    return notes.groupBy("id").agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias("__row")).select("__row.*")


def accepted_by_replies(submissions: DataFrame, use_original: bool = True) -> DataFrame:
    """Submissions with a direct reply that is a decision and says Accept; the original in place of a blind copy.

    Of submissions that repeat an id the one with the least hash is taken.
    """
    once = _once(submissions)
    hits = once.where(F.exists("details.directReplies", lambda r: N.is_decision(r) & N.is_accept(r["content"])))
    own = F.struct(*[F.col(c) for c in ("id", "forum", "number", "tcdate", "invitation", "content")])
    return hits.select((F.coalesce(F.col("details.original"), own) if use_original else own).alias("n")).select("n.*")


def accepted_by_decisions(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Submissions whose forum has a decision note that says Accept."""
    c = F.col("content")
    yes = decisions.where(F.contains(N.first_text(c, "decision", "Decision"), F.lit("Accept"))).select(F.col("forum").alias("id")).distinct()
    return _once(submissions).join(yes, "id", "left_semi").select("id", "forum", "number", "tcdate", "invitation", "content")


def _unless_any(first: DataFrame, then: DataFrame) -> DataFrame:
    """first, or then if first has no row; decided by one number within the plan."""
    n = first.agg(F.count("*").alias("__n"))
    return first.unionByName(then.crossJoin(F.broadcast(n)).where("__n = 0").drop("__n"))


def accepted(blind: DataFrame, single: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """Accepted submissions of a venue: by replies, else by decision notes, else the same of the submissions that are not blind."""

    def collected(submissions: DataFrame, use_original: bool) -> DataFrame:
        found = accepted_by_replies(submissions, use_original)
        return found if decisions is None else _unless_any(found, accepted_by_decisions(submissions, decisions))

    out = collected(blind, True)
    return out if single is None else _unless_any(out, collected(single, False))


def anthology_papers(dump: DataFrame, workshops: bool = False, first: int = 2017, last: int = 2025) -> DataFrame:
    """Paper rows of an anthology dump (id, title, abstract, authors array<struct<last, first>>, pdf, url).

    Main volumes of one venue, or its student workshops, demonstrations, tutorials
    and workshops.  Ids of the older form have a year but no volume and are left out.
    """
    year, volume = X.year_of_acl_id(F.col("id")), X.volume_of_acl_id(F.col("id"))
    rows = _once(dump).where(year.between(first, last) & (F.substring_index(volume, "-", 1) == "acl"))
    label = F.concat(F.lit("ACL Anthology ("), year.cast("string"), F.lit(")"))
    pdf = F.coalesce(F.nullif(F.col("pdf"), F.lit("")), F.lit("") if workshops else F.col("url"), F.lit(""))
    if workshops:
        rows = rows.where(~volume.isin("acl-main", "acl-long", "acl-short") & (volume.rlike("^acl-(srw|demos|tutorials)") | volume.contains("workshop")))
        label = F.concat(label, F.lit(" Workshop/SRW/Demos"))
    made = {
        "conference": F.lit("ACL"),
        "year": year,
        "venue": label,
        "paper_type": F.lit("workshop" if workshops else "main"),
        "title": F.coalesce("title", F.lit("")),
        "abstract": X.strip(F.coalesce("abstract", F.lit(""))),
        "authors": F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<struct<last:string,first:string>>")), lambda a: X.last_first(a["last"], a["first"])), "; "),
        "openreview_url": F.concat(F.lit("https://aclanthology.org/"), F.col("id")),
        "pdf_url": pdf,
        "openreview_id": F.col("id"),
    }
    return rows.select(*[made.get(k, F.lit("")).alias(k) for k in PAPER_COLUMNS])
