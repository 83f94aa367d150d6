"""Registered queries of notes, listing pages, abstracts, keywords, files and text functions."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.catalog import PAPERS
from trendloom.functions import text as X
from trendloom.operators import abstracts as A
from trendloom.operators import extractors, keywords, listings, merge, notes, phrases, titles
from trendloom.operators.cube import topic_year_shares
from trendloom.registry import query
from trendloom.scratch import shared_folder, written
from trendloom.sources import files, xlsx
from trendloom.sources import fixtures as T
from trendloom.streaming import cube
from trendloom.streaming.cube import windowed_counts

_BLANK = "'' AS abstract, '' AS \"TLDR\", '' AS keywords"

# --- notes -------------------------------------------------------------------------

_NOTE = """conference, year, conference || CASE WHEN year % 3 = 0 THEN '/Workshop/Gears' ELSE '' END AS venue, CASE WHEN year % 3 = 0 THEN 'workshop' ELSE 'main' END AS paper_type, {0} AS title, '' AS abstract,
  CASE paper % 3 WHEN 1 THEN 'short ' || paper WHEN 2 THEN 'brief ' || paper ELSE '' END AS "TLDR", coalesce(keywords, '') AS keywords,
  CASE WHEN paper % 3 = 0 THEN 'A B; C ' || paper ELSE '' END AS authors, CASE paper % 3 WHEN 1 THEN 'theory' WHEN 2 THEN 'vision' ELSE '' END AS track_or_subject_areas,
  CASE WHEN paper = 0 THEN '' ELSE strftime(make_timestamp(paper * 86400000000), '%Y-%m-%d') END AS submission_date,
  'https://openreview.net/forum?id=n' || paper AS openreview_url, '/pdf/' || paper AS pdf_url, 'n' || paper AS openreview_id, CASE WHEN paper = 0 THEN '' ELSE CAST(paper AS VARCHAR) END AS paper_number"""


@query(f"WITH {PAPERS} SELECT {_NOTE.format('title')} FROM papers")
def notes_to_papers(spark: SparkSession, d: str) -> DataFrame:
    rows = T.notes(spark, d).select("conference", "year", F.from_json("note", f"struct<{notes.N.NOTE}>").alias("n")).select("conference", "year", "n.*")
    venue = F.concat("conference", F.when(F.col("year") % 3 == 0, "/Workshop/Gears").otherwise(""))
    return notes.paper_rows(rows, F.col("year"), venue, F.col("conference"))


@query(f"WITH {PAPERS} SELECT 'n' || paper AS id FROM papers WHERE conference = 'ASIA' AND paper % 3 < 2")
def notes_of_venue(spark: SparkSession, d: str) -> DataFrame:
    return notes.of_venue(notes.parsed(T.notes(spark, d)), "ASIA").select("id")


_ACCEPTED = "SELECT CASE WHEN paper % 10 = 0 THEN 'o' ELSE 'n' END || paper AS id, 'n' || paper AS forum FROM papers WHERE paper % 5 IN (0, 2, 4)"


@query(f"WITH {PAPERS} {_ACCEPTED}")
def accepted_by_replies(spark: SparkSession, d: str) -> DataFrame:
    own = notes.parsed(T.notes(spark, d))
    return notes.accepted(own, own, notes.parsed(T.decisions(spark, d))).select("id", "forum")


@query(f"WITH {PAPERS} SELECT 'n' || paper AS id FROM papers WHERE paper % 4 < 2 AND paper % 5 = 3")
def accepted_by_decisions(spark: SparkSession, d: str) -> DataFrame:
    """No reply decides these submissions, so that the decision notes do."""
    undecided = notes.parsed(T.notes(spark, d).where("paper % 5 = 3"))
    return notes.accepted(undecided, None, notes.parsed(T.decisions(spark, d))).select("id")


def _anthology(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(v) for v in ("acl-long", "acl-srw", "emnlp-main", "acl-demos", "acl-workshop-x")]), (F.col("paper") % 5 + 1).cast("int"))
    old = F.concat(F.lit("P18-"), F.col("paper").cast("string"))
    key = F.when(F.col("paper") % 6 == 0, old).otherwise(F.concat(F.col("year").cast("string"), F.lit("."), kinds, F.lit("."), F.col("paper").cast("string")))
    people = F.array(F.struct(F.lit("Last").alias("last"), F.lit("First").alias("first")), F.struct(F.col("conference").alias("last"), F.lit("").alias("first")))
    return T.papers(spark, d).select(key.alias("id"), "title", F.concat(F.lit(" "), "title").alias("abstract"), people.alias("authors"), F.lit(None).cast("string").alias("pdf"), F.concat(F.lit("u"), F.col("paper").cast("string")).alias("url"))


_VOLUME = "['acl-long', 'acl-srw', 'emnlp-main', 'acl-demos', 'acl-workshop-x'][paper % 5 + 1]"
_ACL = """SELECT 'ACL' AS conference, year, 'ACL Anthology (' || year || '){1}' AS venue, '{2}' AS paper_type, title, title AS abstract, '' AS "TLDR", '' AS keywords, 'Last, First; ' || conference AS authors,
  '' AS track_or_subject_areas, '' AS submission_date, 'https://aclanthology.org/' || year || '.' || {0} || '.' || paper AS openreview_url, {3} AS pdf_url, year || '.' || {0} || '.' || paper AS openreview_id, '' AS paper_number
  FROM papers WHERE paper % 6 <> 0 AND paper % 5 {4}"""


@query(f"WITH {PAPERS} " + _ACL.format(_VOLUME, "", "main", "'u' || paper", "IN (0, 1, 3, 4)"))
def anthology_main(spark: SparkSession, d: str) -> DataFrame:
    return notes.anthology_papers(_anthology(spark, d))


@query(f"WITH {PAPERS} " + _ACL.format(_VOLUME, " Workshop/SRW/Demos", "workshop", "''", "IN (1, 3, 4)"))
def anthology_workshops(spark: SparkSession, d: str) -> DataFrame:
    return notes.anthology_papers(_anthology(spark, d), workshops=True)


# --- listing pages -----------------------------------------------------------------

_PLACE = "list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], conference)"


def _listed(conference: str, venue: str, authors: str, url: str, pdf: str, paper_id: str, prefix: int | None = 100, kind: str = "main") -> str:
    once = f"QUALIFY row_number() OVER (PARTITION BY year, title[:{prefix}] ORDER BY {_PLACE}, paper) = 1" if prefix else ""
    return f"""WITH {PAPERS} SELECT '{conference}' AS conference, year, {venue} AS venue, '{kind}' AS paper_type, title, '' AS abstract, '' AS "TLDR", '' AS keywords, {authors} AS authors,
  '' AS track_or_subject_areas, '' AS submission_date, {url} AS openreview_url, {pdf} AS pdf_url, {paper_id} AS openreview_id, '' AS paper_number FROM papers WHERE length(title) >= {{0}} {once}"""


_PMLR = ("ICML", "'ICML ' || year || ' (PMLR)'", "'Ann ' || paper || ', Bob'", "'https://proceedings.mlr.press/v7/p' || paper || '.html'", "'https://proceedings.mlr.press/v7/p' || paper || '/p' || paper || '.pdf'", "'p' || paper", 80)


@query(_listed(*_PMLR).format(10))
def pmlr_listing(spark: SparkSession, d: str) -> DataFrame:
    return listings.pmlr(T.listing(spark, d, "pmlr").withColumn("volume", F.lit(7)))


@query(_listed(*_PMLR).format(5))
def pmlr_listing_by_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return listings.pmlr(T.listing(spark, d, "pmlr paragraph").withColumn("volume", F.lit(7)), walk=False)


@query(_listed("CVPR", "'CVPR ' || year", "'Ann ' || paper || ', Bob'", "'https:/openaccess.thecvf.com/content_CVPR_' || year || '/html/P' || paper || '_paper.html'", "'https:/openaccess.thecvf.com/content_CVPR_' || year || '/papers/P' || paper || '_paper.pdf'", "'P' || paper").format(5))
def cvf_listing(spark: SparkSession, d: str) -> DataFrame:
    return listings.cvf(T.listing(spark, d, "day"))


@query(_listed("CVPR", "'CVPR ' || year", "'Ann ' || paper || ', Bob'", "'https:/openaccess.thecvf.com/content_cvpr_' || year || '/html/P' || paper || '_paper.html'", "'https:/openaccess.thecvf.com/content_cvpr_' || year || '/papers/P' || paper || '_paper.pdf'", "'P' || paper").format(5))
def cvf_listing_old(spark: SparkSession, d: str) -> DataFrame:
    return listings.cvf(T.listing(spark, d, "old"), "old")


@query(_listed("CVPR", "'CVPR ' || year", "'Ann ' || paper", "'https://openaccess.thecvf.com/content/CVPR' || year || '/html/P' || paper || '_paper.html'", "'https://openaccess.thecvf.com/content/CVPR' || year || '/papers/P' || paper || '_paper.pdf'", "'P' || paper").format(5))
def cvf_listing_new(spark: SparkSession, d: str) -> DataFrame:
    return listings.cvf(T.listing(spark, d, "new"), "new")


_CVF_WORKSHOP = "'https://openaccess.thecvf.com/content/w' || year || '/papers/P' || paper || '_paper.pdf'"


@query(_listed("CVPR", "'CVPR ' || year || ' Workshop'", "'Ann ' || paper", _CVF_WORKSHOP, _CVF_WORKSHOP, "'P' || paper", kind="workshop").format(5))
def cvf_workshops(spark: SparkSession, d: str) -> DataFrame:
    return listings.cvf(T.listing(spark, d, "workshop"), "workshop")


@query(_listed("NeurIPS", "'NeurIPS ' || year || ' (papers.nips.cc)'", "'Ann ' || paper", "'https://papers.nips.cc/paper/' || year || '/hash/' || paper || '-Abstract.html'", "'https://papers.nips.cc/paper/' || year || '/hash/' || paper || '.pdf'", "CAST(paper AS VARCHAR)").format(5))
def neurips_listing(spark: SparkSession, d: str) -> DataFrame:
    return listings.neurips(T.listing(spark, d, "neurips"))


@query(_listed("NeurIPS", "'NeurIPS ' || year || ' (papers.nips.cc)'", "'Ann ' || paper", "'https://papers.nips.cc/paper_files/paper/' || year || '/hash/' || paper || '-Abstract-Conference.html'", "'https://papers.nips.cc/paper_files/paper/' || year || '/hash/' || paper || '.pdf'", "CAST(paper AS VARCHAR)", None).format(5))
def neurips_listing_all(spark: SparkSession, d: str) -> DataFrame:
    return listings.neurips(T.listing(spark, d, "neurips all"), older=False)


@query(_listed("ACL", "'ACL Anthology (' || year || ')'", "''", "'https://aclanthology.org/' || year || '.acl-' || paper", "''", "year || '.acl-' || paper", None).format(5))
def acl_events(spark: SparkSession, d: str) -> DataFrame:
    return listings.acl_events(T.listing(spark, d, "acl"))


# --- abstracts ---------------------------------------------------------------------

_FOUND = "CASE WHEN paper % 7 <> 0 THEN 'we look at ' || title || ' in all of its forms and show what it is good for' WHEN paper % 5 = 2 THEN 'too late, but long enough to be taken for one' END"


@query(f"WITH {PAPERS} SELECT paper, {_FOUND} AS found FROM papers")
def site_abstracts(spark: SparkSession, d: str) -> DataFrame:
    return A.abstracts(T.site_pages(spark, d)).select("paper", "found")


def _to_fill(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = written(T.site_pages(spark, d), "site-pages")  # read three times: as papers, pages and searches
    p, n = F.col("paper"), F.col("paper").cast("string")
    own = F.when(p % 2 == 0, F.concat(F.lit("an abstract of its own that is long enough "), n)).when(p % 3 == 0, "nan").otherwise("")
    # Addresses as tables have them: of files, without a slash, with one slash too few.
    address = F.when(p % 5 == 0, F.concat(F.lit("https:/aclanthology.org/x"), n, F.lit(".pdf"))).when(p % 5 == 1, F.concat(F.lit("https:/openaccess.thecvf.com/papers/x"), n, F.lit("_paper.pdf"))).when(p % 5 == 2, F.concat(F.lit("https://proceedings.mlr.press/v7/x"), n)).otherwise(F.col("url"))
    papers = pages.select("paper", "conference", "year", F.concat("title", F.lit(" "), n).alias("title"), address.alias("openreview_url"), own.alias("abstract"))
    response = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("title"), F.lit(None).cast("string").alias("abstract")), F.struct(F.lit("t").alias("title"), F.concat(F.lit("  found by a search for its title: "), n).alias("abstract"))).alias("data")))
    searches = papers.where("paper % 7 = 0 AND paper % 11 <> 0").select("title", response.alias("response"))
    return papers, pages.select("url", "html"), searches


_FILLED = f"""f AS (SELECT paper, paper % 2 = 0 AS own, {_FOUND} AS html, CASE WHEN paper % 7 = 0 AND paper % 11 <> 0 AND length(title || ' ' || paper) >= 12 THEN 'found by a search for its title: ' || paper END AS s2 FROM papers),
  filled AS (SELECT paper, CASE WHEN own THEN 'an abstract of its own that is long enough ' || paper ELSE coalesce(html, s2, CASE WHEN paper % 3 = 0 THEN 'nan' ELSE '' END) END AS abstract,
    CASE WHEN own THEN 'own' WHEN html IS NOT NULL THEN 'html' WHEN s2 IS NOT NULL THEN 's2' ELSE 'empty' END AS abstract_from FROM f)"""


@query(f"WITH {PAPERS}, {_FILLED} SELECT * FROM filled")
def abstracts_filled(spark: SparkSession, d: str) -> DataFrame:
    return A.fill_missing(*_to_fill(spark, d)).select("paper", "abstract", "abstract_from")


@query(f"""WITH {PAPERS}, {_FILLED} SELECT count(*) FILTER (abstract_from <> 'own') AS rows_missing_start, count(*) FILTER (abstract_from <> 'own') AS rows_to_process,
  count(*) FILTER (abstract_from = 'html') AS filled_html, count(*) FILTER (abstract_from = 's2') AS filled_s2, count(*) FILTER (abstract_from = 'empty') AS still_missing FROM filled""")
def abstracts_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.fill_statistics(A.fill_missing(*_to_fill(spark, d)))


# --- keywords ----------------------------------------------------------------------


@query(f"""WITH {PAPERS}, w AS (SELECT paper, string_split(title, ' ') AS w FROM papers),
g AS (SELECT DISTINCT paper, array_to_string(w[i:least(i + 3, len(w))], ' ') AS p FROM w, unnest(range(2, len(w) + 1)) a(i) WHERE len(w) > i),
n AS (SELECT paper, p, row_number() OVER (PARTITION BY paper ORDER BY length(p), p) AS i FROM g WHERE length(p) > 4),
c AS (SELECT a.paper, a.p, a.i, min(b.i) AS gone FROM n a LEFT JOIN n b ON a.paper = b.paper AND b.i > a.i AND contains(b.p, a.p) GROUP BY ALL),
r AS (SELECT paper, i, i - sum(coalesce(m, 0)) OVER (PARTITION BY paper ORDER BY i) AS kept FROM c LEFT JOIN (SELECT paper, gone AS i, count(*) AS m FROM c GROUP BY ALL) USING (paper, i)),
e AS (SELECT paper, coalesce(min(i) FILTER (kept >= 14), 1000000) AS last FROM r GROUP BY paper)
SELECT p.paper, coalesce(string_agg(c.p, '; ' ORDER BY c.i) FILTER (c.i <= e.last AND coalesce(c.gone, 1000001) > e.last), '') AS keywords FROM papers p LEFT JOIN c ON p.paper = c.paper LEFT JOIN e ON p.paper = e.paper GROUP BY p.paper""")
def title_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every title; the SQL says from which phrase on fourteen are kept, and which of these lie within others by then."""
    return T.papers(spark, d).select("paper", titles.from_titles(F.col("title")).alias("keywords"))


_GENERIC = ", ".join(f"'{w}'" for w in [*keywords.GENERIC, *keywords.COMMON])
_CUES = " OR ".join(f"contains(s, '{c}')" for c in keywords.METHOD_CUES)
_RUNS = f"""(SELECT paper, part, 3 - n AS o, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM {{0}}, unnest(range(1, len(w) + 1)) a(i), unnest([3, 2, 1]) b(n)
  WHERE i + n - 1 <= len(w) AND NOT list_has_any(w[i:i + n - 1], [{_GENERIC}]) AND length(array_to_string(w[i:i + n - 1], ' ')) >= 4)"""


@query(f"""WITH {PAPERS}, t AS (SELECT paper, title, title || ' . We propose ' || title || '. It is ' || conference || '! Then we show gears' AS x FROM papers),
s AS (SELECT paper, part, lower(s) AS s FROM t, unnest(regexp_split_to_array(x, '[.!?]\\s+')) WITH ORDINALITY u(s, part)),
ms AS (SELECT paper, part, regexp_extract_all(s, '[a-z0-9]+') AS w FROM s WHERE {_CUES}),
ts AS (SELECT paper, 1 AS part, regexp_extract_all(lower(string_agg(s, ' ' ORDER BY part) FILTER (part <= 2) || ' ' || any_value(title)), '[a-z0-9]+') AS w FROM s JOIN t USING (paper) GROUP BY paper),
m AS (SELECT paper, p, row_number() OVER (PARTITION BY paper ORDER BY part, o, i) AS place FROM (SELECT paper, p, min((part, o, i)) AS f, min(part) AS part, 0 AS o, 0 AS i FROM {_RUNS.format('ms')} GROUP BY paper, p)),
mf AS (SELECT paper, p, row_number() OVER (PARTITION BY paper ORDER BY f) AS place FROM (SELECT paper, p, min(part * 1000000 + o * 100000 + i) AS f FROM {_RUNS.format('ms')} GROUP BY paper, p)),
tf AS (SELECT paper, p, row_number() OVER (PARTITION BY paper ORDER BY f) AS place FROM (SELECT paper, p, min(o * 100000 + i) AS f FROM {_RUNS.format('ts')} r WHERE NOT EXISTS (SELECT 1 FROM mf WHERE mf.paper = r.paper AND mf.p = r.p AND mf.place <= 7) GROUP BY paper, p)),
a AS (SELECT paper, 'Topic: ' || string_agg(p, '; ' ORDER BY place) AS k FROM tf WHERE place <= 7 GROUP BY paper), b AS (SELECT paper, 'Methods: ' || string_agg(p, '; ' ORDER BY place) AS k FROM mf WHERE place <= 7 GROUP BY paper)
SELECT t.paper, concat_ws(' ', a.k, b.k) AS keywords FROM t LEFT JOIN a USING (paper) LEFT JOIN b USING (paper)""")
def topic_and_methods(spark: SparkSession, d: str) -> DataFrame:
    abstract = F.concat(F.lit("We propose "), "title", F.lit(". It is "), "conference", F.lit("! Then we show gears"))
    return T.papers(spark, d).select("paper", keywords.topic_and_methods(F.col("title"), abstract).alias("keywords"))


@query(f"""SELECT CAST('0x' || md5(w)[:8] AS BIGINT) % {extractors.CELLS} AS cell, count(*) AS n
  FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) AS w FROM documents) GROUP BY cell""")
def word_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sketch of how many documents have each word."""
    return extractors.cell_counts(T.table(spark, d, "documents"))


@query()
def extracted_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Key phrases of whole documents by the built-in extractor, its words weighed by all documents."""
    docs = T.table(spark, d, "documents")
    weights = extractors.word_weights(docs)
    return docs.select("doc_id", keywords.phrases_by(None, F.col("text"), keywords.GENERIC_SHORT, excluded=keywords.EXCLUDED, by_text=True, weights=weights).alias("keywords"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n], ' ') AS phrase FROM w, unnest([0, 1, 2]) b(n), unnest(range(1, len(w) + 1)) a(i) WHERE i + n <= len(w)),
p AS (SELECT DISTINCT array_to_string(w[:2], ' ') AS phrase FROM w UNION SELECT DISTINCT array_to_string(w[i:i + 1], ' ') FROM w, unnest(range(1, len(w))) a(i) UNION SELECT DISTINCT p_name FROM part)
SELECT phrase, count(*) AS documents FROM g JOIN p USING (phrase) WHERE phrase <> '' GROUP BY phrase""")
def phrases_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each name of a part and each pair of words that any document has, between blanks."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    docs = T.table(spark, d, "documents").select("doc_id", words.alias("w"))
    pairs = docs.select(F.explode(F.concat(F.array(F.array_join(F.slice("w", 1, 2), " ")), X.runs(F.col("w"), 2))).alias("phrase"))
    listed = pairs.union(T.table(spark, d, "part").select("p_name")).distinct()
    return phrases.matches(docs, F.array_join("w", " "), listed, ["doc_id"], whole_words=True).groupBy("phrase").agg(F.count("*").alias("documents"))


_SHORT = "'Topic: ' || paper || ' gearboxes; ' || CASE WHEN paper >= 1000 THEN paper || '; ' ELSE '' END || 'gearboxes'"


@query(f"WITH {PAPERS} SELECT paper, CASE WHEN length(coalesce(keywords, '')) >= 10 THEN keywords WHEN paper % 2 = 0 THEN {_SHORT} ELSE coalesce(keywords, '') END AS keywords FROM papers")
def enriched_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Short keywords by the cascade, from a short abstract that even papers have."""
    short = F.when(F.col("paper") % 2 == 0, F.concat(F.lit("the new "), F.col("paper").cast("string"), F.lit(" gearboxes"))).otherwise("")
    rows = T.papers(spark, d).select("paper", F.lit("").alias("title"), short.alias("abstract"), "keywords")
    return keywords.enriched(rows).select("paper", "keywords")


# --- files and text functions ------------------------------------------------------


@query(f"WITH {PAPERS} SELECT title || ' <&> ' || chr(228) AS title, CAST(paper AS VARCHAR) AS paper, CAST(NULL AS VARCHAR) AS absent, keywords FROM papers")
def spreadsheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """All papers as workbooks that the tasks make of their rows, and the columns wanted read back by ranges of rows."""
    rows = T.papers(spark, d).select("paper", "year", F.concat("title", F.lit(" <&> ä")).alias("title"), "conference", "keywords")
    books = written(xlsx.workbooks(rows), "workbooks")
    parts = [xlsx.parsed(books, ["title", "paper", "absent", "keywords"], k=k, ranges=4) for k in range(4)]
    return functools.reduce(DataFrame.unionByName, parts)


@query("""SELECT page_id, url || '/v12/P7-Abstract.html' AS page, url || '/v12/P7.pdf' AS file, 'P7' AS id, '12' AS volume, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x' AS rooted, 'https://h.org/b/x' AS relative, 'https://h.org/x' AS cross,
  regexp_replace(url, '[^A-Za-z0-9_\\-]', '_', 'g') AS safe, url[:28] AS label FROM pages""")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    page = F.concat(url, F.lit("/v12/P7-Abstract.html"))
    root = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    rows = T.table(spark, d, "pages").select("page_id", page.alias("page"), X.pdf_of(page).alias("file"), X.paper_id_of(page).alias("id"), X.volume_of(page).alias("volume"), X.absolute_url(F.concat(root, F.lit("/x")), "https://h.org/b").alias("rooted"))
    return rows.join(T.table(spark, d, "pages").select("page_id", X.absolute_url(F.lit("x"), "https://h.org/b").alias("relative"), X.absolute_url(F.lit("/x"), "https://h.org/b").alias("cross"), X.file_safe(url).alias("safe"), X.axis_label(url).alias("label")), "page_id")


@query("""SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-2Nd ' || CASE WHEN c_custkey % 2 = 0 THEN 'Class' ELSE 'Row' END AS cased, printf('%.1f%%', c_custkey / 7) AS pct, format('{:,}', c_custkey * 1001) AS thousands,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || ', ' || c_name END AS person, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE c_mktsegment || '. ' || repeat(c_name || ' ', 3) || 'x' END AS doc,
  CASE c_custkey % 4 WHEN 0 THEN 2000 + c_custkey % 100 WHEN 1 THEN 1990 + c_custkey % 40 END AS id_year, len(regexp_split_to_array('a. b! ' || c_name || '? c', '[.!?]\\s+')) AS n_sentences,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'about ' END || c_name || ' did it' AS abstract, c_name || CASE WHEN c_custkey % 2 = 0 THEN '|AB' || c_custkey % 10 ELSE '' END AS parts,
  CAST(CAST('1970-01-01' AS DATE) + CAST(c_custkey % 20000 AS INT) AS VARCHAR) AS day FROM customer""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of texts and numbers on columns of customers, in each of the forms that they tell apart."""
    n, segment, k, none = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"), F.lit(None).cast("string")
    even, text = k % 2 == 0, lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    acl = F.when(k % 4 == 0, text("P", F.lpad((k % 100).cast("string"), 2, "0"), "-1001")).when(k % 4 == 1, text((1990 + k % 40).cast("string"), ".acl-long.", k.cast("string"))).otherwise(text("W19-", k.cast("string")))
    return T.table(spark, d, "customer").select(
        "c_custkey",
        X.title_case(text(segment, "-2nd ", F.when(even, "CLASS").otherwise("row"))).alias("cased"),
        X.percent(k / 700).alias("pct"),
        X.grouped(k * 1001).alias("thousands"),
        F.when(k % 3 == 0, X.last_first(n, none)).otherwise(X.last_first(segment, n)).alias("person"),
        X.document(text(" ", segment, " "), F.when(k % 4 == 1, "NaN").otherwise(text(F.repeat(text(n, " "), F.lit(3)), "x"))).alias("doc"),
        X.year_of_acl_id(acl).alias("id_year"),
        F.size(X.sentences(text("a. b! ", n, "? c"))).cast("long").alias("n_sentences"),
        X.clean_abstract(text(F.when(even, " Abstract: -  ").otherwise(" about\n"), n, "\n did   it ")).alias("abstract"),
        F.array_join(X.split_abbreviation(text(n, F.when(even, text(" (AB", (k % 10).cast("string"), ")")).otherwise(""))), "|").alias("parts"),
        X.date_of_millis(k % 20_000 * 86_400_000 + 86_399_999).alias("day"),
    )


@query(f"WITH {PAPERS} SELECT year, conference, '' AS venue, 'main' AS paper_type, title FROM papers")
def aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.with_defaults(T.papers(spark, d).select("title", "conference", "year"), venue="", paper_type="none", title="never").withColumn("paper_type", F.lit("main"))
    return merge.kept_in_order(rows, ["year", "conference", "absent", "venue", "paper_type", "title"])


@query(f"WITH {PAPERS} SELECT lpad(CAST(year AS VARCHAR), 6, ' ') || ' ' || rpad(conference, 12, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 8, ' ') AS line FROM papers GROUP BY year, conference")
def console_table(spark: SparkSession, d: str) -> DataFrame:
    return files.console_rows(T.papers(spark, d).groupBy("year", "conference").count(), {"year": 6, "conference": 12, "count": 8})


@query("SELECT event_type AS topic, date_trunc('day', ts) AS start, count(*) AS count FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming cube's counts over a table that has ended."""
    return windowed_counts(T.table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT event_type AS topic, CAST(month(ts) AS INT) AS year, 'u' || user_id % 7 AS venue, count(*) AS count FROM events GROUP BY ALL),
a AS (SELECT topic, year, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT venue) AS n_venues FROM c WHERE topic IS NOT NULL AND year IS NOT NULL GROUP BY topic, year)
SELECT topic, year, count, n_venues, CAST(sum(count) OVER (PARTITION BY year) AS BIGINT) AS total, count / sum(count) OVER (PARTITION BY year) AS share FROM a""")
def kept_cube_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares by event type and month of the cube that a stream over the events keeps, run until it has read them all."""
    path = f"{shared_folder(spark)}/trendloom/{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    rows = lambda e: e.select(F.col("event_type").alias("topic"), F.month("ts").alias("year"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("venue"))
    source = f"{d}/events.parque[t]"  # a pattern matches a file as well as a folder
    stream = spark.readStream.schema(T.table(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(source)
    cube.keep_cube(rows(stream), f"{path}/cube", f"{path}/checkpoint", every=2, availableNow=True).awaitTermination()
    return topic_year_shares(cube.read_kept(spark, f"{path}/cube"))
