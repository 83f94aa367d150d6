"""Abstracts from web pages by the layout of each site, and filling of what is missing."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from trendloom.functions import dom
from trendloom.functions import text as X
from trendloom.sources import tables


@dataclass(frozen=True)
class Place:
    """Where a page may hold its abstract.

    ``kind`` is "css" (tag, all classes in value), "id" (its id is value),
    "class" or "any id" (value is part of it, in any case), "heading" (what follows
    the first of the tags whose text is value) or "heading has" (holds value).
    ``least`` is the least length of an abstract there, else the site's.
    """

    kind: str
    tags: tuple[str, ...]
    value: str
    least: int | None = None


@dataclass(frozen=True)
class Site:
    """The places of a site, tried in order, with the least length of an abstract and a cap; ``raw`` leaves the text as it is."""

    places: tuple[Place, ...]
    least: int = 30
    cap: int | None = None
    raw: bool = False


_BY_CLASS = Place("class", ("div",), "abstract")
# Parts of a URL, and the layout of the pages there; the first part that a URL holds counts.
SITES = {
    "aclanthology.org": Site((Place("css", ("div",), "card-body acl-abstract"), Place("class", ("div",), "acl-abstract"))),
    "thecvf.com": Site((Place("id", ("div",), "abstract"), _BY_CLASS)),
    "proceedings.mlr.press": Site((Place("heading", ("h4", "h3"), "abstract"), _BY_CLASS)),
    "nips.cc": Site((Place("css", ("p",), "paper-abstract"), Place("heading has", ("h4", "h3", "h2"), "abstract"), _BY_CLASS)),
    "neurips.cc": Site((Place("css", ("p",), "paper-abstract"), Place("heading has", ("h4", "h3", "h2"), "abstract"), _BY_CLASS)),
    "openreview.net": Site((Place("css", ("div",), "note-content-value"), Place("css", ("div",), "markdown-content")), least=60, cap=8000),
}
# The older layouts, which take the text as it is, and after a heading at any length.
OLDER_SITES = {
    "thecvf.com": Site((Place("any id", ("div", "section"), "abstract"), Place("class", ("div", "section"), "abstract"), Place("heading has", ("h2", "h3", "h4"), "abstract", 1)), least=31, raw=True),
    "aclanthology.org": Site((_BY_CLASS, Place("heading has", ("h2", "h3"), "abstract", 1)), least=31, raw=True),
    "proceedings.mlr.press": Site((Place("heading", ("h4", "h3"), "abstract", 1), _BY_CLASS), least=51, raw=True),
    "papers.nips.cc": Site((Place("heading", ("h4", "h3"), "abstract", 1), _BY_CLASS), least=51, raw=True),
}


def _found(root: dom.Element, place: Place) -> Iterator[dom.Element]:
    value = place.value.lower()
    for e in root.all(*place.tags):
        if place.kind == "css" and set(place.value.split()) <= set(e.classes) or place.kind == "id" and e["id"] == place.value:
            yield e
        elif place.kind == "class" and any(value in c.lower() for c in e.classes) or place.kind == "any id" and value in e["id"].lower():
            yield e
        elif place.kind.startswith("heading"):
            own = e.text("").lower()
            if own == value or (place.kind == "heading has" and value in own):
                following = e.after()
                if following is not None:
                    yield following
                return  # the first such heading decides


def clean(text: str) -> str:
    """One blank for each run of white space; a leading "abstract" and its punctuation go."""
    text = re.sub(r"\s+", " ", text.strip())
    return text[len("abstract") :].lstrip(" :.-").strip() if text.lower().startswith("abstract") else text


def site_of(url: Column, sites: Mapping[str, Site] = SITES) -> Column:
    """The first listed part that the repaired URL holds, or null."""
    return X.let(F.lower(X.repair_url(X.strip(url))), lambda low: F.coalesce(*[F.when(low.contains(part), part) for part in sites]))


def abstract_of(url: str | None, html: str | None, sites: Mapping[str, Site] = SITES) -> str | None:
    site = next((s for part, s in sites.items() if part in (url or "").lower()), None)
    if site is None or not html:
        return None
    root = dom.parse(html)
    for place in site.places:
        for e in _found(root, place):
            raw = e.text()
            text = raw if site.raw else clean(raw)
            if (len(raw) if site.cap else len(text)) >= (site.least if place.least is None else place.least):
                return text[: site.cap]
    return None


def page_candidates(url: Column) -> Column:
    """Addresses at which the page of a paper's URL may be: web pages instead of PDF files, with and without a closing slash."""
    return X.let(X.repair_url(X.strip(url)), lambda u: X.let(site_of(u), lambda site: _candidates(u, site)))


def _candidates(u: Column, site: Column) -> Column:
    acl = F.regexp_replace(u, r"\.pdf$", "")
    cvf = F.when(F.lower(u).endswith(".pdf"), F.regexp_replace(F.regexp_replace(u, r"(?i)_paper\.pdf$", "_paper.html"), "/papers/", "/html/")).otherwise(u)
    pmlr = F.when(u.endswith(".html"), u).otherwise(F.concat(F.regexp_replace(u, "/+$", ""), F.lit(".html")))
    return (
        F.when(site == "aclanthology.org", F.array_distinct(F.array(acl, F.concat(F.regexp_replace(acl, "/+$", ""), F.lit("/")))))
        .when(site == "thecvf.com", F.array(cvf))
        .when(site == "proceedings.mlr.press", F.array(pmlr))
        .when(site.isNotNull(), F.array(u))
        .otherwise(F.array().cast("array<string>"))
    )


def abstracts(pages: DataFrame, sites: Mapping[str, Site] = SITES) -> DataFrame:
    """pages with the column ``found``: the abstract by the layout of the site in the URL, or null."""
    sites = dict(sites)

    @F.pandas_udf("string")
    def found(url: pd.Series, html: pd.Series) -> pd.Series:
        return pd.Series([abstract_of(u, h, sites) for u, h in zip(url, html, strict=True)], dtype=object)

    return pages.withColumn("found", found("url", "html"))


def first_abstract(response: Column, least: int = 30) -> Column:
    """Of a title search's JSON response, the first hit's abstract that is long enough; or null."""
    hits = F.from_json(F.get_json_object(response, "$.data"), "array<struct<title:string,abstract:string>>")
    usable = F.filter(F.transform(hits, lambda h: X.strip(h["abstract"])), lambda a: F.length(a) >= least)
    return F.get(usable, F.lit(0))


def _stem(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def _joined(rows: DataFrame, key: Column, more: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """rows with what more has under the key, if anything.

    Rows without a key would all go to one task.  They are dealt out by a hash of
    their columns; the second condition lets them meet nothing.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name in columns and isinstance(f.dataType, (StringType, NumericType))]
    spread = F.concat(F.lit("\0"), F.xxhash64(F.lit(0), *plain).cast("string"))
    keyed = rows.withColumn("__key", key).withColumn("__dealt", F.coalesce("__key", spread))
    return keyed.join(more, (F.col("__dealt") == F.col(name)) & F.col("__key").isNotNull(), "left").drop("__key", "__dealt", name)


def fill_missing(papers: DataFrame, pages: DataFrame, searches: DataFrame | None = None, limit: int | None = None, order: Sequence[str] = ("conference", "year", "title"), sites: Mapping[str, Site] = SITES, least: int = 30) -> DataFrame:
    """papers with ``abstract`` filled where it is missing or short, and ``abstract_from``: 'own', 'html', 's2', 'empty' or 'not tried'.

    pages (url, html) are the fetched pages, looked up by ``page_candidates`` in
    their order; searches (title, response) the responses of a title search, asked
    for titles of 12 characters and more where no page helps.  With ``limit`` only
    the first so many of the missing by ``order``, then by the whole row, are
    tried.  Rows stay, repeated ones too.
    """
    rows = papers if "abstract" in papers.columns else papers.withColumn("abstract", F.lit(""))
    columns = rows.columns
    missing = ~X.has_abstract(F.col("abstract"), least)
    rows, later = rows.withColumn("__own", ~missing), None
    if limit is not None:
        every = rows.where(missing)
        tried = every.orderBy(*order, *(F.col(f"`{c}`") for c in columns)).limit(limit)
        later = every.exceptAll(tried).drop("__own").withColumn("abstract_from", F.lit("not tried"))
        rows = rows.where(~missing).unionByName(tried)
    own = F.col("__own")
    url = F.col("openreview_url") if "openreview_url" in columns else F.lit(None).cast("string")
    # Candidates of a row differ by slashes at the end only, so that one join finds them all.
    made = abstracts(pages, sites).where("found IS NOT NULL").groupBy("url").agg(F.min("found").alias("found"))
    made = made.groupBy(_stem(F.col("url")).alias("__stem")).agg(F.map_from_entries(F.collect_list(F.struct("url", "found"))).alias("__made"))
    rows = rows.withColumn("__pages", F.when(~own, page_candidates(url)))
    rows = _joined(rows, _stem(F.get("__pages", F.lit(0))), made, "__stem", columns)
    html, s2 = F.coalesce(*[F.element_at("__made", F.get("__pages", F.lit(k))) for k in (0, 1)]), F.lit(None).cast("string")
    rows = rows.withColumn("__html", html).drop("__made", "__pages")
    html = F.col("__html")
    if searches is not None:
        hits = searches.select(X.strip(F.col("title")).alias("__title"), first_abstract(F.col("response"), least).alias("__s2")).where("__s2 IS NOT NULL").groupBy("__title").agg(F.min("__s2").alias("__s2"))
        title = X.strip(F.col("title"))
        rows, s2 = _joined(rows, F.when(~own & html.isNull() & (F.length(title) >= 12), title), hits, "__title", columns), F.col("__s2")
    source = F.when(own, "own").when(html.isNotNull(), "html").when(s2.isNotNull(), "s2").otherwise("empty")
    out = rows.select(*[F.when(own, F.col("abstract")).otherwise(F.coalesce(html, s2, F.col("abstract"))).alias(c) if c == "abstract" else F.col(f"`{c}`") for c in columns], source.alias("abstract_from"))
    return out if later is None else out.unionByName(later)


def _statistics(least: int) -> list[Column]:
    by = F.col("abstract_from")
    processed = by.isin("html", "s2", "empty")
    return [
        F.count_if(by != "own").alias("rows_missing_start"),
        F.count_if(processed).alias("rows_to_process"),
        F.count_if(by == "html").alias("filled_html"),
        F.count_if(by == "s2").alias("filled_s2"),
        F.count_if(processed & ~X.has_abstract(F.col("abstract"), least)).alias("still_missing"),
    ]


def fill_statistics(filled: DataFrame, least: int = 30) -> DataFrame:
    """One row: rows_missing_start, rows_to_process, filled_html, filled_s2, still_missing (of those processed)."""
    return filled.agg(*_statistics(least))


def write_filled(filled: DataFrame, path: str, least: int = 30) -> tuple[DataFrame, dict[str, int]]:
    """Replaces the table at path by filled, and returns it with the statistics, which are counted as its rows are written."""
    seen = Observation()
    table = tables.publish(filled.observe(seen, *_statistics(least)), path)
    return table, seen.get
