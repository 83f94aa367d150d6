"""Papers from the listing pages of proceedings: anchors with what stands around them, then each site's rules.

Pages are supplied as rows (year, page, html): page is the place of a page among
those of its listing.  One Python pass makes rows of the anchors of each page;
all rules are column expressions on them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from trendloom.functions import dom
from trendloom.functions import text as X
from trendloom.schema import PAPER_COLUMNS
from trendloom.session import small_batches

#: What is known of a link, by name; a site's rules ask for the last six as they need them.
FIELDS = {"at": "int", "href": "string", "text": "string", "lines": "array<string>", "paragraph": "string", "parent": "string", "next": "string", "block": "array<string>", "shelf": "int"}
#: Links, and characters of all that is known of them, that a task gathers before it hands them on.
MOST_LINKS, MOST_CHARS = 1000, 4_000_000
# Words of lines that are no titles.
NO_TITLE = ("Proceedings of", "PMLR", "Filter")


def _paper_block(link: dom.Element, seen: dict[int, list[str]], most: int = 8) -> list[str]:
    """Lines of the nearest of the ancestors that looks like a paper: a title first, and later a line that names the proceedings."""
    for _, block in zip(range(most), link.ancestors(), strict=False):
        if (own := seen.get(id(block))) is None:
            lines = block.lines()
            unlike = len(lines) < 2 or len(lines[0]) < 10 or any(w in lines[0] for w in (*NO_TITLE, "Download PDF")) or lines[0].startswith("[")
            # Many links share their outer blocks, which are read once a page.
            own = seen[id(block)] = lines if not unlike and any("PMLR" in x or "Proceedings of" in x for x in lines[1:]) else []
        if own:
            return own
    return []


def _anchors(page: str | None, fields: Sequence[str]) -> Iterator[list]:
    """Of each link its place, address and text, and the fields."""
    root = dom.parse(page)
    shelves = {id(e): k for k, e in enumerate(e for e in root.all("span") if "d-block" in e.classes)} if "shelf" in fields else {}
    blocks: dict[int, list[str]] = {}
    made = {
        "lines": lambda a, text: near.lines() if (near := a.within("p", "div")) else [],
        "paragraph": lambda a, text: near.text() if (near := a.within("p", "div")) else "",
        "parent": lambda a, text: a.parent.text() if a.parent else "",
        "next": lambda a, text: following.text("") if (following := a.after()) else "",
        # An abstract's link looks for its paper's block; for others that is never asked.
        "block": lambda a, text: _paper_block(a, blocks) if text == "abs" else [],
        "shelf": lambda a, text: next((shelves[id(e)] for e in a.ancestors() if id(e) in shelves), None),
    }
    asked = [made[f] for f in fields]
    for at, a in enumerate(e for e in root.all("a") if "href" in e.attributes):
        text = "".join(x for x in a.walk() if isinstance(x, str)).strip()
        yield [at, a["href"].strip(), text, *(f(a, text) for f in asked)]


def anchors(pages: DataFrame, *fields: str) -> DataFrame:
    """A row for each link of each page: the page's columns but html, the link's place, address and text, and the fields.

    Links leave a task in small batches, so that what it holds depends neither on the number of pages nor on that of their links.
    """
    small_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = ["at", "href", "text", *fields]
    schema = StructType(kept + [StructField(n, DataType.fromDDL(FIELDS[n])) for n in names])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.string()) if FIELDS[n].startswith("array") else pa.int32() if FIELDS[n] == "int" else pa.string() for n in names]

        def handed(own: pa.RecordBatch, rows: list[int], links: list[list]) -> pa.RecordBatch:
            arrays = [c.take(pa.array(rows, pa.int64())) for c in own.columns]
            arrays += [pa.array(column, kind) for column, kind in zip(zip(*links, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, *names])

        for batch in batches:
            own, html = batch.drop_columns(["html"]), batch.column("html")
            rows, links, chars = [], [], 0
            for k in range(len(html)):
                for link in _anchors(html[k].as_py(), fields):
                    rows.append(k)
                    links.append(link)
                    chars += sum(len(x) if isinstance(x, str) else sum(map(len, x)) for x in link if x and not isinstance(x, int))
                    if len(rows) >= MOST_LINKS or chars >= MOST_CHARS:
                        yield handed(own, rows, links)
                        rows, links, chars = [], [], 0
            if rows:
                yield handed(own, rows, links)

    return pages.mapInArrow(found, schema)


def first_of_title(rows: DataFrame, prefix: int) -> DataFrame:
    """Of rows that agree in year and the title's first characters, the first by page and place."""
    own = Window.partitionBy("year", F.substring("title", 1, prefix)).orderBy("page", "at")
    return rows.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth")


def _papers(rows: DataFrame, conference: str, venue: Column, **made: Column) -> DataFrame:
    made = {"conference": F.lit(conference), "year": F.col("year").cast("int"), "venue": venue, "paper_type": F.lit("main"), "title": F.col("title")} | made
    return rows.select(*[made.get(c, F.lit("")).alias(c) for c in PAPER_COLUMNS])


def _year(before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), F.col("year").cast("string"), F.lit(after))


def is_title(title: Column) -> Column:
    return (F.length(title) >= 5) & ~F.lower(title).contains("pdf") & ~F.lower(title).contains("supp")


def pmlr(pages: DataFrame, walk: bool = True) -> DataFrame:
    """Papers of volume pages (volume, year, page, html).

    With walk, links named "abs" tell a paper, whose block is looked for among the
    ancestors; else any link to a page of the volume, within its paragraph.
    """
    href, volume = F.col("href"), F.col("volume").cast("string")
    rows = anchors(pages, "block" if walk else "lines").where(F.contains(href, F.concat(F.lit("/v"), volume, F.lit("/"))) & href.endswith(".html") & ~href.contains("/assets/") & ~href.contains("index"))
    rows = rows.where("text = 'abs' AND size(block) > 0") if walk else rows.where(~F.contains("text", F.lit("Download PDF")))
    lines = F.col("block" if walk else "lines")
    rows = rows.withColumn("title", F.get(lines, F.lit(0)))
    rows = rows.where((F.length("title") >= 5) & ~F.expr(" OR ".join(f"contains(title, '{w}')" for w in NO_TITLE)))
    rest = F.slice(lines, F.lit(2), F.size(lines))
    names = lambda x: x.contains("Proceedings of") | x.contains("PMLR")
    if walk:
        # Lines up to the first in brackets; of these the one that names the proceedings begins with the authors.
        hit = F.get(F.filter(rest, lambda x: names(x) | x.startswith("[")), F.lit(0))
        line = F.when(names(hit), hit)
    else:
        head = F.get(rest, F.lit(0))
        line = F.when(~names(head) & ~head.startswith("["), head)
    authors = F.coalesce(F.when(line.contains(";"), X.strip(F.substring_index(line, ";", 1))).otherwise(line), F.lit(""))
    site = F.lit("https://proceedings.mlr.press")
    url = F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(site, F.lit("/v"), volume, F.lit("/"), href))
    base = F.replace(F.substring_index(url, "/", -1), F.lit(".html"), F.lit(""))
    pdf = F.concat(site, F.lit("/v"), volume, F.lit("/"), base, F.lit("/"), base, F.lit(".pdf"))
    return _papers(first_of_title(rows, 80), "ICML", _year("ICML ", " (PMLR)"), authors=authors, openreview_url=url, pdf_url=pdf, openreview_id=base)


CVF = "https://openaccess.thecvf.com"


def cvf(pages: DataFrame, layout: str = "day", base: Column | None = None) -> DataFrame:
    """Papers of the vision conference's pages (year, page, html).

    Layouts: "day" with links below content_CVPR_<year>, "old" below
    content_cvpr_<year>, "new" below /content/CVPR<year>, and "workshop" pages.
    In the first two a relative link is put after ``base`` and each // in it
    becomes one /, as the published tables have it; ``functions.text.repair_url`` undoes that.
    """
    href = F.col("href")
    prefix = {"day": _year("content_CVPR_"), "old": _year("content_cvpr_"), "new": _year("/content/CVPR"), "workshop": F.lit("")}[layout]
    rows = anchors(pages, "paragraph").withColumn("title", F.col("text"))
    rows = rows.where(F.contains(href, prefix) & href.rlike(r"_paper\.(html|pdf)") & is_title(F.col("title")))
    rooted = F.concat(F.lit(CVF), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href)))
    if layout in ("day", "old"):
        start = F.lit(CVF + "/") if base is None else base
        joined = F.concat(F.regexp_replace(start, "/+$", ""), F.lit("/"), F.regexp_replace(href, "^/+", ""))
        full = F.when(href.startswith("http"), href).otherwise(F.replace(joined, F.lit("//"), F.lit("/")))
    else:
        full = F.when(href.startswith("http"), href).otherwise(rooted)
    kind = F.lit("workshop" if layout == "workshop" else "main")
    venue = _year("CVPR ", " Workshop" if layout == "workshop" else "")
    return _papers(first_of_title(rows, 100), "CVPR", venue, paper_type=kind, authors=X.authors_after(F.col("paragraph"), F.col("title")), openreview_url=full, pdf_url=X.pdf_of(full), openreview_id=X.paper_id_of(href))


def day_links(pages: DataFrame, most: int = 5) -> DataFrame:
    """year, page, url: the first links of each year's main page that lead to a day's papers."""
    href, name = F.col("href"), _year("CVPR")
    rows = anchors(pages).where(F.contains(href, name) & href.contains("day="))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("year").orderBy("page", "at"))).where(F.col("nth") <= most)
    url = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(CVF + "/"), F.regexp_replace(href, "^/+", "")))
    return rows.select("year", (F.col("nth") - 1).alias("page"), url.alias("url"))


def workshop_links(pages: DataFrame, most: int = 80) -> DataFrame:
    """year, page, url: the first workshops that each year's menu names, each once."""
    base = _year("CVPR", "_workshops")
    parts = F.split(F.regexp_replace(F.replace(F.col("href"), F.lit(CVF), F.lit("")), "^/+|/+$", ""), "/")
    rows = anchors(pages).where(F.contains("href", base) & ~F.col("href").contains("/menu") & (F.get(parts, F.lit(0)) == base) & (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != ""))
    first = rows.groupBy("year", F.get(parts, F.lit(1)).alias("path")).agg(F.min(F.struct("page", "at")).alias("place"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("year").orderBy("place"))).where(F.col("nth") <= most)
    return first.select("year", (F.col("nth") - 1).alias("page"), F.concat(F.lit(CVF + "/"), base, F.lit("/"), F.col("path")).alias("url"))


def neurips(pages: DataFrame, older: bool = True) -> DataFrame:
    """Papers of the yearly lists (year, page, html): the older lists, whose lines hold the authors, or all, where they follow the link."""
    href, year, site = F.col("href"), F.col("year").cast("string"), "https://papers.nips.cc"
    rows = anchors(pages, "next", *(["parent"] if older else [])).withColumn("title", F.col("text"))
    rows = rows.where(href.contains("Abstract" if older else "-Abstract-") & F.contains(href, year) & ~(href.contains("Datasets_and_Benchmarks") & ~href.contains("Conference")) & (F.length("title") >= 5))
    beside = F.regexp_replace(F.col("next"), "^_+|_+$", "")
    url = F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(site), href))
    venue = _year("NeurIPS ", " (papers.nips.cc)")
    if older:
        url = url.when(href.startswith("paper_files"), F.concat(F.lit(site + "/"), href)).otherwise(F.concat(F.lit(site + "/paper/"), year, F.lit("/"), href))
        at = F.instr(F.col("parent"), F.col("title"))
        rest = X.strip(F.substring(F.col("parent"), at + F.length("title"), F.length("parent")))
        authors = F.coalesce(F.nullif(F.when(at > 0, rest), F.lit("")), beside)
        return _papers(first_of_title(rows, 100), "NeurIPS", venue, authors=authors, openreview_url=url, pdf_url=X.pdf_of(url), openreview_id=X.paper_id_of(url))
    url = url.otherwise(F.concat(F.lit(site + "/paper_files/paper/"), year, F.lit("/"), href))
    ends = "|".join(e.replace(".", r"\.") for e in X.ABSTRACT_PAGES[1:])
    own = F.regexp_replace(F.substring_index(url, "/", -1), ends, "")
    pdf = F.regexp_replace(url, ends, ".pdf")
    pdf = F.when(pdf.endswith(".pdf"), pdf).otherwise(F.concat(F.regexp_replace(url, "/[^/]*$", "/"), own, F.lit(".pdf")))
    return _papers(rows, "NeurIPS", venue, authors=beside, openreview_url=url, pdf_url=pdf, openreview_id=own)


def acl_events(pages: DataFrame) -> DataFrame:
    """Papers of event pages (year, page, html): of each shelf the first link that leads to a paper, if it has a title."""
    first = Window.partitionBy("year", "page", "shelf").orderBy("at")
    rows = anchors(pages, "shelf").where(F.col("shelf").isNotNull() & F.col("href").rlike("^/[A-Z0-9]"))
    rows = rows.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").withColumn("id", F.regexp_replace("href", "^/+|/+$", "")).withColumn("title", F.col("text"))
    rows = rows.where((F.col("id") != "") & ~F.col("id").contains("/") & (F.length("title") >= 5))
    return _papers(rows, "ACL", _year("ACL Anthology (", ")"), openreview_url=F.concat(F.lit("https://aclanthology.org/"), F.col("id")), openreview_id=F.col("id"))
