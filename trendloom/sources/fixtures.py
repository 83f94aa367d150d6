"""The library's tables derived from the benchmark's star schema: a cube, papers, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period(date: str) -> Column:
    """Nine periods of nine months from 1995, as the years 2017 to 2025."""
    return (F.lit(2017) + F.least(F.lit(8), F.floor(((F.year(date) - 1995) * 12 + F.month(date) - 1) / 9))).cast("int")


def cube_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each mention: a topic is a part, a venue the supplier's region."""
    region = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", period("l_shipdate").alias("year"))
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("topic"), "year", F.col("r_name").alias("venue"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_rows(spark, sf_dir).groupBy("topic", "year", "venue").agg(F.count("*").alias("count"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper is an order; its keywords and title are the parts' names, its conference the customer's region."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("w"))
    words = words.select("l_orderkey", F.transform("w", lambda x: x["p_name"]).alias("w"))
    region = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = table(spark, sf_dir, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(words, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("paper"),
        F.col("r_name").alias("conference"),
        period("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") == "P", "workshop").otherwise("main").alias("paper_type"),
        F.concat_ws(" ", F.lit("on"), F.array_join("w", " ")).alias("title"),
        F.array_join("w", "; ").alias("keywords"),
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """surface, label: 'small x' and 'large x' are x."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.where(F.col("p_name").rlike("^(small|large) ")).select(F.col("p_name").alias("surface"), F.regexp_replace("p_name", "^(small|large) ", "").alias("label"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as notes in JSON: content bare, wrapped or under other keys by the paper's number, and replies that decide in several ways."""
    p = F.col("paper")
    number, text = p.cast("string"), lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    words = F.split("keywords", "; ")
    wrapped = lambda v: F.struct(v.alias("value"))
    file = text("/pdf/", number)
    contents = [
        F.struct(wrapped(F.col("title")).alias("title"), wrapped(words).alias("keywords"), wrapped(file).alias("pdf"), wrapped(F.col("conference")).alias("venueid"), wrapped(F.array(F.lit("A B"), text("C ", number))).alias("authors")),
        F.struct("title", words.alias("keywords"), text("short ", number).alias("TLDR"), file.alias("pdf"), F.col("conference").alias("venueid"), F.lit("theory").alias("track")),
        F.struct("title", F.col("keywords").alias("keyword"), text("brief ", number).alias("tldr"), F.struct(file.alias("url")).alias("pdf"), F.lit("nowhere").alias("venueid"), F.lit("vision").alias("subject areas")),
    ]
    content = F.when(p % 3 == 0, F.to_json(contents[0])).when(p % 3 == 1, F.to_json(contents[1])).otherwise(F.to_json(contents[2]))
    reply = lambda by, body: text('{"invitation":"V/Paper', number, "/", by, '","content":', body, "}")
    replies = (
        F.when(p % 5 == 0, reply("Decision", '{"decision":"Accept (Poster)"}'))
        .when(p % 5 == 1, reply("Decision", '{"decision":{"value":"Reject"}}'))
        .when(p % 5 == 2, reply("Meta_Review", '{"recommendation":{"value":"Accept"},"title":"Meta"}'))
        .when(p % 5 == 3, reply("Official_Review", '{"decision":"Accept"}'))
        .otherwise(text(reply("Decision", '{"title":"Accept"}'), ",", reply("Decision", '{"final_decision":"Accept (Oral)"}')))
    )
    original = F.when(p % 10 == 0, text(',"original":{"id":"o', number, '","forum":"n', number, '","content":{"title":"original of ', number, '"}}')).otherwise("")
    note = text('{"id":"n', number, '","forum":"n', number, '","number":', number, ',"tcdate":', (p * 86_400_000).cast("string"), ',"content":', content, ',"details":{"directReplies":[', replies, "]", original, "}}")
    return papers(spark, sf_dir).select("paper", "conference", "year", note.alias("note"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision notes on the forums of the papers' notes, in JSON."""
    p = F.col("paper")
    says = F.when(p % 4 == 0, '{"decision":"Accept"}').when(p % 4 == 1, '{"Decision":{"value":"Accept (Talk)"}}').otherwise('{"decision":"Reject"}')
    return papers(spark, sf_dir).select("paper", F.concat(F.lit('{"id":"d'), p.cast("string"), F.lit('","forum":"n'), p.cast("string"), F.lit('","content":'), says, F.lit("}")).alias("note"))


# How an item of a listing page looks, by layout; {n} is the paper's number, {t} its title, {y} the year.
LAYOUTS = {
    "pmlr": '<div class="paper"><p class="title">{t}</p><p class="details">Ann {n}, Bob; Proceedings of it, PMLR 7</p><p>[<a href="/v7/p{n}.html">abs</a>][<a href="/v7/assets/p{n}.pdf">Download PDF</a>]</p></div>',
    "pmlr paragraph": '<p>{t}<br><i>Ann {n}, Bob; and more</i><br><a href="/v7/p{n}.html">page</a> <a href="/v7/p{n}/p{n}.pdf">Download PDF</a></p>',
    "day": '<p><a href="content_CVPR_{y}/html/P{n}_paper.html">{t}</a>, Ann {n}, Bob, [<a href="content_CVPR_{y}/papers/P{n}_paper.pdf">pdf</a>]</p>',
    "old": '<p><a href="content_cvpr_{y}/html/P{n}_paper.html">{t}</a>, Ann {n}, Bob, [<a href="content_cvpr_{y}/papers/P{n}_paper.pdf">pdf</a>]</p>',
    "new": '<div><a href="/content/CVPR{y}/html/P{n}_paper.html">{t}</a> Ann {n} [<a href="/content/CVPR{y}/papers/P{n}_paper.pdf">pdf</a>]</div>',
    "workshop": '<div><a href="content/w{y}/papers/P{n}_paper.pdf">{t}</a>, Ann {n}</div>',
    "neurips": '<li><a href="/paper/{y}/hash/{n}-Abstract.html">{t}</a> <i>Ann {n}</i></li>',
    "neurips all": '<li><a href="/paper_files/paper/{y}/hash/{n}-Abstract-Conference.html">{t}</a><i>_Ann {n}_</i></li>',
    "acl": '<p><span class="d-block"><a href="#top">up</a><strong><a href="/{y}.acl-{n}/">{t}</a></strong><a href="/OTHER">x</a></span></p>',
}


def listing(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Papers as listing pages (year, page, html) of a conference and year each, one for every thousand of the papers' numbers, in their order."""
    item = F.lit(LAYOUTS[layout])
    for mark, value in (("{n}", F.col("paper").cast("string")), ("{t}", F.col("title")), ("{y}", F.col("year").cast("string"))):
        item = F.replace(item, F.lit(mark), value)
    rows = papers(spark, sf_dir).groupBy("year", "conference", F.expr("paper div 1000").alias("part")).agg(F.array_sort(F.collect_list(F.struct("paper", item.alias("item")))).alias("items"))
    page = F.concat(F.lit('<html><body><nav><a href="/v7/index.html">Home</a></nav><div class="list">'), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</div></body></html>"))
    place = F.array_position(F.array(*[F.lit(v) for v in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]), F.col("conference")).cast("int")
    return rows.select("year", (place * 1_000_000 + F.col("part")).cast("int").alias("page"), page.alias("html"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (paper, url, html) of the papers at five sites, by the paper's number; each seventh has a text that is too short."""
    p, n = F.col("paper"), F.col("paper").cast("string")
    body = F.when(p % 7 == 0, "short").otherwise(F.concat(F.lit("Abstract: we look at  "), F.col("title"), F.lit(" in all of its forms and show\n what it is good for")))
    html = lambda before, after: F.concat(F.lit(before), body, F.lit(after))
    pages = [
        ("https://aclanthology.org/x", "/", '<div class="card-body acl-abstract"><span>', "</span></div>"),
        ("https://openaccess.thecvf.com/html/x", "_paper.html", '<div id="other">no</div><div id="abstract">', "</div>"),
        ("https://proceedings.mlr.press/v7/x", ".html", "<h4> Abstract </h4><div>", "</div><div class=abstracts>too late, but long enough to be taken for one</div>"),
        ("https://papers.nips.cc/x", "-Abstract.html", "<h3>The abstract of it</h3><p>", "</p>"),
        ("https://openreview.net/forum?id=x", "", '<div class="note-content-value wide">tiny</div><div class="markdown-content">', "</div>"),
    ]
    url = html_of = F.lit(None).cast("string")
    for k, (start, end, before, after) in enumerate(pages):
        url = F.when(p % 5 == k, F.concat(F.lit(start), n, F.lit(end))).otherwise(url)
        html_of = F.when(p % 5 == k, html(before, after)).otherwise(html_of)
    return papers(spark, sf_dir).select("paper", "conference", "year", "title", url.alias("url"), html_of.alias("html"))
