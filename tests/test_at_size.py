"""What must not grow with the tables: memory of tasks, passes over texts, keys without a value."""

import numpy as np
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.operators import abstracts, extractors, keywords, listings, phrases, titles


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_many_whole_phrases_take_one_pass(spark):
    """However many automata the phrases would need, those of few words are joined; longer ones are found all the same."""
    long = " ".join("abcdefghij")
    texts = spark.createDataFrame([(1, f"x {long} y"), (2, "x  y"), (2, "x  y"), (3, None)], "id long, t string")
    listed = spark.createDataFrame([("x",), ("x a",), (" y",), ("h i j y",), ("nowhere",)], "p string")
    few = phrases.matches(texts, F.col("t"), listed, ["id"], whole_words=True, most_chars=2)
    assert "MapInPandas" not in plan(few)
    assert sorted(map(tuple, few.collect())) == [(1, "h i j y"), (1, "x"), (1, "x a"), (2, " y"), (2, " y"), (2, "x"), (2, "x")]
    more = phrases.matches(texts, F.col("t"), listed.union(spark.createDataFrame([(long,)], "p string")), ["id"], whole_words=True, most_chars=2)
    assert sorted(r.phrase for r in more.where("id = 1").collect()) == [long, "h i j y", "x", "x a"]


def test_days_beyond_the_year_9999(spark):
    rows = spark.createDataFrame([(0,), (-1,), (253402300800000,), (8999999 * 86_400_000 + 86_399_999,), (2**62,)], "c long")
    assert [r.d for r in rows.select(X.date_of_millis(F.col("c")).alias("d")).collect()] == ["1970-01-01", "1969-12-31", "10000-01-01", "26611-03-01", None]


def test_links_carry_what_their_rule_reads(spark):
    """What a task hands on of a page grows with the page, not with its links times its text."""
    item = '<li><a href="/paper/2019/hash/{0}-Abstract.html">A title of {0}</a> <i>Ann {0}</i></li>'
    page = "<div>" + "".join(item.format(k) for k in range(1500)) + "</div>"
    known = sum(len(x) for link in listings._anchors(page, ("next", "parent")) for x in link if isinstance(x, str))
    assert known < 2 * len(page)
    pages = spark.createDataFrame([(2019, 0, page, None), (2019, 1, None, "b"), (2019, 2, "<a href=x>t</a>", "c")], "year int, page int, html string, more string")
    got = listings.anchors(pages, "next")
    assert got.columns == ["year", "page", "more", "at", "href", "text", "next"]
    by = {r.page: r for r in got.groupBy("page").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.first("more").alias("more")).collect()}
    assert (by[0].n, by[0].last, by[0].more) == (1500, 1499, None) and (by[2].n, by[2].more) == (1, "c") and 1 not in by
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert listings.neurips(pages).count() == 1500


def test_known_phrases_are_spelt_once(monkeypatch):
    calls = []
    monkeypatch.setattr(titles, "_normal", lambda text, own=titles._normal: calls.append(text) or own(text))
    known = ["Graph Neural-Network", "Network", "graph neural network"]
    for _ in range(20):
        assert titles.known_phrases("A graph  neural network", known) == ["graph neural network", "Network"]
    assert len(calls) == 20 + 3
    assert list(titles.phrases_by_look("Alpha-Net: fast, and Wide: of Things")) == ["Alpha-Net", "Wide", "Things"]


def test_a_title_is_normalised_once(spark):
    titles_ = spark.createDataFrame([("Graph  Neural-Network learning",), (None,), ("SLA",)], "t string")
    got = titles_.select(keywords.vocabulary_match(F.col("t"), ["SLAM", "Network", "graph neural network"]).alias("v"))
    assert [r.v for r in got.collect()] == [["graph neural network", "Network"], [], []]
    optimised = got._jdf.queryExecution().optimizedPlan().toString()
    # Not within the lambda that is run for each phrase.
    assert optimised.count("regexp_replace") == 1 and "Contains(trim(" not in optimised and "Contains(lambda" in optimised.replace("contains", "Contains")


def test_papers_without_an_address_are_dealt_out(spark):
    """No join of the filling has the keys that rows lack as its own: all of them would go to one task."""
    kind = "conference string, year int, title string, openreview_url string, abstract string"
    long = "an abstract that is as long as it must be"
    papers = [("c", k, f"a title that is long {k}", None, "") for k in range(400)] + [("c", 1, "slashes", "https:/aclanthology.org/x.pdf", None), ("c", 1, "slashes", "https://aclanthology.org/y///", ""), ("c", 2, "own", "\0", long)]
    pages = [("https://aclanthology.org/x/", f"<div class=acl-abstract>{long} x</div>"), ("https://aclanthology.org/y/", f"<div class=acl-abstract>{long} y</div>"), (None, "n")]
    papers, pages = spark.createDataFrame(papers, kind), spark.createDataFrame(pages, "url string, html string")
    searches = spark.createDataFrame([("a title that is long 3", '{"data":[{"abstract":"' + long + ' 3"}]}')], "title string, response string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = abstracts.fill_missing(papers, pages, searches)
        most = got.where("abstract_from = 'empty'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 200
    by = {r.abstract: r.abstract_from for r in got.where("abstract_from <> 'empty'").collect()}
    assert by == {f"{long} x": "html", f"{long} y": "html", f"{long} 3": "s2", long: "own"} and got.count() == 403


def test_weights_of_words_are_worked_out_once(monkeypatch):
    calls = []
    own = extractors.hashlib.md5
    monkeypatch.setattr(extractors.hashlib, "md5", lambda x: calls.append(x) or own(x))
    find = extractors.by_weights(extractors.Weights(np.arange(extractors.CELLS), 1000))
    text = "alpha beta gamma alpha beta delta delta alpha"
    first = find(text, (1, 3), 24, 0.7)
    assert find(text, (1, 3), 24, 0.7) == first and len(calls) == 4
    assert len(first) == len(set(first)) == 4 + 6 + 6 and find("alpha", (2, 3), 5, 0.7) == []
