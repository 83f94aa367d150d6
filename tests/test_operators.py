"""Edge rows of the library's own operators."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from trendloom.functions import notes as N
from trendloom.functions import text as X
from trendloom.operators import keywords, labels, merge, series, signature
from trendloom.operators import cube as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def shares(spark, rows):
    return C.topic_year_shares(spark.createDataFrame(rows, "topic string, year int, venue string, count long"))


def test_tokenisers_differ_in_commas_and_multiplicity(spark):
    papers = spark.createDataFrame([("a", 2020, "t", "LLM; llms, Deep  Learning;;LLM")], "conference string, year int, title string, keywords string")
    got = {m: sorted(r.k for r in labels.mentions(papers, m).collect()) for m in labels.TOKENISERS}
    assert got["t1"] == ["deep learning", "llm", "llm", "llms"]
    assert got["t2"] == ["deep  learning", "llm", "llm", "llms"]
    assert got["t4"] == ["llm", "llms, deep  learning"]
    canonical = spark.createDataFrame([("llm", "big"), ("llms", "big")], "surface string, label string")
    assert [r.k for r in labels.mentions(papers, "t2", canonical).where("k = 'big'").collect()] == ["big"] * 3


def test_track_and_keyword_filters(spark):
    papers = spark.createDataFrame([(" Main ", "a"), ("MAIN", None), (None, "b"), ("workshop", "c"), ("main", "Topic: x")], "paper_type string, keywords string")
    assert labels.main_track(papers).count() == 3 and labels.main_track(papers, strip=False).count() == 2
    assert labels.labelled(labels.main_track(papers)).count() == 1
    assert labels.main_track(papers.drop("paper_type")).count() == 5


def test_years_urls_and_cells(spark):
    assert [one(spark, X.year_of(F.lit(v))) for v in ("2020.0", "2020", "abc", None)] == [2020, 2020, None, None]
    assert one(spark, X.repair_url(F.lit("https:/host/x"))) == "https://host/x" and one(spark, X.repair_url(F.lit("http://ok"))) == "http://ok"
    assert one(spark, X.sanitise(F.lit("a\x01b"))) == "a b" and one(spark, X.sanitise(F.lit("a\x01b" * 4), 3)) == "aba"
    assert one(spark, X.split_abbreviation(F.lit("Long Phrase (LCD)"))) == ["Long Phrase", "LCD"]
    assert one(spark, X.normalise_title(F.lit("Vision-Language_Models: GNN"))) == "vision language models gnn"
    assert one(spark, N.note_value(F.lit('{"a": {"value": "x"}, "b": "y"}'), "a")) == "x" and one(spark, N.note_value(F.lit('{"b": "y"}'), "b")) == "y"
    assert [one(spark, X.is_junk(F.lit(k))) for k in ("semeval 2023 task", "2025 task 11", "based x", "machine", "graph")] == [True, True, True, True, False]


def test_ngrams_are_exact(spark):
    assert one(spark, X.ngrams(F.lit("a b c d"), 1, 2)) == ["a", "b", "c", "d", "a b", "b c", "c d"]
    assert one(spark, X.ngrams(F.lit("a b"), 2, 5)) == ["a b"] and one(spark, X.ngrams(F.lit("a"), 2, 3)) == []
    assert one(spark, X.ngrams(F.lit("a b c d e"), 5, 5)) == ["a b c d e"]


def test_signature_from_zero_gaps_and_inclusive_band(spark):
    th = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"scale_low": 0.1, "scale_high": 0.5, "visible": 0.1, "recency_min": 0.1, "accel": 2.5, "min_venues": 2, "explosion": 1.5}.items()])
    # 'new' is half of all mentions, and exactly at the upper bound; 'old' is never recent.
    rows = [("new", 2022, v, 1) for v in "ab"] + [("old", y, v, 1) for y in range(2017, 2026) for v in "ab"] + [("zero", 2022, "c", 0)]
    got = {r.topic: r for r in signature.evaluated(shares(spark, rows), th).collect()}
    assert got["new"].predicted_positive and got["new"].base == 0.5
    assert not got["old"].recency and not got["zero"].spread
    later = signature.signature(shares(spark, rows + [("new", 2025, "a", 50)]), th, 2022)
    assert {r.topic: r.predicted_positive for r in later.collect()}["new"]  # what comes after does not leak back


def test_confusion_rates_and_interval(spark):
    rows = [(True, True)] * 9 + [(True, False)] * 31 + [(False, True)] * 14 + [(False, False)] * 135
    c = signature.confusion(spark.createDataFrame(rows, "predicted_positive boolean, exploded boolean")).first()
    assert (c.N, c.TP, c.FP, c.FN, c.TN) == (189, 9, 31, 14, 135)
    assert round(c.precision, 3) == 0.225 and round(c.recall, 3) == 0.391 and round(c.base, 3) == 0.122 and round(c.lift, 3) == 1.849
    low, high = signature.wilson(F.lit(9), F.lit(23))
    assert (round(one(spark, low), 3), round(one(spark, high), 3)) == (0.222, 0.592)
    none = signature.confusion(spark.createDataFrame([(False, True)], "predicted_positive boolean, exploded boolean")).first()
    assert none.precision is None and none.recall == 0.0


def ranked(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").repartition(5)
    return rows, C.rank_average(rows, "x", "r", C.cuts(rows, ["x"])["x"])


def test_ranks_average_ties_and_single_rows(spark):
    of = lambda xs: [r.r for r in ranked(spark, xs)[1].orderBy("x").collect()]
    assert of([1.0, 1.0, 2.0, 3.0]) == [1 / 6, 1 / 6, 2 / 3, 1.0] and of([5.0]) == [0.0] and of([]) == [] and of([None, 1.0]) == [0.0, 1.0]


def test_ranks_of_many_tied_values(spark):
    r = random.Random(5)
    values = [float(r.choice([0, 0, 0, r.randrange(40_000) / 7])) for _ in range(100_000)]
    got = {x.k: x.r for x in ranked(spark, values)[1].collect()}
    below, same = {}, collections.Counter(values)
    n = 0
    for v in sorted(same):
        below[v] = n
        n += same[v]
    assert all(got[k] == pytest.approx((below[v] + (same[v] - 1) / 2) / (len(values) - 1)) for k, v in enumerate(values))


def test_numbers_by_ranges(spark):
    r = random.Random(6)
    rows = [(k, r.choice([0.5, 1.0, r.random() * 2])) for k in range(3000)] + [(5000, None)]
    got = C.numbered(spark.createDataFrame(rows, "k int, p double").repartition(7), "p", [k / 32 for k in range(1, 64)], [F.col("k")], "place")
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [x.k for x in got.orderBy("place").collect()] == [k for k, _ in want] and sorted(x.place for x in got.collect()) == list(range(1, 3002))


def test_merge_keeps_first_source_and_is_idempotent(spark):
    kind = "conference string, year int, title string, keywords string"
    a, b = spark.createDataFrame([("c", 1, "t", "first")], kind), spark.createDataFrame([("c", 1, "t", "second"), ("c", 1, "u", "x"), ("c", 1, "u", "x")], kind)
    got = merge.merge_papers([a, b])
    assert sorted(r.keywords for r in got.collect()) == ["first", "x"]
    assert merge.merge_papers([got, got]).count() == 2
    assert merge.append_missing(a, b).count() == 2
    nulls = spark.createDataFrame([(None, 1, "t", "x"), ("c", None, None, "x")], kind)
    assert merge.append_missing(nulls, nulls).count() == 2 and merge.append_missing(a, nulls).count() == 3


def test_vocabulary_phrases_and_documents(spark):
    assert one(spark, keywords.vocabulary_match(F.lit("Deep reinforcement-learning and SLAM"))) == ["Deep Reinforcement Learning", "Reinforcement Learning", "SLAM"]
    got = one(spark, keywords.filtered_phrases(F.array(*map(F.lit, ("graph neural network", "neural network", "model", "semeval 2023 task", "gan"))), ["model"]))
    assert got == ["graph neural network", "gan"]
    found = spark.createDataFrame([("a", 2017, "t", "x"), ("a", 2018, "u", "x")], "conference string, year int, title string, k string")
    assert series.figure_document(series.top_by_year(found, 3)).first()[0] == '{"x":[1,1,0,0,0,0,0,0,0]}'


def test_text_functions(spark):
    assert one(spark, X.pdf_of(F.lit("https://h/p/x-Abstract-Conference.html"))) == "https://h/p/x.pdf" and one(spark, X.pdf_of(F.lit("https://h/html/x_paper.html"))) == "https://h/papers/x_paper.pdf"
    assert [one(spark, X.paper_id_of(F.lit(u))) for u in ("h/a-Abstract.html", "h/b_paper.pdf", "h/c.html", "h/d")] == ["a", "b", "c", "d"]
    assert one(spark, X.authors_after(F.lit("A title, Ann, Bob, [pdf] [supp]"), F.lit("A title"))) == "Ann, Bob" and one(spark, X.authors_after(F.lit("x"), F.lit("A title"))) == ""
    assert one(spark, X.last_first(F.lit(None), F.lit("First"))) == "First" and one(spark, X.file_safe(F.lit("a b/é-1"))) == "a_b_é-1"
    assert one(spark, X.document(F.lit(""), F.lit("x" * 9000))) == "x" * 8000 and one(spark, X.document(F.lit(None), F.lit(None))) == ""
    assert one(spark, X.title_case(F.lit("o'neil's 3d-view"))) == "O'Neil'S 3D-View" and one(spark, X.axis_label(F.lit("graph nets"), 7, cased=True)) == "Graph N"
    assert [one(spark, X.paper_type_of(F.lit(v))) for v in ("V/Workshop/X", "V", None)] == ["workshop", "main", "main"]
    assert one(spark, X.update_where(F.lit(True), F.lit(""), F.lit("old"))) == "" and one(spark, X.update_where(F.lit(True), F.lit(""), F.lit("old"), empty_too=False)) == "old"
    assert one(spark, X.plain(F.lit(" NaN "))) == "" and one(spark, X.percent(F.lit(0.1234))) == "12.3%"


def test_robustness_lists_and_ranges(spark):
    kind = "topic string, predicted_positive boolean, exploded boolean"
    main = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("gone", True, True)], kind)
    other = spark.createDataFrame([("a", True, 1.0, 2.0), ("b", True, 1.0, 1.0), ("c", False, 0.0, 5.0), ("new", True, 1.0, 9.0)], "topic string, predicted_positive boolean, base double, peak double").withColumn("explosion", F.lit(1.5))
    r = signature.robustness(main, other).first()
    assert (r.N, r.TP, r.FP, r.FN, r.TN, r.flags, r.tps, r.main_flags, r.precision, r.recall) == (3, 1, 1, 0, 1, "a; b", "a", 3, 0.5, 1.0)
    lines = [x.line for x in signature.robustness_lines(signature.robustness(main, other)).collect()]
    assert len(lines) == 6 and lines[4] == "flags still flagged: 2 of 3: a; b"
    none = signature.robustness(main.limit(0), other).first()
    assert (none.N, none.precision, none.base, none.flags) == (0, 0.0, None, "")


def test_explosion_estimate_is_the_interpolated_quantile(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(f"t{k}", y, "v", int(n)) for k in range(60) for y, n in zip(range(2017, 2022), r.integers(1, 40, 5), strict=True)]
    s = shares(spark, rows)
    got = signature.explosion_estimate(s).first()
    cell = {(x.topic, x.year): (x["count"], x.share) for x in s.collect()}
    gc, gs = [], []
    for split in (2017, 2018):
        for k in range(60):
            c, v = cell[f"t{k}", split]
            if c >= 3:
                gc.append(max(cell[f"t{k}", y][0] for y in range(split + 1, split + 4)) / c)
                gs.append(max(cell[f"t{k}", y][1] for y in range(split + 1, split + 4)) / v)
    assert got.n == len(gs) and abs(got.estimate - np.quantile(gs, 1 - np.mean(np.array(gc) >= 3))) < 1e-9
    assert signature.explosion_estimate(s.limit(0)).first().estimate is None
