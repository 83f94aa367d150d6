"""Files, spreadsheets, fetching, pages, notes: edge rows."""

import json
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.functions import dom
from trendloom.functions import notes as N
from trendloom.operators import abstracts, listings, notes
from trendloom.schema import PAPER_COLUMNS
from trendloom.sources import adapters, files, tables, xlsx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spreadsheets_round_trip_and_bad_files(spark, tmp_path):
    rows = [("a & <b>", "1", None), ("  spaced ", None, "x\x01y"), ("é" * 3, "2020.0", "z" * 40_000)]
    df = spark.createDataFrame(rows, "title string, year string, `odd name` string").coalesce(1)
    path = str(tmp_path / "t.xlsx")
    xlsx.write(df, path)
    got = xlsx.read(spark, path, ["year", "odd name", "absent", "title"]).collect()
    assert [(r.title, r.year, r["odd name"] and len(r["odd name"]), r.absent) for r in got] == [("a & <b>", "1", None, None), ("  spaced ", None, 2, None), ("ééé", "2020.0", 32_767, None)]
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    assert xlsx.read(spark, str(tmp_path / "*.xlsx"), ["title"], skip_bad=True).count() == 3
    with pytest.raises(Exception, match="not a zip"):
        xlsx.read(spark, str(tmp_path / "bad.xlsx"), ["title"]).count()
    assert [xlsx.column_number(c) for c in ("A1", "Z9", "AA7", "AMJ1")] == [0, 25, 26, 1023]


def test_a_large_sheet_in_ranges(spark, tmp_path, monkeypatch):
    rows = spark.range(30_000).selectExpr("cast(id AS string) a", "if(id % 7 = 0, null, 'x' || id) b", "'never read' c")
    path = str(tmp_path / "large.xlsx")
    xlsx.write(rows.coalesce(1), path)
    got = xlsx.read(spark, path, ["b", "a", "absent"], ranges=8)
    assert got.rdd.getNumPartitions() >= 8
    rows.write.parquet(str(tmp_path / "same"))
    want = spark.read.parquet(str(tmp_path / "same")).selectExpr("b", "a", "cast(null AS string) absent")
    assert got.count() == 30_000 and got.exceptAll(want).count() == 0
    sizes = [n for (n,) in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * xlsx.BLOCK
    # Every row is one range's, whatever the number of ranges and wherever blocks and chunks end.
    content = (tmp_path / "large.xlsx").read_bytes()
    for ranges, block in ((1, 2000), (3, 1), (5, 29_999), (2, 30_001)):
        monkeypatch.setattr(xlsx, "BLOCK", block)
        parts = [list(xlsx.sheet_rows(content, ["a"], k, ranges))[1:] for k in range(ranges)]
        assert sorted(int(r[0]) for p in parts for r in p) == list(range(30_000))


def test_a_sheet_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 20_003, 1, 7).selectExpr("cast(id AS string) a", "if(id % 5 = 0, null, repeat('ä & <b> ', cast(id % 9 AS int))) b")
    path = str(tmp_path / "wide.xlsx")
    xlsx.write(rows, path)
    xlsx.write(rows, path)  # over itself
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None and len(book.namelist()) == 5
    got = list(xlsx.sheet_rows((tmp_path / "wide.xlsx").read_bytes(), ["b", "a"]))
    assert [r[::-1] for r in got[1:]] == [[r.a, r.b] for r in rows.collect()] and got[0] == ["a", "b"]
    assert [p.name for p in tmp_path.iterdir() if "xlsx" in p.name and not p.name.endswith(".crc")] == ["wide.xlsx"]
    xlsx.write(rows.limit(0), path)
    assert list(xlsx.sheet_rows((tmp_path / "wide.xlsx").read_bytes())) == [["a", "b"]]
    books = xlsx.workbooks(rows, 1000)
    assert {r.rows for r in books.select("rows").collect()} <= set(range(1, 1001)) and books.count() == 21
    back = xlsx.parsed(books, ["a", "b"])
    assert back.exceptAll(rows.selectExpr("a", "b")).count() == 0 and back.count() == 20_003
    assert xlsx.workbooks(rows.limit(0)).count() == 0
    monkeypatch.setattr(xlsx, "MOST_ROWS", 20_003)
    with pytest.raises(ValueError, match="rows at most"):
        xlsx.write(rows, path)
    assert list(xlsx.sheet_rows((tmp_path / "wide.xlsx").read_bytes())) == [["a", "b"]]  # the former file


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksums_of_texts_one_after_another(a, b):
    assert xlsx.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_shared_strings_numbers_booleans_and_gaps(tmp_path):
    main, rel = xlsx.MAIN[1:-1], xlsx.REL[1 : xlsx.REL.index("}")]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r7" Target="/xl/worksheets/x.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/x.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row><row r="5"><c r="B5"><v>2.5</v></c></row></sheetData></worksheet>')
    assert list(xlsx.sheet_rows((tmp_path / "s.xlsx").read_bytes())) == [["name", None, "flag"], ["rich", None, "true"], [None, "2.5"]]


def test_inputs_that_are_missing_broken_or_alternatives(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,year,keywords\n"one, two",2020.0,k\nthree,abc,\n')
    xlsx.write(spark.createDataFrame([("four", "2021")], "title string, year string"), str(tmp_path / "b.xlsx"))
    (tmp_path / "broken.xlsx").write_bytes(b"x")
    (tmp_path / "empty.csv").write_text("")
    p = lambda n: str(tmp_path / n)
    got = files.read_papers(spark, p("none.csv"), p("a.csv"), [p("no.xlsx"), p("b.xlsx"), p("a.csv")], p("broken.xlsx"), p("empty.csv"))
    assert got.columns == [*PAPER_COLUMNS, "source"]
    assert sorted((r.title, r.year, r.source) for r in got.collect()) == [("four", 2021, 2), ("one, two", 2020, 1), ("three", None, 1)]
    assert files.read_papers(spark, p("none.csv")).count() == 0
    assert files.resolved(spark, [p("no.csv"), p("a.csv")], p("no.csv")) == [p("a.csv")]
    files.required(spark, p("a.csv"))
    with pytest.raises(FileNotFoundError):
        files.required(spark, p("a.csv"), p("no.csv"))


def test_cached_tables_know_their_inputs(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    spark.range(3).toDF("n").write.parquet(source)
    build = lambda: spark.read.parquet(source).where("n >= 0")
    version = lambda: tables.present(spark, path)["version"]
    assert tables.cached(spark, path, build).count() == 3
    first = version()
    assert tables.cached(spark, path, build).count() == 3 and version() == first
    assert tables.cached(spark, path, lambda: build().where("n > 0")).count() == 2 and version() != first  # another plan
    first = version()
    spark.range(5).toDF("n").write.mode("append").parquet(source)  # a changed input
    assert tables.cached(spark, path, lambda: build().where("n > 0")).count() == 6 and version() != first


def test_fingerprints_of_plans_made_anew(spark):
    rows = spark.range(3).selectExpr("array(id, id + 1) AS a")
    plans = lambda: [rows.select(F.transform("a", lambda x, i: x + i).alias("b")), rows.select(F.transform("a", lambda x, i: i + x).alias("b")), rows.select(F.transform("a", lambda x, i: x - i).alias("b"))]
    first, second = [[tables.fingerprint(df) for df in plans()] for _ in range(2)]
    assert first == second and len(set(first)) == 3


def test_a_csv_table_with_quotes_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', 2020, "x\ny", 1), ("\\", 2021, '"', 2)], "topic string, year int, venue string, count long")
    files.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_cube(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, rows.collect()))


def test_a_table_is_never_absent(spark, tmp_path):
    import threading

    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    tables.publish(spark.range(4).toDF("n"), path)

    def reader():
        while not stop.is_set():
            try:
                seen.append(tables.read(spark, path).agg(F.sum("n")).first()[0])
            except Exception as e:  # noqa: BLE001
                seen.append(repr(e)[:300])

    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(5):  # each reads the table that it replaces
        tables.publish(tables.read(spark, path).withColumn("n", F.col("n") + 1), path, keep=3)
    stop.set()
    thread.join()
    assert set(seen) <= {6 + 4 * k for k in range(6)} and len(seen) > 1, seen
    # A write that dies leaves the table, and what it wrote goes with the next one.
    with pytest.raises(Exception, match="died"):
        tables.publish(tables.read(spark, path).withColumn("n", F.raise_error(F.lit("died"))), path)
    assert tables.read(spark, path).agg(F.sum("n")).first()[0] == 26
    tables.publish(spark.range(1), path)
    assert tables.read(spark, path).count() == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2
    with pytest.raises(FileNotFoundError):
        tables.read(spark, str(tmp_path / "none"))


def test_statistics_as_the_table_is_written(spark, tmp_path):
    rows = [("own", "a" * 40), ("html", "b" * 40), ("html", "c"), ("s2", "d" * 30), ("empty", ""), ("empty", None), ("not tried", "")]
    filled = spark.createDataFrame(rows, "abstract_from string, abstract string").repartition(3)
    table, seen = abstracts.write_filled(filled, str(tmp_path / "t"))
    assert seen == abstracts.fill_statistics(filled).first().asDict() == {"rows_missing_start": 6, "rows_to_process": 5, "filled_html": 2, "filled_s2": 1, "still_missing": 3}
    assert table.count() == 7


def test_ledger_of_what_was_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,year\n"one, two",2020\nthree,2021,too many\nfour\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    xlsx.write(spark.createDataFrame([("x",), ("y",)], "title string"), str(tmp_path / "b.xlsx"))
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    p = lambda n: str(tmp_path / n)
    got = files.read_ledger(spark, p("a.csv"), p("*.xlsx"), p("none.csv"), p("empty.csv"), p("p.parquet")).collect()
    by = {(r.path.rsplit("/", 1)[1], r.source): (r.rows, r.bad, r.error) for r in got if r.source < 4}
    assert by["a.csv", 0] == (3, 2, None) and by["b.xlsx", 1] == (2, 0, None)
    assert by["broken.xlsx", 1][:2] == (0, 0) and "not a zip" in by["broken.xlsx", 1][2]
    assert by["none.csv", 2] == (0, 0, "missing") and by["empty.csv", 3] == (0, 0, "empty")
    assert sum(r.rows for r in got if r.source == 4) == 3 and files.read_ledger(spark).count() == 0


def test_cube_evaluation_threshold_and_report_files(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("t", 2020, "v", 3)], "topic string, year int, venue string, count long"), str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_cube(spark, str(tmp_path / "c")).collect()] == [("t", 2020, "v", 3)]
    (tmp_path / "e.csv").write_text("topic,predicted_positive,exploded,recency,acceleration,spread,scale\nt,True,false,TRUE,False,true,true\n")
    assert tuple(files.read_evaluation(spark, str(tmp_path / "e.csv")).first()) == ("t", True, False, True, False, True, True)
    rows = spark.range(1).selectExpr("0.1D scale_low", "0.5D scale_high", "0.2D visible", "0.3D recency_min", "2.5D accel", "2 min_venues", "1.5D explosion", "1.56D explosion_estimate", "520 explosion_n")
    files.write_json_report(files.threshold_document(rows), str(tmp_path / "t.json"))
    assert set(json.loads((tmp_path / "t.json").read_text())) == set(files.THRESHOLDS)
    back = files.read_thresholds(spark, str(tmp_path / "t.json")).first()
    assert (back.scale_low, back.min_venues, back.explosion_n) == (0.1, 2.0, 520.0)
    files.write_text(spark.createDataFrame([("x",), ("y",)], "line string").coalesce(1), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["x", "y"]
    chart = json.loads(files.chart(spark.createDataFrame([(2020, 3, "a")], "year int, n int, k string"), "line", "year", "n", "k"))
    assert chart["data"]["values"] == [{"year": 2020, "n": 3, "k": "a"}] and chart["encoding"]["color"]["field"] == "k"


def test_fetching_with_retries_and_pace(spark):
    slept, calls = [], []

    def site(address):
        calls.append(address)
        if address == "busy" and calls.count("busy") < 3:
            raise adapters.TooManyRequests
        if address == "gone":
            raise OSError
        return f"page of {address}"

    fetch = adapters.retried(site, tries=3, wait=2.0, sleep=slept.append)
    assert [fetch(a) for a in ("ok", "busy", "gone")] == ["page of ok", "page of busy", None]
    assert slept == [4.0, 6.0, 2.0, 2.0] and calls.count("gone") == 3
    pauses = []
    assert adapters.paced(site, 0.5, pauses.append)("ok") == "page of ok" and pauses == [0.5]
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "url string, n int")
    got = adapters.fetched(rows, lambda: lambda address: f"<{address}>", workers=2).collect()
    assert sorted((r.n, r.html) for r in got) == [(1, "<a>"), (2, "<b>"), (3, None)]


def test_fetching_with_deadlines_and_hosts(spark):
    import time

    began = time.monotonic()
    slow = lambda a: time.sleep(60) if "hang" in a else 1 / 0 if "bad" in a else f"<{a}>"
    got = adapters.by_place(slow, ["a", "hang1", None, "bad", "b", "hang2", "hang3", "c"], in_flight=2, limit=0.3)
    assert got == ["<a>", None, None, None, "<b>", None, None, "<c>"] and time.monotonic() - began < 10
    now, slept = [0.0], []
    bucket = adapters.Bucket(2.0, burst=2, clock=lambda: now[0], sleep=slept.append)
    for _ in range(4):
        bucket.take()
    now[0] = 10.0
    bucket.take()
    assert slept == [0.5, 1.0]
    rows = spark.createDataFrame([(f"https://{h}.org/{k}", k) for k in range(6) for h in ("one", "two", "hang")] + [(None, 9)], "url string, n int")

    def make():
        def fetch(address):
            if "hang" in address:
                time.sleep(60)
            return address

        return fetch

    out = adapters.fetched(rows, make, workers=3, in_flight=6, limit=1.0, rate=50.0).collect()
    assert len(out) == 19 and all((r.html is None) == (r.url is None or "hang" in r.url) for r in out)


def test_summaries_are_written(spark, tmp_path):
    import oracle
    from trendloom.plans import reports

    reports.write_summaries(spark, oracle.DATA, str(tmp_path))
    made = {p.name: spark.read.option("header", True).csv(str(p)) for p in tmp_path.iterdir()}
    assert set(made) == set(reports.summaries(spark, oracle.DATA)) and made["top_topics_overall"].count() == 10
    assert made["top_topics_per_venue"].columns == ["conference", "k", "count"]


def test_element_tree():
    root = dom.parse("<div id=a class='x y'>one<br>two<p>three <b>four</b><script>no</script></div></i>five &amp; six")
    div = next(root.all("div"))
    assert div.text("|") == "one|two|three|four" and root.lines()[-1] == "five & six" and div.classes == ["x", "y"]
    b = next(root.all("b"))
    assert [a.tag for a in b.ancestors()] == ["p", "div", ""] and b.within("div", "p").tag == "div" and b.after().tag == "script"
    assert dom.parse(None).lines() == [] and dom.parse("a < b").lines() == ["a < b"]


LONG = "we look at gears and show what they are good for "


def test_abstract_layouts():
    of = abstracts.abstract_of
    assert of("https://aclanthology.org/x", f"<div class='card-body acl-abstract'><h5>Abstract</h5><span>{LONG}</span></div>") == LONG.strip()
    assert of("https://x.neurips.cc", f"<h4>The Abstract of it</h4><p>{LONG}</p>") == LONG.strip()
    assert of("https://proceedings.mlr.press/v1/x.html", f"<h4>The Abstract</h4><p>{LONG}</p>") is None
    assert of("https://openreview.net/forum?id=1", f"<div class='note-content-value'>{LONG}</div>") is None  # below 60 characters
    assert len(of("https://openreview.net/forum?id=1", f"<div class='markdown-content'>{LONG * 300}</div>")) == 8000
    assert len(of("https://openaccess.thecvf.com/x", f"<div id=abstract>{LONG * 300}</div>")) == len(LONG) * 300 - 1
    assert of("https://elsewhere", f"<div class=abstract>{LONG}</div>") is None and of(None, None) is None
    older = abstracts.OLDER_SITES
    assert of("https://papers.nips.cc/x", "<h3>Abstract</h3><p>Abstract: brief</p>", older) == "Abstract: brief"
    assert of("https://papers.nips.cc/x", f"<h3>Summary</h3><p>{LONG}</p><div class=Abstracts>{LONG}</div>", older) is None
    assert of("https://openaccess.thecvf.com/x", f"<section id=theAbstract>{LONG}</section>", older) == LONG.strip()


def test_filling_with_a_limit(spark):
    kind = "conference string, year int, title string, openreview_url string, abstract string"
    papers = spark.createDataFrame([("c", 1, f"a title that is long {k}", f"https://openaccess.thecvf.com/x{k}_paper.pdf", "") for k in range(6)] + [("c", 1, "short", None, None), ("c", 1, "has", "u", LONG)] * 2, kind)
    pages = spark.createDataFrame([(f"https://openaccess.thecvf.com/x{k}_paper.html", f"<div id=abstract>{LONG}{k}</div>") for k in range(3)], "url string, html string")
    got = abstracts.fill_missing(papers, pages, limit=5)
    by = {r.abstract_from: r["count"] for r in got.groupBy("abstract_from").count().collect()}
    assert by == {"own": 2, "html": 3, "empty": 2, "not tried": 3} and got.columns == [*papers.columns, "abstract_from"]
    s = abstracts.fill_statistics(got).first()
    assert (s.rows_missing_start, s.rows_to_process, s.filled_html, s.filled_s2, s.still_missing) == (8, 5, 3, 0, 2)
    assert abstracts.fill_missing(papers.drop("abstract"), pages).where("abstract_from = 'html'").count() == 3


def test_listing_links(spark):
    main = '<a href="CVPR2019.py?day=1">1</a><a href="other">x</a><a href="https://h/CVPR2019?day=2">2</a>' + "".join(f'<a href="CVPR2019.py?day={k}">d</a>' for k in range(3, 9))
    menu = '<a href="/CVPR2019_workshops/menu">m</a><a href="/CVPR2019_workshops/W1">a</a><a href="https://openaccess.thecvf.com/CVPR2019_workshops/W2/">b</a><a href="CVPR2019_workshops/W1">again</a>'
    days = listings.day_links(spark.createDataFrame([(2019, 0, main)], "year int, page int, html string")).orderBy("page").collect()
    assert [r.url for r in days][:3] == ["https://openaccess.thecvf.com/CVPR2019.py?day=1", "https://h/CVPR2019?day=2", "https://openaccess.thecvf.com/CVPR2019.py?day=3"] and len(days) == 5
    shops = listings.workshop_links(spark.createDataFrame([(2019, 0, menu)], "year int, page int, html string")).orderBy("page").collect()
    assert [r.url for r in shops] == [f"https://openaccess.thecvf.com/CVPR2019_workshops/W{k}" for k in (1, 2)]
    none = spark.createDataFrame([(2019, 0, None), (2019, 1, "")], "year int, page int, html string")
    assert listings.cvf(none).count() == 0 and listings.acl_events(none).count() == 0


def test_note_values(spark):
    content = lambda **v: F.parse_json(F.lit(json.dumps(v)))
    c = content(a={"value": "x"}, b=["p", "q"], c="[Re] plain", d={"value": ["r", "s"]}, e={"value": None}, f="", g={"url": "u"}, h="{not JSON", i=None)
    assert [one(spark, N.text_of(c, k)) for k in "hi"] == ["{not JSON", ""] and one(spark, N.list_of(c, "i")) == []
    assert [one(spark, N.text_of(c, k)) for k in "abcdefgz"] == ["x", "p; q", "[Re] plain", "r; s", "", "", "", ""]
    assert [one(spark, N.list_of(c, k)) for k in "abcdefz"] == [["x"], ["p", "q"], ["[Re] plain"], ["r", "s"], [], [], []]
    assert [one(spark, N.file_of(c, k)) for k in "agcz"] == ["x", "u", "[Re] plain", ""]
    assert one(spark, N.is_accept(content(my_Recommendation={"value": "Accept"}))) and not one(spark, N.is_accept(content(title="Accept", decision="Reject")))
    assert notes.paper_rows(notes.parsed(spark.createDataFrame([('{"id":"1"}',), ("no json",)], "note string")), F.lit(2020), F.lit("V/Workshop"), F.lit("V")).select("paper_type", "title", "keywords", "paper_number").distinct().collect()[0] == ("workshop", "", "", "")
