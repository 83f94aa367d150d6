"""Labels from titles, texts and an extractor, on worked examples and against brute force."""

import collections
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from trendloom.operators import extractors, keywords, phrases, titles
from trendloom.operators.cube import from_rows
from trendloom.streaming import cube
from trendloom.streaming.cube import windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_phrases_by_look():
    of = lambda t: list(titles.phrases_by_look(t))
    assert of("GA-Net: Guided Aggregation Net") == ["GA-Net", "Guided Aggregation Net", "Aggregation Net", "Net"]
    assert of("How to Learn") == ["Learn"] and of("the of and") == [] and of("") == []
    # Four words at most; a word that no phrase begins with ends one; two words of four characters are too few.
    assert of("Aa Bb Cc Dd Ee") == ["Aa Bb Cc Dd", "Bb Cc Dd Ee", "Cc Dd Ee", "Dd Ee", "Ee"]
    assert of("Deep Nets for low-rank data") == ["Deep Nets", "Nets", "low-rank data"] and of("a b") == []
    # No phrase ends with such a word, and no shorter one is tried in its place.
    assert of("one two far") == []
    assert of("alpha : Beta") == ["Beta"] and of("A, B; C:") == ["A B C"]


def test_title_keywords():
    of = titles.title_keywords
    assert of("GA-Net: Guided Aggregation Net for End-to-End Stereo Matching") == "GA-Net; Guided Aggregation Net; End-to-End Stereo Matching"
    assert of("Language-Contrastive Decoding (LCD)") == "LCD; Language-Contrastive Decoding"
    assert of("Deep Reinforcement Learning") == "Deep Reinforcement Learning" and of("  ") == "" and of(None) == ""
    assert of("learning") == "" and of("SLAM") == "SLAM"


def test_longest_against_the_set_of_what_nothing_contains():
    r = random.Random(4)
    for _ in range(200):
        phrases = [" ".join(r.choices(["aa", "ab", "b", "Cc", "dd"], k=r.randrange(1, 4))) for _ in range(r.randrange(0, 9))]
        low = {}
        for p in sorted(phrases, key=lambda p: (len(p), p)):
            low.setdefault(p.lower(), p)
        want = [p for k, p in sorted(low.items(), key=lambda x: (len(x[1]), x[1])) if not any(k != q and k in q for q in low)]
        assert titles.longest(phrases) == want
    assert len(titles.longest([f"phrase number {k}" for k in range(10, 40)])) == 14


def runs(words, sizes, stop, least=0):
    return [p for n in sizes for i in range(len(words) - n + 1) if not set(words[i : i + n]) & set(stop) and len(p := " ".join(words[i : i + n])) >= least]


def test_topic_and_methods(spark):
    stop = [*keywords.GENERIC, *keywords.COMMON]
    rows = [("Graph gears", "We propose cold rods. They are small! The model bends red rods? Rods end."), ("", "x"), (None, None), ("Gears of hot steel and rods", None), ("", "the and for are but not you all can had her was")]
    got = [r.k for r in spark.createDataFrame(rows, "t string, a string").select(keywords.topic_and_methods(F.col("t"), F.col("a")).alias("k")).collect()]
    for (t, a), k in zip(rows, got, strict=True):
        text = f"{t or ''} . {a or ''}".strip()
        parts = re.split(r"[.!?]\s+", text)
        methods, topics = [], []
        for s in parts:
            if any(c in s.lower() for c in keywords.METHOD_CUES):
                methods += [p for p in dict.fromkeys(runs(re.findall("[a-z0-9]+", s.lower()), (3, 2, 1), stop, 4)) if p not in methods]
        methods = methods[:7]
        topics = [p for p in dict.fromkeys(runs(re.findall("[a-z0-9]+", (" ".join(parts[:2]) + " " + (t or "")).lower()), (3, 2, 1), stop, 4)) if p not in methods][:7]
        want = " ".join(x for x in ("Topic: " + "; ".join(topics) if topics else "", "Methods: " + "; ".join(methods) if methods else "") if x)
        assert k == (want if len(text) >= 20 else "")
    assert got[0].startswith("Topic: ") and "Methods: " in got[0] and got[4] == ""


def test_frequent_phrases_against_brute_force(spark):
    r = random.Random(6)
    words = [f"word{c}" for c in "abcdefgh"] + ["the", "model", "art", "start"]
    docs = [(k, " ".join(r.choices(words, k=r.randrange(0, 60)))) for k in range(40)] + [(100, None), (101, ""), (102, "tiny"), (None, "word word word word")]
    got = {x.id: x.keywords for x in spark.createDataFrame(docs, "id long, text string").select("id", keywords.frequent_phrases(F.col("text")).alias("keywords")).collect()}
    stop = {*keywords.GENERIC, *keywords.COMMON_FREQUENT}
    for i, t in docs:
        found = re.findall("[a-z]{3,}", (t or "").lower()) if len((t or "").strip()) >= 10 else []
        out = [p for p, _ in collections.Counter(runs(found, (3, 2), stop)).most_common(15)]
        out += [p for p, _ in collections.Counter(runs(found, (1,), stop)).most_common()][: 15 - len(out)]
        kept = []
        for p in sorted(out, key=lambda p: -len(p.split())):
            if not any(p in k and p != k for k in kept):
                kept.append(p)
        assert got[i] == "; ".join(kept), i


def test_specific_and_filtered_phrases(spark):
    of = lambda *p: one(spark, keywords.specific_phrases(F.array(*map(F.lit, p))))
    assert of("language", "gear", "language models", "big gear", "gear") == ["language models", "big gear"]
    assert of("b", "a", " ", "model") == ["b", "a"]


def ranked_by_hand(text, sizes, most, diversity, weight):
    """Every phrase's worth worked out anew for each pick."""
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in extractors.STOP]
    bag = lambda p: {w: n * weight(w) for w, n in collections.Counter(p.split()).items()}
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    whole, left, out = bag(" ".join(words)), list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1))), []
    while left and len(out) < most:
        worth = {p: (1 - diversity) * cosine(bag(p), whole) - diversity * max((cosine(bag(p), bag(o)) for o in out), default=0) for p in left}
        top = max(worth.values())
        out.append(min((p for p in left if worth[p] > top - 1e-12), key=len))
        left.remove(out[-1])
    return out


def test_ranking_with_corpus_weights_equals_brute_force(spark):
    r = random.Random(2)
    words = [f"word{c}" for c in "abcdefghijklmnop"] + ["the", "of", "Über", "x_1"]
    docs = [(k, " ".join(r.choices(words[: 4 + k % 16], k=r.randrange(0, 60)))) for k in range(60)] + [(None, None), (60, ""), (60, "wordz " * 3)]
    weights = extractors.word_weights(spark.createDataFrame(docs, "id long, text string")).value
    assert weights.texts == len(docs) and weights.of("never") > weights.of("worda")
    df = collections.Counter(w for _, t in docs for w in {w for w in re.findall(r"\w\w+", (t or "").lower())})
    cells = collections.Counter()
    for w, n in df.items():
        cells[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % extractors.CELLS] += n
    assert {k: int(weights.counts[k]) for k in cells} == dict(cells) and weights.counts.sum() == sum(cells.values())
    for _, t in docs[:25]:
        for sizes, diversity in (((1, 3), 0.7), ((2, 4), 0.2), ((1, 1), 0.0)):
            got = extractors.by_weights(weights)(t or "", sizes, 8, diversity)
            want = ranked_by_hand(t or "", sizes, 8, diversity, weights.of)
            # What is worth the same but for rounding (one phrase in another order of words) may be taken in either order.
            assert len(got) == len(want) and [sorted(p.split()) for p in got] == [sorted(p.split()) for p in want]
    long = " ".join(f"word{r.randrange(400)}" for _ in range(40_000)) + " rare gear"
    assert len(extractors.by_weights(weights)(long, (1, 3), 24, 0.7)) == 24


def test_whole_texts_are_read(spark):
    text = "plain filler words " * 3000 + "zirconium flange " * 2000
    rows = spark.createDataFrame([(text,)], "t string")
    found = keywords.phrases_by(None, F.col("t"), keywords.GENERIC_SHORT, weights=extractors.word_weights(rows, "t"))
    assert "zirconium" in rows.select(found.alias("k")).first()[0]


def test_phrases_against_brute_force(spark):
    r = random.Random(9)
    texts = [(k, " ".join(r.choices(["a", "ab", "b", "ba", "é", "x"], k=r.randrange(0, 30)))) for k in range(40)] + [(99, None), (None, "ab ba"), (7, "ab ba")]
    listed = list({" ".join(r.choices(["a", "ab", "b", "é x"], k=r.randrange(1, 4))) for _ in range(60)}) + ["", None, "nowhere"]
    df, have = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(p,) for p in [*listed, *listed]], "p string")
    for whole in (False, True):
        pad = (lambda x: f" {x} ") if whole else (lambda x: x)
        want = collections.Counter((i, p) for i, t in texts if t is not None for p in listed if p and pad(p) in pad(t))
        for most in (40, phrases.MOST_CHARS):  # in several parts, and in one
            got = phrases.matches(df, F.col("t"), have, ["id"], whole_words=whole, most_chars=most)
            assert collections.Counter(tuple(x) for x in got.collect()) == want
    assert phrases.matches(df, F.col("t"), have.where("p = 'none'"), ["id"]).collect() == []


def test_extractors(spark):
    assert extractors.by_counts("red gear and red gear", (1, 2), 1, 0.0) == ["red gear"] and extractors.by_counts("", (1, 3), 5, 0.5) == []
    calls = []
    extractors.register("own", lambda: calls.append(1) or (lambda text, runs, most, diversity: ["Graph rods", "rods", "SemEval 2023 task", "model", "x1"] if runs != (1, 1) else ["steel", "no", "data"]))

    def missing():
        raise ImportError

    extractors.register("missing", missing)
    assert extractors.extractor("missing") is extractors.by_counts and extractors.extractor("unknown") is extractors.by_counts
    plug = lambda text, runs, most, diversity: ["Graph rods", "rods", "SemEval 2023 task", "model", "x1"] if runs != (1, 1) else ["steel", "no", "data", "X1"]
    found = keywords.phrases_by(plug, F.col("t"), keywords.GENERIC_SHORT, excluded=keywords.EXCLUDED, by_text=True)
    rows = spark.createDataFrame([("a long enough text",), ("tiny",), (None,)], "t string").select(found.alias("k")).collect()
    assert [r.k for r in rows] == ["Graph rods; x1; steel", "", ""]


def test_cascade_and_enriching(spark):
    rows = [(1, "", "", "", "have keywords"), (2, "Gears of hot steel", "We propose rods.", None, "x"), (3, "", "the and for are but not you all can had", None, None), (4, "", "you all can had her bolts bolts", None, ""), (5, None, None, None, None)]
    papers = spark.createDataFrame(rows, "id long, title string, abstract string, TLDR string, keywords string")
    got = {r.id: r.keywords for r in keywords.enriched(papers).collect()}
    assert got[1] == "have keywords" and got[2].startswith("Topic: ") and got[3] == "" and got[5] == ""
    assert got[4].startswith("Topic: ") and "bolts" in got[4]
    with_plug = keywords.keyword_cascade(papers, extractor=lambda *a: ["plugged in phrase"]).collect()
    assert {r.id: r.made for r in with_plug}[3] == "plugged in phrase"


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,id * 7,0,0) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type FROM range(10)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    want = sorted(map(tuple, windowed_counts(events).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want and sum(r[2] for r in want) == 10


def test_a_stream_keeps_the_cube(spark, tmp_path):
    r = random.Random(3)
    made = lambda n: [(r.choice(["a", "b", None]), r.choice([2020, 2021]), r.choice(["v", "w"])) for _ in range(n)]
    kind, path, rows = "topic string, year int, venue string", str(tmp_path / "cube"), []
    same = lambda df: sorted(map(tuple, df.collect()), key=repr)
    batch = lambda: same(from_rows(spark.createDataFrame(rows, kind)))

    def arrive(k):
        new = made(30)  # years come in any order: late rows count like others
        rows.extend(new)
        spark.createDataFrame(new, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        cube.keep_cube(stream, path, str(tmp_path / "checkpoint"), every=2, availableNow=True).awaitTermination()

    assert same(cube.read_kept(spark, path)) == []
    for k in range(3):
        arrive(k)
    run()
    assert same(cube.read_kept(spark, path)) == batch()
    for k in range(3, 5):
        arrive(k)
    run()  # restarted
    assert same(cube.read_kept(spark, path)) == batch()
    # The same batch again, before and after it is merged into the table, changes nothing.
    again = spark.createDataFrame(rows[:30], kind)
    for number in (0, cube._merged(spark, path)):
        cube.upsert(again, number, path, every=2)
        assert same(cube.read_kept(spark, path)) == batch()
    last, more = 50, made(20)
    rows += more
    for _ in range(3):
        cube.upsert(spark.createDataFrame(more, kind), last, path, every=100)
        assert same(cube.read_kept(spark, path)) == batch()
    cube.upsert(spark.createDataFrame([], kind), last + 1, path, every=2)
    assert same(cube.read_kept(spark, path)) == batch() and cube._merged(spark, path) == last + 1


def test_known_phrases_by_built_in_functions(spark):
    """The same phrases in the same order as the function of one title."""
    texts = [None, "", "slam", "SLAM for Few-Shot  Learning", "on deep reinforcement-learning, GNN denoising and nlp", *(f"{a} of {b}" for a, b in zip(titles.KNOWN, titles.KNOWN[7:], strict=False))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.f for r in rows.select("k", keywords.vocabulary_match(F.col("t"), titles.KNOWN, len(titles.KNOWN), 5).alias("f")).collect()}
    assert [got[k] for k in range(len(texts))] == [titles.known_phrases(t or "") for t in texts]
