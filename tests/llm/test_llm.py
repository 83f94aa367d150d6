"""The operators of trendloom.llm against brute force, on small tables with nulls, ties and repeated rows."""

import collections
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendloom.llm import exact_dedup, fixity, html_extract, mixing, ngram_join, packing, pii, quality, queries, secret_scan, spotsigs
from trendloom.llm.shared import components, small_batches

KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, row string"


def table(spark, texts):
    """Documents with further columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i and i % 5 == 0 else f"s{(i or 0) % 3}", len(t or ""), "clash", "clash", "clash") for i, t in texts]
    return spark.createDataFrame(rows, KIND)


def texts(seed=0, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + "the of and to in".split()
    made = [" ".join(r.choices(words, k=r.randrange(0, 80))) for _ in range(n)]
    for _ in range(n // 2):  # copies, and copies with a word or two changed
        t = r.choice(made).split()
        for _ in range(r.randrange(0, 3)):
            if t:
                t[r.randrange(len(t))] = r.choice(words)
        made.append(" ".join(t).upper() if r.random() < 0.3 else " ".join(t))
    return [*enumerate(made), (1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "x " * 30_000), (3, made[3])]


def test_near_classes_equal_brute_force(spark):
    docs = texts()
    for rule in (ngram_join.Rule(4, 85), ngram_join.Rule(5, 80), ngram_join.Rule(2, 50)):
        sets = []
        for _, t in docs:
            w = (t or "").lower().split()
            sets.append({tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)} if len(w) >= rule.words else ({tuple(w)} if w else set()))
        root = list(range(len(docs)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(range(len(docs)), 2):
            meet = len(sets[a] & sets[b])
            if sets[a] and 100 * meet >= rule.percent * (len(sets[a]) + len(sets[b]) - meet):
                root[find(a)] = find(b)
        least = collections.defaultdict(list)
        for k, (i, _) in enumerate(docs):
            least[find(k)].append(i)
        want = sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(docs))
        assert sorted(map(tuple, ngram_join.near_classes(table(spark, docs), rule).collect())) == want


def test_batches_are_bounded_in_rows_and_bytes(spark):
    small_batches(spark)
    long = spark.range(200, numPartitions=1).withColumn("t", F.repeat(F.lit("x"), 1 << 20))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["bytes", "rows"])

    got = long.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 200 and max(r["bytes"] for r in got) < 40 << 20
    assert max(r["rows"] for r in spark.range(5000, numPartitions=1).mapInArrow(sizes, "bytes long, rows long").collect()) == 1000


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 20)] + [(50, 40), (40, 60), (60, 50), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((40, 50, 60), 40)}


def test_exact_classes(spark):
    docs = texts() + [(None, "one")]
    got = exact_dedup.exact_classes(table(spark, docs), digest_all=True, keep_row=True).collect()
    low = lambda t: (t or "").lower()
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)
    assert len(got) == len(docs) and collections.Counter(r.digest for r in got if r.kept) == dict.fromkeys((hashlib.sha256(t.encode()).hexdigest() for t in groups), 1)
    for r in got:
        own = groups[low(r.row.text)]
        assert (r.group_size, r.keep_id) == (len(own), max(x for x in own if x is not None)) and r.row.kept == "clash"


def test_exact_classes_of_equal_lengths_and_prefixes(spark):
    start = "p" * exact_dedup.PREFIX_CHARS
    docs = [(1, "abc"), (2, "abd"), (3, start + "x"), (4, start + "y"), (5, start + "X"), (6, "alone"), (None, "abc"), (None, None), (7, "é" * 3), (8, "É" * 3)]
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_classes(table(spark, docs)).collect()}
    assert got == {(1, 1, 2), (2, 2, 1), (3, 5, 2), (4, 4, 1), (5, 5, 2), (6, 6, 1), (None, 1, 2), (None, None, 1), (7, 7, 1), (8, 8, 1)}


SECRETS = ["token = abcdef12", "API_KEY:'short'", "secret: token: abcdefgh", "password=token=abcdefgh", "é AKIA" + "A1" * 10, "AKIASHORT", "0123456789abcdef" * 2, "ghp_" + "a1B2" * 10, None, "", "no secret"]


def test_secret_scan_and_ledger(spark):
    docs = [(k, s) for k, s in enumerate(SECRETS)] + [(99, SECRETS[0]), (None, SECRETS[4])]
    scan = secret_scan.scan_versions(table(spark, docs))
    patterns = [(re.compile(secret_scan.ASSIGN, re.A), "assign", 2, 6), (re.compile("AKIA[A-Z0-9]+"), "access", 0, 20), (re.compile("[0-9a-f]+"), "hex", 0, 24)]
    text = collections.defaultdict(set)
    for i, t in docs:
        text[i].add(t or "")
    for r in scan.findings.collect():
        want = [(m.start(), k, kind, m.end()) for k, (p, kind, g, n) in enumerate(patterns) for m in p.finditer(next(iter(text[r.doc_id]))) if len(m[g]) >= n]
        assert [tuple(s) for s in r.spans if s["rank"] < 3] == sorted(want)
    assert any(s.kind == "github" for r in scan.findings.collect() for s in r.spans)
    # A second run scans nothing that is known; a new rule version is scanned everywhere.
    again = secret_scan.scan_versions(table(spark, [*docs, (7, "token = zzzzzzzz")]), ledger=scan.ledger, known=scan.blobs)
    assert {r.doc_id: r.spans for r in again.findings.where("doc_id = 99").collect()} == {r.doc_id: r.spans for r in scan.findings.where("doc_id = 99").collect()}
    assert again.ledger.count() == scan.ledger.count() + 1 and again.blobs.count() == scan.blobs.count() + 1


def test_packing_round_trip(spark):
    docs = texts() + [(2000, "long text " * 3000), (None, "nobody")]
    got = packing.pack(table(spark, docs), queries.tokenizer_path(), size=128).collect()
    ids_of = packing.token_ids(queries.tokenizer_path())
    want = collections.Counter()
    for i, t in docs:
        ids = np.frombuffer(ids_of(t or "") + np.array([2], "<u4").tobytes(), "<u4")
        cut = len(ids) % 128 if len(ids) > 128 else len(ids)
        starts = [s for s in ([0] if cut else []) + list(range(cut, len(ids), 128))]
        for k, s in enumerate(starts):
            e = cut if s < cut else s + 128
            want[i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) * 1.05 + 1


def test_packing_goes_up_to_the_root(spark):
    # Twenty tasks with two thirds of a bin each in the same sizes, and a few small items: all of these find room.
    docs = spark.range(20 * 30, numPartitions=20).selectExpr("id AS doc_id", "CASE WHEN id % 30 < 29 THEN repeat('word ', 90) ELSE 'a b c' END AS text")
    got = packing.pack(docs, queries.tokenizer_path(), size=128, order=F.col("doc_id") * 10)
    rows = got.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(range(600))
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r)
    assert len(held) == 20 * 29 and all(sum(r.length for r in v) <= 128 for v in held.values())
    assert all(r.sequence_order == 10 * min(x.doc_id for x in held[r.sequence_id]) for r in rows)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_500_000 + "b", "x" * 1_500_000])
def test_ids_of_very_long_runs(text):
    ids_of = packing.token_ids(queries.tokenizer_path())
    assert list(np.frombuffer(ids_of(text), "<u4")) == ids_of.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a  b\n\nc ", "it's <|endoftext|> 12", "\x1c!\x85 é漢🙂"])
def test_ids_are_those_of_the_tokenizer(text):
    ids_of = packing.token_ids(queries.tokenizer_path())
    assert list(np.frombuffer(ids_of(text), "<u4")) == ids_of.slow.encode(text, add_special_tokens=False).ids


def test_mixing_deviates_less_than_a_block(spark):
    share = mixing.shares({"a": 5, "b": 3, "c": 1.7}, 100)
    slots = mixing.one_period(share)
    for n, own in slots.items():
        for t in range(101):
            assert abs(sum(s < t for s in own) - t * share[n] / 100) < 1
    docs = texts()
    weights = {"s0": 2.0, "s1": 1.0}
    got = mixing.mix(table(spark, docs), weights, block=200, period=60).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in docs)
    of_slot = collections.defaultdict(set)
    for r in got:
        of_slot[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in of_slot.values()) and {r.source for r in got} == {"s0", "s1", mixing.OTHER}


def test_mixing_keeps_to_the_given_weights_over_the_whole_run(spark):
    # One hot source, 40 equal ones and 300 of a few rows each, a row a block.
    source = F.expr("CASE WHEN id < 12000 THEN 'hot' WHEN id < 24000 THEN concat('s', id % 40) ELSE concat('rare', id % 300) END")
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("x" * 10).alias("text"))
    weights = mixing.tempered_weights(docs)
    counts = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert len(counts) == 341 and all(abs(weights[n] - (10 * c) ** 0.5) < 1e-9 for n, c in counts.items())
    for w in (weights, {**weights, "hot": 1e5, "s1": 1e-3}):
        got = mixing.mix(docs, w, block=10).select("source", "slot").toPandas()
        assert sorted(got.slot) == list(range(25_000)) and set(got.source) == set(counts)
        order = got.sort_values("slot").source.to_numpy()
        names = sorted(counts)
        blocks, share = np.array([counts[n] for n in names], float), np.array([w[n] for n in names])
        given, fluid, worst = np.zeros(len(names)), np.zeros(len(names)), 0.0
        at = {n: k for k, n in enumerate(names)}
        for n in order:
            given[at[n]] += 1
            free = 1.0  # the ideal mixture of those that are left, for one slot
            while free > 1e-9 and (left := fluid < blocks - 1e-9).any():
                rate = np.where(left, share, 0) / share[left].sum()
                step = min(free, ((blocks - fluid)[left] / rate[left]).min())
                fluid, free = fluid + rate * step, free - step
            worst = max(worst, np.abs(given - fluid).max())
        assert worst < 1 + 1e-6


def test_mixing_of_null_unlisted_and_so_named_sources(spark):
    """Null, a source that no weight names and one that is named like the rest are the rest: one source, its blocks in one sequence."""
    docs = spark.createDataFrame([(k, (None, mixing.OTHER, "strange", "a")[k % 4], "x" * 10) for k in range(80)], "doc_id long, source string, text string")
    got = mixing.mix(docs, {"a": 1.0, mixing.OTHER: 3.0}, block=10).collect()
    of = collections.Counter(r.source for r in got)
    assert of == {"a": 20, mixing.OTHER: 60} and sorted(r.slot for r in got) == list(range(80))
    assert sorted(r.block for r in got if r.source == mixing.OTHER) == list(range(60))
    given = np.cumsum([r.source == "a" for r in sorted(got, key=lambda r: r.slot)])
    assert (abs(given - 0.25 * np.arange(1, 81)) < 1).all()


def test_mixing_scatters_rows_without_ids(spark):
    docs = spark.createDataFrame([(None if k % 2 else 7, f"text {k}", "s") for k in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, {"s": 1.0}, block=100).select("place", "block", "slot").toPandas()
    assert len(got) == 3000 and got.place.is_unique and (got.block == got.place // 100).all()
    assert got.place.min() == 0 and got.place.max() < sum(len(f"text {k}") for k in range(3000))


def test_fingerprints(spark):
    docs = [(i, t) for i, t in texts() if i != 3] + [(None, "the last one is here")]
    got = {r.doc_id: r for r in spotsigs.fingerprints(table(spark, docs)).collect()}
    order = sorted(docs, key=lambda d: -(d[0] if d[0] is not None else -1))
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = spotsigs.signature_sets(pa.array([t, edited, u]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (spotsigs.likeness(a, b), spotsigs.likeness(a, c))
        assert r.fingerprint == spotsigs.fingerprint(a)
    # Classes by brute force on the sets of signatures.
    docs_near = spotsigs.fingerprints(table(spark, docs), percent=50).collect()
    sets = {i: spotsigs.signature_sets(pa.array([t or ""]))[0] for i, t in docs}
    group = {i: i for i in sets}
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if len(a) and len(b) and spotsigs.likeness(a, b) >= 0.5:
            group = {k: group[i] if g == group[j] else g for k, g in group.items()}
    least = {g: min((k for k in group if group[k] == g and k is not None), default=None) for g in group.values()}
    assert {r.doc_id: r.near_id for r in docs_near} == {i: least[group[i]] for i in sets}
    assert len(set(least.values())) < len(sets) - 5


def anchored(text, anchors=frozenset(spotsigs.ANCHORS.split()), common=frozenset(f"{spotsigs.ANCHORS} {spotsigs.COMMON}".split())):
    """Signatures of a text of plain words, by the words themselves."""
    words = text.lower().split()
    out = set()
    for k, w in enumerate(words):
        chain = [x for x in words[k + 1 :] if x not in common][: spotsigs.CHAIN]
        if w in anchors and len(chain) == spotsigs.CHAIN:
            out.add((w, *chain))
    return out


def test_signatures_are_anchored_chains():
    r = random.Random(2)
    words = [f"w{k}" for k in range(40)] + f"{spotsigs.ANCHORS} {spotsigs.COMMON}".split()
    made = [" ".join(r.choices(words, k=r.randrange(0, 120))) for _ in range(80)]
    found = spotsigs.signature_sets(pa.array(made))
    for a, b in itertools.combinations(range(80), 2):
        x, y = anchored(made[a]), anchored(made[b])
        if x and y:
            assert len(found[a]) == len(x) and spotsigs.likeness(found[a], found[b]) == len(x & y) / len(x | y)


@pytest.mark.parametrize("ids", [[-(2**63) + 5, 2**63 - 5, 0, 1], [None] * 300, [7] * 200 + [None] * 100 + list(range(100)) + [2**62, -(2**62)], list(range(0, 4000, 4))])
def test_fingerprints_whatever_the_ids(spark, ids):
    docs = [(i, f"the text {k} of number {k * k}") for k, i in enumerate(ids)]
    got = spotsigs.fingerprints(table(spark, docs)).collect()
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in docs], "text string").withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashes[d[1]]))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


LONG = "Running text, long enough, with commas, and with words that are to be kept here."
PAGES = [
    ("<html><body><header>Top</header><nav><a href=/>Home</a></nav><div id='content'><h2>Title</h2><p>First, long enough paragraph, with commas, and words.</p><p>Second&nbsp;one\n here &amp; there, with more, words.</p></div>"
     "<div class='sidebar'><p>Side, bar, text, with, many, commas.</p></div><div id=comments><p>A reader, says, a lot, here.</p></div><form><p>Mail</p></form><footer>End</footer></body></html>",
     "Title\n\nFirst, long enough paragraph, with commas, and words.\n\nSecond one here & there, with more, words."),
    ("<article><h1>T</h1><p><b>One<br><p>Two.<script>var x='</p>'</script></p><ul><li>item</ul></article><aside>no</aside>", "T\n\nOne\n\nTwo.\n\nitem"),
    ("", ""), (None, ""), ("<<p>>&am", None), ("just text", "just text"),
    # No article element: names of both kinds, a page in one form, a listed name around everything, a long thread of comments.
    (f"<div class='post-widget content'><p>{LONG}</p></div>", LONG), (f"<div id='login-required article-body'><p>{LONG}</p></div>", LONG),
    (f"<form id=f><div class=menu><a href=x>Home</a></div><div><h1>T</h1><p>{LONG}</p><input value=no><button>Go</button></div></form>", f"T\n\n{LONG}"),
    (f"<div class=widget><p>{LONG}</p></div>", LONG),
    (f"<div class=page><div class=top><a href=/>Home</a> <a href=/x>X</a></div><div class=col><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=comments>{f'<p>{LONG}</p>' * 8}</div></div>", f"T\n\n{LONG}\n\n{LONG}"),
    (f"<div title='a hidden truth'><p>{LONG}</p></div><div hidden><p>{LONG}, {LONG}</p></div><form><p>Your mail, your name, and more, please.</p></form>", LONG),
    (f"<div id=a><h2>T</h2><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div class=x><p>{LONG}</p></div></div><ul><li><a href=1>One link</a><li><a href=2>Two</a></ul>", f"T\n\n{LONG}\n\n{LONG}\n\n{LONG}"),
    (f"<main><h1>T</h1><article><p>{LONG}</p></article><section><a href=1>More of this</a></section></main>", f"T\n\n{LONG}"),
]


def test_main_text(spark):
    rows = [(k, None if k == 1 else "u", h, "clash") for k, (h, _) in enumerate(PAGES)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert want is None or got[k].text == want
        assert got[k].n_chars == len(got[k].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def _thread(n, tag="p", name=""):
    said = "Reader {}, who writes at length, says that this, that, and more of it, was fine by them all."
    return "".join(f"<{tag} class='{name}'><p>{said.format(k)}</p></{tag}>" for k in range(n))


@pytest.mark.parametrize("n", [20, 60, 500])
def test_threads_of_comments_never_join_or_replace_the_article(n):
    for page in (
        f"<body><div><p>{LONG}</p></div><section class=comments>{_thread(n, 'div')}</section>",
        f"<article><p>{LONG}</p><section class='comments'>{_thread(n, 'div')}</section></article>",
        f"<main><article><p>{LONG}</p>{_thread(n, 'article', 'comment')}</article></main>",
        f"<main><article><p>{LONG}</p></article><div>{_thread(n, 'article', 'comment-body')}</div></main>",
        f"<div class=page><p>{LONG}</p><div id=disqus_thread>{_thread(n, 'div')}</div></div>",
        f"<div><p>{LONG}</p></div><div class='reply-list'>{_thread(n, 'article')}</div>",
        f"<div><p>{LONG}</p></div><div class=notices>{_thread(n, 'div')}</div>",
    ):
        assert html_extract.main_text(page) == LONG, page[:90]


def test_what_is_taken_back():
    # A page of nothing but a doubted container, one that holds the main heading, and an article that names its own parts.
    assert html_extract.main_text(f"<div class=comments><p>{LONG}</p></div>") == LONG
    assert html_extract.main_text(f"<div class=comments><p>A reader, says.</p></div><div class=widget><p>{LONG}</p></div>") == LONG
    assert html_extract.main_text(f"<p>One line.</p><div class='overlay'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>").startswith(f"T\n\n{LONG}")
    assert html_extract.main_text(f"<article class='post type-post comments-open'><p>{LONG}</p></article>") == LONG


def test_points_equal_brute_force():
    r = random.Random(4)
    for _ in range(30):
        page, depth = "", 0
        for _ in range(40):
            kind = r.random()
            if kind < 0.4:
                page, depth = page + f"<{r.choice(['div', 'section', 'blockquote'])}>", depth + 1
            elif kind < 0.8:
                page += f"<p>{', '.join(r.choices(['word', 'more of it', 'x'], k=r.randrange(1, 40)))}</p>"
            else:
                page += r.choice(["</div>", "</section>", "loose text, here"])
        root = html_extract.parse(page)
        html_extract._score(root)
        want = collections.Counter()
        stack = [root]
        while stack:
            node = stack.pop()
            for c in node.children:
                if isinstance(c, html_extract.Node):
                    stack.append(c)
                    continue
                up, part = (node.parent if node.tag in ("p", "blockquote") else node), html_extract._block_points(c, node)
                while up is not None:
                    want[id(up)] += part
                    up, part = up.parent, part / 2
        stack = [root]
        while stack:
            node = stack.pop()
            assert node.points == pytest.approx(want[id(node)])
            stack += [c for c in node.children if isinstance(c, html_extract.Node)]


@pytest.mark.parametrize("tag", ["div", "center", "button", "table><tr><td", "ul><li"])
def test_deep_and_long_pages(tag):
    import time

    began = time.process_time()
    html_extract.main_text("<p>x" + f"<{tag}>" * 100_000 + f"<p>{LONG}</p>" + "</div></p>" * 1000)
    assert time.process_time() - began < 20
    assert html_extract.main_text((f"<div><p>{LONG}</p>") * 20_000).count(LONG) == 20_000


def test_repeated_pages(spark):
    rows = [(1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (None, None, PAGES[0][0]), (2, "u", f"<p>{LONG}</p>" * 3000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and [r.text for r in got[:3]] == [PAGES[0][1]] * 3 and got[3].n_chars == 3000 * (len(LONG) + 2) - 2


def test_any_number_of_clashes(spark, monkeypatch):
    # Surrogates that clash by force: the first step of every card number is one and the same.
    real, cards = pii.surrogate, [f"4111 1111 1111 {k:04d}" for k in range(2000)]
    cards = [c for c in cards if any(e.kind == "card" for e in pii.detect(f"card {c} it"))][:60]
    rows = [(k, f"card {c} it") for k, c in enumerate(cards)] + [(None, None), (5, ""), (6, f"again {cards[0]} it and {cards[1]} it")]
    docs = table(spark, rows)

    def clashing(key, e, text, steps=1):
        return "4111 1111 1111 1111" if e.kind == "card" and steps == 1 and e.canonical[-1] in "02468" else real(key, e, text, steps)

    results = []
    for most in (10_000, 3, 0):
        monkeypatch.setattr(pii, "MOST_CLASHES", most)
        results.append(sorted(((r.doc_id, r.text, len(r.entities)) for r in pii.pseudonymised(docs, "k", make=clashing).collect()), key=repr))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    said = [t.split("card ")[1] for _, t, _ in results[0] if t and t.startswith("card ")]
    assert len(set(said)) == len(cards)
    assert [r.entity for r in pii.clashes(pii.pseudonymised(docs, "k", make=clashing, check=False).select(F.inline("entities"))).collect()]


def test_addresses_in_very_long_texts():
    import time

    old = re.compile(r"[\w.+%'-]*\w[\w.+%-]*@(?:[\w-]+\.)+[^\W\d_]{2,}")
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choices("ab@@..'' -_é9", k=25)) + "@x.de"
        assert [(e.start, e.end) for e in pii._addresses(text)] == [m.span() for m in old.finditer(text)], text
    began = time.process_time()
    for run in ("x" * 1_000_000, "x." * 500_000, "a@" * 300_000, "'" * 1_000_000, "1" * 300_000, "a:" * 300_000):
        assert [e.canonical for e in pii.detect(run + " anna@mail.org") if e.kind == "email"] == ["anna@mail.org"]
    assert time.process_time() - began < 30


def test_surrogates_keep_type_and_tell_apart(spark):
    key = b"k"
    one = "Mail anna.b@mail3.example.com or ANNA.B@MAIL3.example.com, call +1 (017) 555-7713 or +10175557713, card 4111 1111 1111 1111, host 8.8.4.4; Mrs Maria Keller and Анна Иванова."
    new, found = pii.replace(key, one)
    spelt = [one[s:e] for s, e, *_ in found]
    assert not any(x in new for x in spelt) and {"email", "phone", "card", "ip4", "given:f:latin", "given:f:cyrillic", "family"} <= {k for _, _, k, _, _ in found}
    names = [n for _, _, k, _, n in found if k.startswith("given:f:latin")]
    assert all(n in pii.GIVEN["f", "latin"] for n in names)
    emails = [n for _, _, k, _, n in found if k == "email"]
    assert emails[0].lower() == emails[1].lower() and emails[1][0].isupper()
    phones = [re.sub(r"\D", "", n) for _, _, k, _, n in found if k == "phone"]
    assert phones[0] == phones[1]
    card = next(n for _, _, k, _, n in found if k == "card")
    assert pii._luhn([int(c) for c in card if c.isdigit()])
    cycle = pii.Cycle(key, "t")
    made = {tuple(cycle.next([a, b], [7, 5])) for a in range(7) for b in range(5)}
    assert len(made) == 35 and all(cycle.next([a, b], [7, 5]) != [a, b] for a in range(7) for b in range(5))
    docs = table(spark, [(1, one), (2, None), (3, ""), (1, one), (None, "no one")])
    got = pii.pseudonymised(docs, "k").collect()
    assert sorted((r.doc_id or 0, len(r.entities)) for r in got) == [(0, 0), (1, len(found)), (1, len(found)), (2, 0), (3, 0)]
    clash = spark.createDataFrame([("card", "a", "1 2"), ("card", "b", "12"), ("card", "a", "12")], "kind string, entity string, surrogate string")
    assert [r.n_entities for r in pii.collisions(clash).collect()] == [2]


def test_surrogates_of_other_scripts(spark):
    one = "Dr 王伟 and Mr 李娜, Dr محمد, Mr Müller."
    new, found = pii.replace(b"k", one)
    names = {one[s:e]: n for s, e, _, _, n in found}
    assert set(names) == {"王伟", "李娜", "محمد", "Müller"} and len(set(names.values())) == 4
    assert not any(x in new for x in names) and "*" not in new and names["Müller"][1] != "ü"
    assert all("CJK" in unicodedata.name(c) for c in names["王伟"]) and all("ARABIC" in unicodedata.name(c) for c in names["محمد"])
    assert pii.pseudonymised(table(spark, [(1, "Dr 王伟 met Mr 李娜")]), "k").count() == 1


def test_later_mentions_of_a_name_have_its_surrogate():
    one = "Keller left before Mr Keller came; Keller's car, Dr 王伟, 王伟 too. Killer stays."
    new, found = pii.replace(b"k", one)
    names = {}
    for s, e, _, _, n in found:
        assert names.setdefault(one[s:e], n) == n
    assert [one[s:e] for s, e, *_ in found] == ["Keller"] * 3 + ["王伟"] * 2 and "Killer stays" in new and not any(x in new for x in names)


def test_given_names_depend_on_the_key(spark):
    made = {k: [pii.replace(k, f"{n} Keller")[0].split()[0] for n in pii.GIVEN["f", "latin"]] for k in (b"a", b"b", b"zzz")}
    assert all(sorted(v) == sorted(pii.GIVEN["f", "latin"]) and all(x != y for x, y in zip(v, pii.GIVEN["f", "latin"], strict=True)) for v in made.values())
    assert len({tuple(v) for v in made.values()}) == 3
    for n in (1, 2, 3, 40, 1000):
        cycle = pii.Cycle(b"k", "t")
        assert sorted(cycle.next([x], [n])[0] for x in range(n)) == list(range(n))
    # Of entities with one surrogate all but the first go further round.
    shared = spark.createDataFrame([("card", "a", "1 2"), ("card", "b", "12"), ("card", "c", "1-2"), ("ssn", "d", "12")], "kind string, entity string, surrogate string")
    assert {r.entity for r in pii.clashes(shared).collect()} == {"b", "c"}
    one = "Mr Keller, Mr Kellor"
    who = pii.entity_id(b"k", "family", "kellor")
    first, further = pii.replace(b"k", one)[1], pii.replace(b"k", one, {who: 1})[1]
    assert first[0] == further[0] and first[1][:4] == further[1][:4] and first[1][4] != further[1][4]


def test_fixity_of_rows_without_ids(spark):
    pages = spark.createDataFrame([(None, "u", f"page {k}", "x", "y") for k in range(200)] + [(-3, "u", "minus", "x", "y"), (4, None, None, "x", "y")], "page_id long, url string, html string, file string, hash string")
    h = fixity.page_hashes(pages)
    assert h.count() == 202 and h.groupBy("file").count().agg(F.max("count")).first()[0] < 20
    gone = h.where("record = -3").first().hash
    assert [(r.record, r.damage) for r in fixity.audit(h, h.where(F.col("hash") != gone)).collect()] == [(-3, "missing")]
    assert fixity.audit(h, fixity.page_hashes(pages)).count() == 0


def test_fixity_of_empty_and_very_long_pages(spark):
    kind = "page_id long, url string, html string"
    none = fixity.page_hashes(spark.createDataFrame([], kind))
    assert none.count() == 0 and fixity.audit(none, none).count() == 0
    pages = spark.createDataFrame([(1, "a", "x" * 3_000_000), (2, "b", ""), (3, None, None)], kind)
    h = fixity.page_hashes(pages)
    want = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: a\r\nContent-Length: 3000000\r\n\r\n" + b"x" * 3_000_000 + b"\r\n\r\n"
    assert {r.record: r.hash for r in h.collect()}[1] == hashlib.sha256(want).hexdigest() and h.count() == 3
    longer = fixity.page_hashes(pages.withColumn("html", F.when(F.col("page_id") == 1, F.concat("html", F.lit("x"))).otherwise(F.col("html"))))
    assert ("changed" in {r.damage for r in fixity.audit(h, longer).where("record = 1").collect()}) and fixity.audit(h, none).count() == 3 and fixity.audit(none, h).count() == 3


def test_fixity_finds_every_damage(spark):
    pages = spark.createDataFrame([(k, f"u{k}" if k % 7 else None, "x" * (k * 37 % 900)) for k in range(400)] + [(5, "u5", "again"), (None, None, None)], "page_id long, url string, html string")
    h = fixity.record_hashes(fixity.manifest(pages, records_a_file=50)).cache()
    assert sorted(map(tuple, fixity.page_hashes(pages, records_a_file=50).collect())) == sorted(map(tuple, h.collect()))
    bad = h.where("record <> 77").withColumn("hash", F.when(F.col("record").isin(3, 399), F.lit("z")).otherwise(F.col("hash")))
    got = fixity.audit(h, bad, leaf_bytes=2000, fan_out=4).collect()
    assert sorted((r.record, r.damage) for r in got) == [(3, "changed"), (77, "missing"), (399, "changed")]
    assert sorted(r.damage for r in fixity.audit(bad, h, leaf_bytes=2000, fan_out=4).collect()) == ["changed", "changed", "extra"]
    assert fixity.audit(h, h, leaf_bytes=2000).count() == 0 and fixity.audit(h.limit(0), h.limit(0)).count() == 0


def test_co_training_on_held_out_rows():
    r = random.Random(1)
    good = [" ".join(r.choices("the cat sat on a mat and saw more of it.".split() + [f"word{k}" for k in range(200)], k=60)) for _ in range(150)]
    junk = [" ".join(r.choices(["BUY!!", "NOW!!", "|", "$$$"], k=60)) for _ in range(150)]
    rows = [(t, 1.0) for t in good] + [(t, 0.0) for t in junk]
    r.shuffle(rows)
    x = quality.text_figures(pa.array([t for t, _ in rows]))
    meta = quality.meta_figures(pa.array(["en"] * 300), pa.array([None] * 300, pa.string()), pa.array([len(t) for t, _ in rows]))
    y = np.array([v for _, v in rows])
    model = quality.co_train(x[:100], meta[:100], y[:100], x[100:], meta[100:])
    assert ((model.scores(x[200:], meta[200:])[2] > 0.5) == y[200:]).mean() > 0.97


def test_co_training_learns_from_every_unlabelled_row(spark):
    # Two sources that no labelled row has, in the last 600 of 24,600 unlabelled rows.
    place = lambda n: zlib.crc32(n.encode()) % 127
    names = [n for n in (f"n{k}" for k in range(200)) if place(n) > max(place("a"), place("b"))]
    rare = sorted({place(n): n for n in names}.values())[:2]
    r, words = random.Random(3), [f"word{k}" for k in range(50)] + "the cat sat on a mat and saw more of it".split()
    good, junk = [" ".join(r.choices(words, k=20)) + "." for _ in range(50)], [" ".join(r.choices(["BUY!!", "NOW!!", "|", "$$$"], k=20)) for _ in range(50)]
    kind = lambda i: (i // 2) % 2
    rows = [(i, (junk if kind(i) else good)[r.randrange(50)], "en", ("a", "b")[kind(i)] if i < 24_200 else rare[kind(i)], 100) for i in range(24_800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = range(200)
    labels = spark.createDataFrame([(i, 1 - kind(i)) for i in ids], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    good_rare, junk_rare = quality._probability(model.meta.logit(quality.meta_figures(pa.array(["en"] * 2), pa.array(rare), pa.array([100, 100]))))
    assert good_rare > 0.8 and junk_rare < 0.2
    order = np.argsort(quality.K.mix(np.array(ids, np.int64).view(np.uint64)))
    x = quality.text_figures(pa.array([t for _, t, *_ in rows]))
    meta = quality.meta_figures(pa.array([v[2] for v in rows]), pa.array([v[3] for v in rows]), pa.array([v[4] for v in rows]))
    whole = quality.co_train(x[order], meta[order], np.array([1.0 - kind(i) for i in order]), x[200:], meta[200:])
    for a, b in ((model.text, whole.text), (model.meta, whole.meta)):
        assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_empty_tables_and_missing_labels(spark):
    none = table(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(none, quality.fit(none, labels)).count() == 0
    assert quality.scored(table(spark, texts()), quality.fit(table(spark, texts()), labels)).where("quality_scores.kept").count() == len(texts())
    assert exact_dedup.exact_classes(none).count() == 0 and mixing.mix(none, {"a": 1.0}).count() == 0
    assert spotsigs.fingerprints(none).count() == 0 and secret_scan.scan_versions(none).findings.count() == 0
    assert packing.pack(none, queries.tokenizer_path()).count() == 0 and ngram_join.near_classes(none).count() == 0
    assert pii.pseudonymised(none, "k").count() == 0


def test_near_copies_by_row_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    r = random.Random(5)
    base = [" ".join(f"v{r.randrange(10_000)}" for _ in range(40)) for _ in range(12)]
    rows = [(None if k % 4 == 0 else r.randrange(20), f"{base[k % 12]} end{k // 12}", k) for k in range(72)]  # six near copies each
    rows += [(1, base[0] + " end0", 100), (2, "clean text one of its own with words", 101), (2, base[3] + " end1", 102), (2, base[3] + " end1", 103), (7, None, 104), (7, "", 105), (None, "", 106)]
    rows += [(None, "no id and the very same text twice over", k) for k in (107, 108)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(v.n for v in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for _, t, _ in rows)]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    kept = collections.Counter(group[k] for k in range(len(rows)) if rows[k][2] in set(got))
    assert kept == collections.Counter(set(group)) and len(got) == len(set(got))
    for k, (i, _, n) in enumerate(rows):
        if n in got:
            ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k]]
            assert i == min((x for x in ids if x is not None), default=None)


def linked(sets, percent):
    """Class numbers of sets by brute force; empty ones are alone."""
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * (meet := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - meet):
            group = [group[a] if g == group[b] else g for g in group]
    return group


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import oracle

    d = oracle.DATA.replace("sf0.001", "sf0.01")  # the smaller one has no documents that are rejected
    run = dict(corpus_pipeline.STAGES)
    docs = queries.table(spark, d, "documents")
    columns = docs.columns

    def after(name, before):
        path = str(tmp_path / name.replace(" ", "-"))
        run[name](spark, before, d).write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "best-fit packing" or out.columns == columns
        return out, [r.asDict() for r in out.collect()]

    rows = [r.asDict() for r in docs.collect()]
    # 1: the same fits in memory, on all labelled and all unlabelled documents.
    known = {r.doc_id: r.quality for r in queries.table(spark, d, "labels").where("quality IS NOT NULL").collect()}
    order = np.array(sorted((r["doc_id"] for r in rows if r["doc_id"] in known)), np.int64)
    order = order[np.argsort(quality.K.mix(order.view(np.uint64)))]
    by_id = {r["doc_id"]: r for r in rows}

    def figures(some):
        return quality.text_figures(pa.array([r["text"] for r in some], pa.string())), quality.meta_figures(pa.array([r["lang"] for r in some], pa.string()), pa.array([r["source"] for r in some], pa.string()), pa.array([r["n_chars"] for r in some], pa.int64()))

    x, meta = figures([by_id[i] for i in order.tolist()])
    pool, pool_meta = figures([r for r in rows if r["doc_id"] not in known])
    model = quality.co_train(x, meta, np.array([float(known[i]) for i in order.tolist()]), pool, pool_meta)
    scores = model.scores(*figures(rows))[2]
    one, kept = after("quality classifier", docs)
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r, v in zip(rows, scores, strict=True) if v >= 0.5} and 0 < len(kept) < len(rows)
    # 2: of equal texts the greatest id.
    last = {}
    for r in kept:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        last[low] = max(last.get(low, r["doc_id"]), r["doc_id"])
    two, kept = after("exact dedup", one)
    assert sorted(r["doc_id"] for r in kept) == sorted(last.values())
    # 3: of each class of near texts the least id.
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in kept]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    least = {}
    for g, r in zip(linked(sets, 80), kept, strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    three, kept = after("n-gram Jaccard join", two)
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())
    # 4: all rows, in the order of an earliest-deadline schedule made step by step.
    four, mixed = after("mixing sources to target weights", three)
    assert sorted(map(repr, mixed)) == sorted(map(repr, kept))
    weights = mixing.tempered_weights(three)
    blocks = {r.doc_id: (r.source, r.block) for r in mixing.mix(three, weights).collect()}
    place = corpus_pipeline._row_order(four)
    ordered = [r.doc_id for r in four.select("doc_id", place.alias("at")).orderBy("at").collect()]
    met = list(dict.fromkeys(blocks[i] for i in ordered))
    assert len([k for k, _ in itertools.groupby(ordered, key=lambda i: blocks[i])]) == len(met)  # a block's rows stay together
    counts = collections.Counter(s for s, _ in met)
    for s, own in itertools.groupby(sorted(met, key=lambda m: (m[0], met.index(m))), key=lambda m: m[0]):
        assert [b for _, b in own] == sorted(b for t, b in met if t == s), counts
    # 5: the documents' own ids, whole, in sequences whose order is that of the mixture.
    _, pieces = after("best-fit packing", four)
    ids_of = packing.token_ids(queries.tokenizer_path())
    text = {r["doc_id"]: r["text"] or "" for r in mixed}
    total = {i: len(ids_of(t)) // 4 + 1 for i, t in text.items()}
    assert {i: sum(p["length"] for p in pieces if p["doc_id"] == i) for i in total} == total
    for p in pieces:
        ids = np.frombuffer(ids_of(text[p["doc_id"]]) + np.array([2], "<u4").tobytes(), "<u4")
        assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    first = collections.defaultdict(set)
    for p in pieces:
        first[p["sequence_id"]].add(ordered.index(p["doc_id"]))
    by_order = sorted((p["sequence_order"], min(first[p["sequence_id"]])) for p in pieces)
    assert [k for _, k in by_order] == sorted(k for _, k in by_order)


def test_pipeline_runs_as_registered(spark):
    import __spark_entry__
    import oracle

    got = __spark_entry__.queries()["pipeline"](spark, oracle.DATA)
    assert got.where("length > 0").count() > 0 and "sequence_order" in got.columns


def test_quality_of_nulls_repeats_ties_and_clashing_names(spark):
    r = random.Random(8)
    good, junk = "the cat sat on a mat and saw more of it .".split(), ["BUY!!", "NOW!!", "|", "$$$"]
    rows = [(i, " ".join(r.choices(good if i % 2 else junk, k=30)), "en", "s", 100, f"q{i}", "clash") for i in range(60)]
    rows += [(None, None, None, None, None, "q", "clash"), (5, "", "en", "s", 0, "q", "clash"), (None, "word " * 20_000, None, "s", 100_000, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_scores string, x string")
    # A label twice, two labels that disagree (the less counts), labels without an id, a value, or a document.
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (4, 1), (4, 0), (None, 1), (7, None), (8, 5), (9999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    # Another order of rows: a table built in it, as a sort below a join is dropped.
    again = quality.fit(spark.createDataFrame(r.sample(rows, len(rows)), docs.schema), spark.createDataFrame(labels.collect()[::-1], labels.schema))
    assert np.allclose(model.text.weights, again.text.weights, atol=1e-6) and np.allclose(model.weights, again.weights, atol=1e-6)
    out = quality.scored(docs, model)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = out.select("doc_id", "quality_scores.*").collect()
    assert all(0 <= v.score <= 1 and v.kept == (v.score >= 0.5) for v in got)
    assert sum((v.doc_id % 2 == 1) == v.kept for v in got if v.doc_id is not None and v.doc_id >= 40) >= 18


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import oracle

    assert oracle.differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == ""
