"""Alignment, concurrency and toxicity against brute force, on small tables with nulls, ties and repeated rows."""

import collections
import hashlib
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from trendloom.llm import alignment, concurrency, queries, toxicity

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
KIND = "doc_id long, text string, uid string, pairs string, n string, toxic string, id string, win string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in rows], KIND)


def aligned_by_hand(texts):
    """Every text's n_a, n_b, groups, links and digest, token by token; and the counts of pairs."""
    import sentencepiece

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    out, counts = [], collections.Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
            out.append(None)
            continue
        spans = []
        for side in (left, right):
            at = 0
            spans.append([])
            for i, t in side:
                spans[-1].append((at, at + len(t), i))
                at += len(t)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(left) < 300 else None
        if links is None:  # the same by two pointers
            links, i, j = [], 0, 0
            while i < len(left) and j < len(right):
                links.append((left[i][0], right[j][0]))
                ends = spans[0][i][1], spans[1][j][1]
                i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
        groups, last = [], 0
        for cut in sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]}):
            groups.append("|".join(",".join(str(s[2]) for s in side if last < s[1] <= cut) for side in spans))
            last = cut
        counts.update(links)
        out.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in out], len(counts)


@pytest.mark.parametrize("frequent", [0, 40, alignment.FREQUENT])
def test_alignment_equals_brute_force(spark, frequent):
    r = random.Random(3)
    words = "the over reheating naïve Straße 東京 прове́рка 12,345 <|endoftext|> <s> </s> <unk> don't  \t\n 👩‍👩‍👧 zu-be pass=word".split(" ")
    rows = [(k, " ".join(r.choices(words, k=r.randrange(1, 40)))) for k in range(40)]
    rows += [(1, rows[1][1]), (1, "another text"), (None, "no id"), (None, None), (50, None), (51, ""), (52, "a▁b"), (53, " "), (54, "\x00 nul"), (55, "x" * 20_000), (56, "ab " * 8_000), (57, "  lead and trail  ")]
    out = alignment.align(documents(spark, rows), A, B, frequent=frequent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, _ = aligned_by_hand([t for _, t in rows])
    assert sorted(map(repr, ((i, *w) for (i, _), w in zip(rows, want, strict=True)))) == sorted(repr(tuple(x)) for x in out.collect())


def test_alignment_of_no_rows(spark):
    assert alignment.align(documents(spark, [(1, "x")]).where("doc_id > 1"), A, B).collect() == []


def test_tasks_hand_pairs_on_early(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    lists = [list(range(k, k + 5)) for k in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x]), pa.array([[2] * 5], pa.list_(pa.int32()))], names=["pairs", "times"]) for x in lists]
    got = collections.Counter()
    for batch in alignment._count(batches):
        for p, n in zip(*batch.to_pydict().values(), strict=True):
            got[p] += n
    assert got == collections.Counter({p: 2 * sum(p in x for x in lists) for p in range(24)})


def swept_by_hand(intervals, everyone=-2):
    out = []
    groups = {g for g, *_ in intervals} | ({everyone} if intervals else set())
    for g in groups:
        own = [x for x in intervals if g in (x[0], everyone)]
        rows, before = [], (0, 0)
        for t in sorted({x[1] for x in own} | {x[2] for x in own if x[2] is not None}):
            live = [x for x in own if x[1] <= t and (x[2] is None or t < x[2])]
            now = len(live), sum(x[3] for x in live)
            if now != before:
                rows.append((t, *now))
            before = now
        most = max((r[1] for r in rows), default=0)
        for k, (t, n, cents) in enumerate(rows):
            out.append((g, t, rows[k + 1][0] if k + 1 < len(rows) else None, n, cents, max(r[1] for r in rows[: k + 1]), n == most))
    return sorted(out, key=repr)


@pytest.mark.parametrize("units", [1, 2, 7, 1440])
def test_concurrency_equals_brute_force(spark, units):
    r = random.Random(units)
    rows = []
    for _ in range(150):
        start = 60 * r.randrange(-40, 60)
        stop = None if r.random() < 0.1 else start + 60 * r.randrange(1, r.choice([3, 20, 90]))
        rows.append((r.choice([-1, 0, 3]), start, stop, r.choice([0, 5, -5, 70])))
    rows += [rows[0], (7, 0, 60, 1), (7, 60, 120, 1), (8, 60, 120, 0), (8, 0, 60, 0)]  # repeats; a change that cancels out
    got = concurrency.concurrency(spark.createDataFrame(rows, "group int, start long, stop long, cents long"), units=units)
    assert got.columns == ["nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == swept_by_hand(rows)


def test_the_tree_counts_what_holds_a_moment():
    r = np.random.default_rng(0)
    lo = r.integers(-1, 99, 400)
    hi = np.minimum(lo + r.integers(1, 60, 400), 100)
    values = r.integers(-5, 9, (400, 2))
    moments = np.arange(-1, 100)
    got = concurrency.IntervalTree(lo, hi, values, 100).stabbed(moments)
    assert [list(x) for x in got] == [list(values[(lo <= t) & (hi > t)].sum(axis=0)) for t in moments]
    assert not concurrency.IntervalTree(lo[:0], hi[:0], values[:0], 100).stabbed(moments).any()


def test_sales_with_nulls_repeats_ties_and_clashing_names(spark):
    day = datetime(2024, 1, 1)
    hour = timedelta(hours=1)
    sales = spark.createDataFrame(
        [(1, 10, 1.005, day + 59 * timedelta(seconds=1), "c"), (2, 11, None, day, "c"), (3, None, 2.0, day, "c"), (4, 99, 3.0, day, "c"), (5, 10, 4.0, None, "c"), (6, 10, 5.0, day + 400 * 24 * hour, "c"), (None, 12, 6.0, day, "c"), (1, 10, 1.005, day, "c")],
        "sale_id long, client_id long, total double, sold_at timestamp_ntz, stop string",
    )
    lines = spark.createDataFrame([(1, day + hour, "c"), (1, day, "c"), (1, None, "c"), (2, None, "c"), (6, day, "c"), (None, day, "c"), (77, day, "c")], "sale_id long, shipped_at timestamp_ntz, group string")
    clients = spark.createDataFrame([(10, 4, "c"), (10, 6, "c"), (11, None, "c"), (12, 5, "c"), (None, 9, "c")], "client_id long, nation_id int, start string")
    t, week = 1704067200, 7 * 86400
    want = [(4, t, t + 3600 + week, 100), (4, t, t + 3600 + week, 100), (-1, t, None, 0), (-1, t, None, 200), (-1, t, None, 300), (5, t, None, 600)]
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = concurrency.sale_intervals(sales, lines, clients)
            assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)
            assert sorted((tuple(x) for x in concurrency.concurrency(got).collect()), key=repr) == swept_by_hand(want)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert concurrency.concurrency(concurrency.sale_intervals(sales.limit(0), lines.limit(0), clients.limit(0))).collect() == []


def test_peak_concurrency_equals_sql(spark):
    from oracle import DATA, differences

    assert not differences(spark, queries.QUERIES["op12_peak_concurrency"], queries.ORACLES["op12_peak_concurrency"], DATA)


def insulting(n=500, seed=1):
    r = random.Random(seed)
    syllables = "ta re mi sol ki ver ton an der ich que los".split()
    made = lambda: "".join(r.choices(syllables, k=r.randrange(1, 5)))
    rows = []
    for k in range(n):
        words, toxic = [made() for _ in range(r.randrange(5, 60))], k % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["blockhead", "nitwit", "scoundrel"])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_finds_held_out_texts(spark):
    rows = insulting()
    docs, labels = documents(spark, [x[:2] for x in rows]), spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).toPandas().sort_values("doc_id")
    held = np.asarray([zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in rows])
    assert (got["held_out"] == held).all() and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5) == got["predicted"]).all()
    truth = np.asarray([t for *_, t in rows]) == 1
    predicted = got["predicted"].to_numpy() == 1
    assert predicted[held & truth].mean() > 0.9 and predicted[held & ~truth].mean() < 0.05
    # Labels of held-out rows change nothing, nor does the order of rows.
    other = spark.createDataFrame([(k, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, _, t in reversed(rows)], "doc_id long, toxic int")
    again = toxicity.fit(documents(spark, [x[:2] for x in reversed(rows)]).repartition(3), other)
    assert again.toxic == model.toxic and again.ordinary == model.ordinary and np.allclose(again.weights, model.weights)
    # Whole texts count: an insult behind a million other letters is seen.
    long = " ".join(x[1] for x in rows if not x[2]) * 30
    edge = documents(spark, [(1, None), (1, ""), (None, "..."), (2, "x" * 200_000), (3, long), (4, long + " blockhead nitwit scoundrel"), (5, rows[0][1]), (5, rows[0][1])])
    found = toxicity.scored(edge, model).toPandas()
    assert len(found) == 8 and found["score"].notna().all()
    by = {k: list(v) for k, v in found.groupby("doc_id")["score"]}
    assert by[1][0] == by[1][1] and by[5][0] == by[5][1] and by[4][0] > by[3][0]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)], [(1, None), (None, 1)], [(1, 1), (2, 0), (3, 1), (4, 0), (2, 1)]])
def test_toxicity_with_few_labels(spark, labels):
    docs = documents(spark, [(k, f"word{k} and") for k in range(6)])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.fit(docs, table)).toPandas()
    assert len(out) == 6 and out["score"].between(0, 1).all()
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), table)).collect() == []


def test_windows_hold_every_letter():
    for text in ("One two-three", "x" * 1000, "東京 " * 50, None, "", "..."):
        assert "".join(toxicity.windows(text)) == "".join(c for c in (text or "").lower() if c.isalnum() or c == "_")
    assert isinstance(toxicity._drawn(pd.DataFrame({"win": [], "n0": []}), "n0", 1), list)
