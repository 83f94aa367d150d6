"""Quality classifier by co-training of a text view and a metadata view.

The text view sees figures of the text alone (shares of kinds of characters over
the whole text and its worst windows, repetition of words and triples); the
metadata view sees language, source and length.  Both are additive logistic
models on binned figures.  Over some rounds, each labels unlabelled documents of
which it is sure, after calibration on held-out labels, and hands these to the
other.  At the end the calibrated views are combined, again on held-out labels,
and score every document.

In each round every unlabelled document is scored, and all of which a view is
sure are handed over: what a fit needs of them are sums over pairs of bins, which
the cluster adds up in each step of the fit.  Only labelled documents come to the
driver, as figures, at most ``most_labelled``, taken by hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm import kernels as K
from trendloom.llm.shared import small_batches, stored

WINDOW = 256
BINS = 16
BLOCK = 2048  # rows of which sums are made at a time
_KINDS = 10
# Kinds of bytes: 0 other letters, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stops, 7 marks, 8 bars and brackets, 9 control.
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"?-", b"!#$%&*@^~+=", b"|<>[]{}()\\/_`"), 1):
    _KIND[list(_chars)] = _k
_KIND[[*range(0, 9), *range(14, 32), 127]] = 9


@dataclass(frozen=True)
class Options:
    most_labelled: int = 20_000
    rounds: int = 3
    sure: float = 0.97
    keep_from: float = 0.5


def text_figures(column: pa.Array) -> np.ndarray:
    """A row of figures for each text; an empty or null text has zeros."""
    raw, offsets = K.utf8(column)
    out = []
    for first, last in K.chunks(offsets):
        part = offsets[first : last + 1] - offsets[first]
        out.append(_figures(raw[offsets[first] : offsets[last]], part))
    return np.concatenate(out) if out else np.zeros((0, N_TEXT))


def _figures(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    sizes = np.diff(at)
    docs = len(sizes)
    windows = np.maximum(1, -(-sizes // WINDOW))
    begin = np.concatenate(([0], np.cumsum(windows)))
    doc = np.repeat(np.arange(docs), sizes)
    window = begin[doc] + ((np.arange(len(raw)) - at[doc]) // WINDOW)
    counts = np.bincount(window * _KINDS + _KIND[raw], minlength=begin[-1] * _KINDS).reshape(-1, _KINDS).astype(float)
    whole = np.add.reduceat(counts, begin[:-1], axis=0)
    share = whole / np.maximum(1, sizes)[:, None]
    of_window = counts / np.maximum(1, counts.sum(axis=1))[:, None]
    worst = np.maximum.reduceat(of_window, begin[:-1], axis=0)
    odd = np.add.reduceat((of_window[:, [2, 7, 8]] > (0.3, 0.1, 0.06)).astype(float), begin[:-1], axis=0) / windows[:, None]
    words, w_at = K.word_hashes(raw, at)
    count = np.diff(w_at)
    n = np.maximum(1, count)
    same = np.zeros(len(words) + 1)
    if len(words) > 1:
        same[1:-1] = np.cumsum(words[1:] == words[:-1])
        same[-1] = same[-2]
    repeats = (same[np.maximum(w_at[1:] - 1, w_at[:-1])] - same[w_at[:-1]]) / n if len(words) else np.zeros(docs)
    triples, t_at = K.shingles(words, w_at, 3)
    distinct = np.array([[len(np.unique(words[w_at[i] : w_at[i + 1]])), len(np.unique(triples[t_at[i] : t_at[i + 1]]))] for i in range(docs)], float).reshape(docs, 2)
    triple_share = distinct[:, 1] / np.maximum(1, np.diff(t_at))
    return np.column_stack([share, worst[:, [2, 3, 6, 7, 8, 9]], odd, (sizes - whole[:, 4] - whole[:, 5]) / n, distinct[:, 0] / n, triple_share, repeats, np.log1p(count)])


N_TEXT = 10 + 6 + 3 + 5
N_META = 3
HASHES = (15, 127)  # bins of hashes of language and source


def meta_figures(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Bins of hashes of language and source, and the length's logarithm; nulls have a bin of their own."""

    def hashed(column: pa.Array, bins: int) -> np.ndarray:
        raw, offsets = K.utf8(column)
        values = np.array([hash_bytes(raw[offsets[i] : offsets[i + 1]].tobytes()) % bins for i in range(len(column))], float).reshape(-1)
        return np.where(np.asarray(column.is_valid()), values, bins)

    length = np.log1p(np.maximum(0, np.asarray(n_chars.cast(pa.float64()).fill_null(0.0))))
    return np.column_stack([hashed(lang, HASHES[0]), hashed(source, HASHES[1]), length])


def hash_bytes(value: bytes) -> int:
    import zlib

    return zlib.crc32(value)


@dataclass
class View:
    """An additive logistic model: cuts of each figure, a weight for each bin, and a calibration line."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)

    def bins(self, x: np.ndarray) -> np.ndarray:
        at, out = 1, []
        for k, cut in enumerate(self.cuts):
            out.append(at + np.searchsorted(cut, x[:, k], side="left"))
            at += len(cut) + 1
        return np.stack(out, axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.weights[0]

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.line[0] * (self.weights[bins].sum(axis=1) + self.weights[0]) + self.line[1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * self.raw(x) + self.line[1]


def _cuts(x: np.ndarray, whole_numbers: bool) -> list[np.ndarray]:
    """Cuts by the labelled rows; each hash of a language or source has its own bin, whether they show it or not."""
    out = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        edges = (values[1:] + values[:-1]) / 2
        if whole_numbers and k < 2:
            edges = np.arange(HASHES[k]) + 0.5
        elif len(edges) > BINS - 1:
            edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        out.append(edges)
    return out


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic fit; sums gives slope and curvature of all rows at some weights."""
    w = start.copy()
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        slope, curve = sums(w)
        move = np.linalg.solve(curve + np.diag(penalty), slope - penalty * w)
        w += move
        if np.abs(move).max() < 1e-5:
            break
    return w


def _sums(bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the log likelihood of rows given by the places of their bins in w."""
    slope, curve, size = np.zeros(len(w)), np.zeros(len(w) ** 2), len(w)
    for first in range(0, len(y), BLOCK):
        at = np.column_stack([np.zeros(len(y[first : first + BLOCK]), np.int64), bins[first : first + BLOCK]])
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -30, 30)))
        slope += np.bincount(at.ravel(), np.repeat(y[first : first + BLOCK] - p, at.shape[1]), size)
        weight = p * (1 - p)
        for k in range(at.shape[1]):
            pair = at[:, k :] + (at[:, k] * size)[:, None]
            rows = np.repeat(weight, pair.shape[1])
            low, high = int(at[:, k].min()) * size, (int(at[:, k].max()) + 1) * size
            curve[low:high] += np.bincount(pair.ravel() - low, rows, high - low)
    curve = curve.reshape(size, size)
    return slope, curve + np.triu(curve, 1).T


def _labels(bins: list[np.ndarray], past: list[list[View]], sure: float) -> list[np.ndarray]:
    """What each view says of the rows, by the first round in which it was sure; NaN where it never was."""
    out = []
    for v in (0, 1):
        said = np.full(len(bins[v]), np.nan)
        for views in past:
            p = _probability(views[v].of_bins(bins[v]))
            now = np.isnan(said) & (np.maximum(p, 1 - p) >= sure)
            said[now] = p[now] > 0.5
        out.append(said)
    return out


def pool_sums(bins: list[np.ndarray], past: list[list[View]], weights: list[np.ndarray | None], sure: float) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each view with weights, slope and curvature of the rows of which the other view is or was sure."""
    said = _labels(bins, past, sure)
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for v, w in enumerate(weights):
        own = ~np.isnan(said[1 - v])
        out.append(None if w is None else _sums(bins[v][own], said[1 - v][own], w))
    return out


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    rows = np.column_stack([np.ones(len(x)), view.raw(x)])

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _probability(rows @ w)
        return rows.T @ (y - p), (rows * (p * (1 - p))[:, None]).T @ rows

    line = _newton(sums, np.zeros(2), 1e-3)
    view.line = (float(line[1]), float(line[0]))
    return view


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray  # of 1, the text's and the metadata's calibrated log-odds

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _probability(a), _probability(b), _probability(self.weights[0] + self.weights[1] * a + self.weights[2] * b)


#: Of past views and present weights (None: not asked), the sums of ``pool_sums`` over all unlabelled rows.
PoolSums = Callable[[list[list[View]], list["np.ndarray | None"]], list["tuple[np.ndarray, np.ndarray] | None"]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, options: Options = Options()) -> Model:
    """Fits both views to labelled rows and a pool, all in memory."""

    def of_pool(cuts: list[list[np.ndarray]]) -> PoolSums:
        bins = [View(cuts[v], np.zeros(0)).bins(x) for v, x in enumerate((pool_text, pool_meta))]
        return lambda past, weights: pool_sums(bins, past, weights, options.sure)

    return _co_train(text, meta, y, of_pool, options)


def _co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, of_pool: Callable[[list[list[np.ndarray]]], PoolSums], options: Options) -> Model:
    """Fits both views; every fifth labelled row is held out for calibration and combination."""
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 10 else np.ones(len(y), bool)
    train = ~held if len(y) >= 10 else held
    own, held_x = (text[train], meta[train]), (text[held], meta[held])
    cuts = [_cuts(own[v], whole_numbers=v == 1) for v in (0, 1)]
    bins = [View(cuts[v], np.zeros(0)).bins(own[v]) for v in (0, 1)]
    pool = of_pool(cuts)
    past: list[list[View]] = []
    weights = [np.zeros(1 + sum(len(c) + 1 for c in cuts[v])) for v in (0, 1)]
    for r in range(options.rounds + 1):
        going, ridge = [True, True], 1.0
        for _ in range(25):
            handed = pool(past, [w if g else None for w, g in zip(weights, going, strict=True)]) if past else [None, None]
            for v in (0, 1):
                if not going[v]:
                    continue
                slope, curve = _sums(bins[v], y[train], weights[v])
                if handed[v] is not None:
                    slope, curve = slope + handed[v][0], curve + handed[v][1]
                penalty = np.full(len(slope), ridge)
                penalty[0] = 1e-6
                move = np.linalg.solve(curve + np.diag(penalty), slope - penalty * weights[v])
                weights[v] = weights[v] + move
                going[v] = np.abs(move).max() >= 1e-4
            if not any(going):
                break
        # The order in which the cluster adds up shows in the last digits only.
        weights = [np.round(w, 9) for w in weights]
        views = [_calibrated(View(cuts[v], weights[v]), held_x[v], y[held]) for v in (0, 1)]
        past.append(views)
    a, b = (views[v].logit(held_x[v]) for v in (0, 1))
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
    # Independent views: the log-odds add up and the base rate counts once; the fit may only move near that.
    design = np.column_stack([np.ones(len(a)), a, b])
    prior = np.array([-base, 1.0, 1.0])
    shift = _newton_around(design, y[held], prior, 5.0)
    return Model(views[0], views[1], shift)


def _newton_around(design: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray:
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * (w - prior)
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of N_TEXT + N_META figures, as rows."""
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)]).reshape(-1, N_TEXT + N_META)


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    """Text, language, source and length; absent metadata columns are null."""
    has = set(docs.columns)
    column = lambda c, t: (F.col(f"`{c}`") if c in has else F.lit(None)).cast(t)
    return [column(text_col, "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long")]


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Co-trained model; None if the labels do not show both classes (or there are none)."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    sample = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(options.most_labelled).groupBy("__id").agg(F.min("__y").alias("__y"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), *(c.alias(n) for c, n in zip(_inputs(docs, text_col), ("text", "lang", "source", "n_chars"), strict=True)))

    @F.arrow_udf("array<double>")
    def figures(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        x = np.column_stack([text_figures(text), meta_figures(lang, source, n_chars)])
        return pa.array(list(x), pa.list_(pa.float64()))

    made = figures("text", "lang", "source", "n_chars").alias("x")
    # Bounded by most_labelled, so it may be broadcast.
    found = rows.join(F.broadcast(sample), "__id").select("__id", "__y", F.xxhash64("text", "lang", "source", "n_chars").alias("__hash"), made)
    # Of rows that repeat a labelled id, the one with the least hash: the order of rows decides nothing.
    labelled = found.groupBy("__id", "__y").agg(F.min_by("x", "__hash").alias("x")).toArrow().sort_by("__id")
    y = labelled["__y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(K.mix(labelled["__id"].to_numpy().astype(np.int64).view(np.uint64)))
    x, y = _matrix(labelled["x"])[order], y[order]
    return _co_train(x[:, :N_TEXT], x[:, N_TEXT:], y, lambda cuts: _on_cluster(rows.join(F.broadcast(sample.select("__id")), "__id", "left_anti"), cuts, options), options)


PARTS = 4
_PART = "v long, cells binary, x binary"


def _part(v: int, whole: np.ndarray) -> pa.RecordBatch:
    """A view's sums as one row: the places and values of those that are not zero."""
    at = np.flatnonzero(whole)
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([whole[at].tobytes()], pa.binary())], ["v", "cells", "x"])


def _added(batches: Iterable[pa.RecordBatch], size: list[int | None]) -> list[np.ndarray | None]:
    """The rows of ``_part`` added up for each view."""
    out = [None if n is None else np.zeros(n) for n in size]
    for batch in batches:
        for row in batch.to_pylist():
            out[row["v"]][np.frombuffer(row["cells"], np.int64)] += np.frombuffer(row["x"], np.float64)
    return out


def _on_cluster(pool: DataFrame, cuts: list[list[np.ndarray]], options: Options) -> PoolSums:
    """Sums over the rows of pool, each stored as the numbers of its bins, a byte a figure."""
    empty = [View(c, np.zeros(0)) for c in cuts]
    starts = [np.concatenate(([1], 1 + np.cumsum([len(c) + 1 for c in own])[:-1])).astype(np.int64) for own in cuts]
    width = [len(c) for c in cuts]

    @F.arrow_udf("binary")
    def binned(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        figures = (text_figures(text), meta_figures(lang, source, n_chars))
        made = np.column_stack([v.bins(x) - s for v, x, s in zip(empty, figures, starts, strict=True)]).astype(np.uint8)
        return pa.array([row.tobytes() for row in made], pa.binary())

    table = stored(pool.select(binned("text", "lang", "source", "n_chars").alias("bins")), "bins")

    def sums(past: list[list[View]], weights: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[list[np.ndarray] | None] = [None if w is None else [np.zeros(len(w)), np.zeros((len(w), len(w)))] for w in weights]
            for batch in batches:
                raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, sum(width)).astype(np.int64)
                bins = [raw[:, : width[0]] + starts[0], raw[:, width[0] :] + starts[1]]
                for t, made in zip(total, pool_sums(bins, past, weights, options.sure), strict=True):
                    if t is not None and made is not None:
                        t[0] += made[0]
                        t[1] += made[1]
            for v, t in enumerate(total):
                if t is not None:
                    yield _part(v, np.concatenate([t[0], np.triu(t[1]).ravel()]))

        size = [None if w is None else len(w) + len(w) ** 2 for w in weights]

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for v, whole in enumerate(_added(batches, size)):
                if whole is not None:
                    yield _part(v, whole)

        # A row for each task and view, then for each of PARTS: the driver gets a bounded number.
        made = table.mapInArrow(run, _PART).repartition(PARTS).mapInArrow(combine, _PART).toArrow()
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for w, whole in zip(weights, _added(made.to_batches(), size), strict=True):
            if w is None:
                out.append(None)
                continue
            curve = whole[len(w) :].reshape(len(w), len(w))
            out.append((whole[: len(w)], curve + np.triu(curve, 1).T))
        return out

    return sums


def scored(docs: DataFrame, model: Model | None, options: Options = Options(), text_col: str = "text", name: str = "quality_scores") -> DataFrame:
    """docs with the struct column ``name``: text_score, meta_score, score and kept.

    An existing column of that name is replaced.  Null or empty text is scored by
    figures of zero like any other; without a model (no labels of both classes)
    scores are null and every row is kept.  Nulls in metadata have a bin of their
    own.  An empty table gives an empty one.
    """
    kind = "struct<text_score:double,meta_score:double,score:double,kept:boolean>"
    if model is None:
        return docs.withColumn(name, F.expr(f"CAST(named_struct('text_score', NULL, 'meta_score', NULL, 'score', NULL, 'kept', true) AS {kind})"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf(kind)
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        a, b, c = shared.value.scores(text_figures(text), meta_figures(lang, source, n_chars))
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(c >= options.keep_from)], ["text_score", "meta_score", "score", "kept"])

    return docs.withColumn(name, score(*_inputs(docs, text_col)))
