"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A window is a word with the blanks around it, every character written as two
bytes of a fixed code, so that a match of the compressor need only be two letters
long.  Both compressors know the same common dictionary of
ordinary text, and behind it one a dictionary of toxic text, the other one more
of ordinary text, as long.  A window's distance is the number of bytes by which the
toxic side makes it shorter.  All dictionaries are trained by zstandard; the toxic
one on the windows that stand in significantly more of the toxic texts, the last
ordinary one, in a second round, also on the ordinary windows that the first
toxic one shortens.  What the distances of a text say is weighed by a logistic
fit, and its threshold set, on labelled texts that trained no dictionary; of several
trainings, each from windows drawn anew, the one that does best on these is kept.

Each window is compressed behind a lead of 64 bytes that both dictionaries end
with: without it, zstandard stores windows as short as a word as they are.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import small_batches, stored

LEVEL = 12
DICTIONARY, OWN = 8192, 16384  # bytes of the common dictionary, and of each side's own
WIDTH = 2  # bytes of a character's code
LONGEST = 48  # characters of a window; a longer run of letters is several
LABELLED = 10_000  # most labelled texts of either kind that are learned from
CHARACTERISTIC, ORDINARY = 400, 60_000  # most windows that dictionaries are trained on
SIGNIFICANT = 5.0  # standard deviations between the shares of toxic and of ordinary texts
DRAWN = 40_000  # windows drawn for a dictionary, by their numbers of texts
TRAININGS = 4  # sets of dictionaries that are drawn and trained; that with the best F1 on the calibrating texts is kept
HARD = 4  # bytes from which an ordinary window is one for the second round
STEPS = (4, 6, 8, 10)  # distances from which windows are counted
MEMO = 400_000  # windows that a worker remembers

_WORDS = re.compile(r"\w+")
_LEAD = hashlib.sha512(b"lead").digest()
FEATURES = 3 + 2 * len(STEPS)


def _codes() -> np.ndarray:
    """A fixed scattered code of WIDTH bytes for each UTF-16 unit."""
    x = np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.uint8).reshape(-1, 8)[:, :WIDTH].copy()


_CODES = _codes()


def windows(text: str | None) -> list[str]:
    """The text's words in lower case, whole; very long ones in parts."""
    found = _WORDS.findall((text or "").lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def coded(window: str, before: str = " ") -> bytes:
    units = f"{before}{window} ".encode("utf-16-le", "surrogatepass")
    return _CODES[np.frombuffer(units, dtype="<u2")].tobytes()


def _dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained by zstandard on samples of eight windows; where these are too few for it, their last bytes."""
    joined = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    try:
        return zstandard.train_dictionary(size, joined, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(joined)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(compressor: zstandard.ZstdCompressor, found: list[bytes]) -> np.ndarray:
    sizes = np.asarray([len(w) for w in found], dtype=np.uint64) + np.uint64(len(_LEAD))
    starts = np.cumsum(sizes) - sizes
    held = zstandard.BufferWithSegments(b"".join(_LEAD + w for w in found), np.stack([starts, sizes], axis=1).tobytes())
    return np.asarray([len(x) for x in compressor.multi_compress_to_buffer(held, threads=1)], dtype=np.int64)


@dataclasses.dataclass(frozen=True)
class Model:
    """Dictionaries, scale and weights of the features, and the score where nothing could be learned."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    share: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.share)
        x = (features - np.asarray(self.mean)) / np.asarray(self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.asarray(self.weights[1:]) + self.weights[0], -40, 40)))


class Distances:
    """Distances of windows, remembered up to a bound."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary, self.known = _compressor(toxic), _compressor(ordinary), {}

    def __call__(self, found: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(found) if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = list(dict.fromkeys(found))
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            raw = [coded(w) for w in part]
            self.known.update(zip(part, (_lengths(self.ordinary, raw) - _lengths(self.toxic, raw)).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))

    def features(self, text: str | None) -> list[float]:
        """Largest distance, mean of the three largest, logarithm of the number of windows; for each step, how many reach it, and their share."""
        found = windows(text)
        if not found:
            return [0.0] * FEATURES
        d = self(found)
        top = np.sort(np.partition(d, max(len(d) - 3, 0))[-3:])
        counts = [int((d >= s).sum()) for s in STEPS]
        return [float(top[-1]), float(np.maximum(top, 0).sum() / 3), float(np.log1p(len(d))), *np.log1p(counts), *(100 * c / len(d) for c in counts)]


_loaded: dict[tuple[bytes, bytes], Distances] = {}


def distances(model: Model) -> Distances:
    """One for each Python worker."""
    key = (model.toxic, model.ordinary)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Distances(*key)
    return _loaded[key]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: its id's text has a CRC-32 that five divides; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _counted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of either kind each window stands."""
    for frame in frames:
        n: dict[str, list[int]] = {}
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            for w in set(windows(text)):
                n.setdefault(w, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame({"win": list(n), "n0": [x[0] for x in n.values()], "n1": [x[1] for x in n.values()]})


def _drawn(found: pd.DataFrame, numbers: str, seed: int) -> list[bytes]:
    """DRAWN windows, each as often as its number of texts has it."""
    if not len(found):
        return []
    r = np.random.default_rng(seed)
    p = found[numbers].to_numpy(float)
    return [coded(found["win"].iloc[i], "") for i in r.choice(len(found), DRAWN, p=p / p.sum())]


def trained(characteristic: pd.DataFrame, ordinary: pd.DataFrame, seed: int = 0) -> tuple[bytes, bytes]:
    """The dictionaries of the toxic and of the ordinary side, after the second round.

    Each begins with the common one, whose tables hold for both; zstandard takes
    all behind them as content, the few bytes of the other's tables too.
    """
    common = _dictionary(_drawn(ordinary, "n0", 10 * seed + 1))
    toxic = _dictionary(_drawn(characteristic, "n1", 10 * seed + 2), OWN)
    other = _drawn(ordinary, "n0", 10 * seed + 3)
    first = Distances(common + toxic + _LEAD, common + _dictionary(other, OWN) + _LEAD)
    hard = ordinary[first(list(ordinary["win"])) >= HARD] if len(ordinary) else ordinary
    if len(hard):
        other = _drawn(hard, "n0", 10 * seed + 4)[: DRAWN // 2] + other[: DRAWN // 2]
    return common + toxic + _LEAD, common + _dictionary(other, OWN) + _LEAD


def calibrated(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, tuple, tuple, tuple]:
    """The best F1 of any threshold; mean, scale and weights of a logistic fit, shifted so that 0.5 is that threshold."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(features)), (features - mean) / scale))
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge * len(x)
    keep[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - toxic) + keep @ w)
    logit = x @ w
    order = np.argsort(-logit, kind="stable")
    caught = np.cumsum(toxic[order])
    f1 = 2 * caught / (np.arange(1, len(order) + 1) + toxic.sum())
    best = int(np.argmax(f1))
    w[0] -= (logit[order[best]] + logit[order[min(best + 1, len(order) - 1)]]) / 2
    return float(f1[best]), tuple(mean), tuple(scale), tuple(w)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``most`` labelled texts of either kind, the least by hash of the id, none of them held out.

    Of several labels of an id the largest counts, null labels do not.  Windows of
    three fifths of these texts are counted on the cluster; the driver gets at most
    CHARACTERISTIC and ORDINARY of them, to train the dictionaries, and the features of the
    other texts, a row an id, to calibrate.  Without labels of both kinds every
    score is the share of toxic ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("id")))
    # Two bounded lists of ids; what is broadcast has 2 * most rows at most.
    taken = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    sample = stored(taken[0].unionByName(taken[1]), "labelled-ids")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = stored(rows.join(F.broadcast(sample), F.col("__doc") == F.col("id")).select("id", "text", "toxic"), "labelled-texts")
    trains = (F.crc32(F.col("id").cast("string")) / 5).cast("long") % 5 < 3
    sizes = {r["toxic"]: r["n"] for r in texts.where(trains).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").count().withColumnRenamed("count", "n").collect()}
    share = seen.get(1, 0) / max(1, sum(seen.values()))
    if not sizes.get(0) or not sizes.get(1):
        return Model(share=share)
    counts = texts.where(trains).select("text", "toxic").mapInPandas(_counted, "win string, n0 long, n1 long").groupBy("win").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = stored(counts, "windows")
    both = (F.col("n0") + F.col("n1")) / (sizes[0] + sizes[1])
    z = (F.col("n1") / sizes[1] - F.col("n0") / sizes[0]) / F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    characteristic = counts.withColumn("z", z).where((F.col("z") > SIGNIFICANT) & (F.col("n1") >= 3)).orderBy(F.desc("z"), "win").limit(CHARACTERISTIC).toPandas()
    ordinary = counts.where("n0 > 0").orderBy(F.xxhash64("win"), "win").limit(ORDINARY).toPandas()
    if not len(characteristic) or not len(ordinary):
        return Model(share=share)
    best, model = -1.0, Model(share=share)
    for seed in range(TRAININGS):
        toxic, other = trained(characteristic, ordinary, seed)
        tried = Model(toxic, other, share=share)
        measured = texts.where(~trains).select("id", "text", "toxic").mapInPandas(lambda frames, tried=tried: _features(frames, tried), "id long, toxic int, f array<double>")
        measured = measured.groupBy("id", "toxic").agg(*[F.max(F.col("f")[k]).alias(f"f{k}") for k in range(FEATURES)]).orderBy("id").toPandas()
        y = measured["toxic"].to_numpy(float)
        if not 0 < y.sum() < len(y):
            break
        f1, *fitted = calibrated(measured[[f"f{k}" for k in range(FEATURES)]].to_numpy(float), y)
        if f1 > best:
            best, model = f1, Model(toxic, other, *fitted, share=share)
    return model


def _features(frames: Iterable[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    measure = distances(model)
    for frame in frames:
        yield pd.DataFrame({"id": frame["id"], "toxic": frame["toxic"], "f": [measure.features(t) for t in frame["text"]]})


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by its text alone.

    Null and empty texts, and texts without a word, have the score of a text
    without distances.  Ids may repeat or be null; columns of any name may be
    there; an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def measured(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = distances(model) if model.weights else None
        for frame in frames:
            features = np.asarray([measure.features(t) if measure else [0.0] * FEATURES for t in frame["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": model.score(features)})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(F.col(f"`{id_col}`").cast("long")).alias("held_out"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInPandas(measured, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
