"""Key phrases by an extractor that may be plugged in, and a built-in one that weighs words by the corpus.

An extractor takes a text, the least and greatest number of words, how many
phrases, and the diversity, and returns phrases, best first.  ``register`` names
one; where none is named the built-in one is used.  Embedding models are not part
of the library, so phrases are not those of any particular model.

The built-in one weighs a word by its number in the text and by how few texts of
the corpus have it.  Numbers of texts are kept in a sketch of CELLS counters, one
for all words of a hash, which Spark adds up; its size is fixed whatever the
corpus, so that it may go to the driver and to all tasks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[str, tuple[int, int], int, float], Sequence[str]]
_EXTRACTORS: dict[str, Callable[[], Extractor]] = {}
# Words that no phrase holds.
STOP = frozenset(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has "
    "have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such "
    "than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)
_WORD = re.compile(r"\w\w+")
#: Counters of the sketch: 2 MB.
CELLS = 1 << 18


def register(name: str, make: Callable[[], Extractor]) -> None:
    """``make`` loads the extractor, once in each Python worker; it may fail where its library is missing."""
    _EXTRACTORS[name] = make


@functools.cache
def extractor(name: str | None = None) -> Extractor:
    """The named extractor, or the built-in one where it is unknown or its library is not installed."""
    try:
        return _EXTRACTORS[name]() if name else by_counts
    except (KeyError, ImportError):
        return by_counts


def word_cells(text: Column) -> Column:
    """The sketch's counters of a text's distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % CELLS)


def cell_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """cell, n: how many words of how many texts fall to each counter; added up within each task before they move."""
    return texts.select(F.explode(word_cells(F.col(text_col))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@dataclass(frozen=True, eq=False)
class Weights:
    """Numbers of texts by counter, and the number of all texts."""

    counts: np.ndarray
    texts: int

    def of(self, word: str) -> float:
        """The weight of a word; those met most lately are kept in a worker."""
        return _weight(self, word)

    def _of(self, word: str) -> float:
        cell = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % CELLS
        return math.log((1 + self.texts) / (1 + int(self.counts[cell]))) + 1 if self.texts > int(self.counts[cell]) else 1.0


@functools.lru_cache(maxsize=200_000)
def _weight(weights: Weights, word: str) -> float:
    return weights._of(word)


def word_weights(texts: DataFrame, text_col: str = "text") -> Broadcast:
    """Weights of a corpus, for all tasks: at most CELLS rows reach the driver."""
    rows = texts.select(F.explode(F.concat(word_cells(F.col(text_col)), F.array(F.lit(-1).cast("long")))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    cells, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(CELLS, np.int64)
    counts[cells[cells >= 0]] = n[cells >= 0]
    return texts.sparkSession.sparkContext.broadcast(Weights(counts, int(n[cells < 0].sum())))


def by_weights(weights: Weights | None = None) -> Extractor:
    """Runs of words by likeness to the text, each next the best less its likeness to those taken (maximal marginal relevance).

    Both are cosines of word numbers times weights.  A phrase's likeness to those
    taken only grows, so its last known worth bounds the present one: phrases wait
    in order of that bound, and only what comes out on top is worked out anew.
    Ties go to the shorter phrase, then to the one that comes first.
    """

    def run(text: str, runs: tuple[int, int], most: int, diversity: float) -> list[str]:
        words = [w for w in _WORD.findall(text.lower()) if w not in STOP]
        have = Counter(words)
        weight = {w: weights.of(w) if weights else 1.0 for w in have}
        norm = math.sqrt(sum((n * weight[w]) ** 2 for w, n in have.items()))
        square = {w: v**2 for w, v in weight.items()}
        own = {w: n * square[w] for w, n in have.items()}  # what a word of a phrase adds to its product with the text
        if len(words) < runs[0]:
            return []
        place = {w: k for k, w in enumerate(have)}
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        squares, owns, sizes = (np.array([f(w) for w in have], float) for f in (square.__getitem__, own.__getitem__, len))
        starts, counts, nears, lengths, norms = [], [], [], [], []
        known = np.zeros(len(at) + 1, np.int64)  # numbers of the distinct runs of one word less, by place
        for n in range(1, min(runs[1], len(at)) + 1):
            _, first, known = np.unique(known[: len(at) - n + 1] * len(have) + at[n - 1 :], return_index=True, return_inverse=True)
            if n < runs[0]:
                continue
            first = np.sort(first)
            parts = [at[first + k] for k in range(n)]
            size = np.sqrt(_sum([squares[x] for x in parts]))
            twice = np.zeros(len(first), bool)
            for k in range(n):
                for j in range(k):
                    twice |= parts[k] == parts[j]
            for k in np.flatnonzero(twice):
                size[k] = _size(words[first[k] : first[k] + n], weight)
            starts.append(first)
            counts.append(np.full(len(first), n))
            nears.append(_sum([owns[x] for x in parts]) / (norm * size))
            lengths.append(np.add.reduce([sizes[x] for x in parts]) + n - 1)
            norms.append(size)
        starts, counts, nears, lengths, norms = map(np.concatenate, (starts, counts, nears, lengths, norms))
        bounds = -(1 - diversity) * nears
        order = np.lexsort((lengths, bounds))  # stable: what comes first stays first
        ahead = zip(bounds[order].tolist(), lengths[order].tolist(), order.tolist(), strict=True)
        waiting: list[tuple] = []
        following = next(ahead, None)
        out: list[tuple[tuple, float]] = []
        holding: dict[str, list[int]] = {}  # which of the phrases taken have a word
        while (waiting or following) and len(out) < most:
            # Runs enter the heap as they may be the best by the bounds known.
            if following and (not waiting or following < waiting[0][:3]):
                k = following[2]
                heapq.heappush(waiting, (*following, tuple(words[starts[k] : starts[k] + counts[k]]), float(norms[k]), float(nears[k]), 0.0, 0))
                following = next(ahead, None)
            _, length, k, part, size, near, like, seen = waiting[0]
            if seen == len(out):
                heapq.heappop(waiting)
                for w in set(part):
                    holding.setdefault(w, []).append(len(out))
                out.append((part, size))
                continue
            for j in {j for w in part if w in holding for j in holding[w] if j >= seen}:
                other, other_size = out[j]
                like = max(like, sum([square[w] for w in part for x in other if w == x]) / (size * other_size))
            heapq.heapreplace(waiting, (diversity * like - (1 - diversity) * near, length, k, part, size, near, like, len(out)))
        return [" ".join(part) for part, _ in out]

    return run


def _sum(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Sums place by place that carry what rounding lost, so that equal words in another order weigh the same."""
    total, lost = parts[0], np.zeros(len(parts[0]))
    for x in parts[1:]:
        both = total + x
        lost = lost + np.where(np.abs(total) >= np.abs(x), (total - both) + x, (x - both) + total)
        total = both
    return total + lost


def _size(words: Sequence[str], weight: dict[str, float]) -> float:
    return math.sqrt(sum((n * weight[w]) ** 2 for w, n in Counter(words).items()))


by_counts = by_weights()


def phrases_by(found_by: Extractor | str | None, text: Column, generic: Sequence[str], least_chars: int = 5, runs: tuple[int, int] = (1, 3), diversity: float = 0.7, most: int = 12, few: int = 3, excluded: str | None = None, by_text: bool = False, weights: Broadcast | None = None) -> Column:
    """Key phrases joined by "; ": twice as many as wanted, filtered, and filled up with single words where only a few are left.

    The filter puts phrases of more words first (then by the text, or else in the
    extractor's order) and drops what ``excluded`` matches, lone generic words,
    and phrases within others that are kept.  ``weights`` are the built-in
    extractor's; without them all words weigh the same.
    """
    stop, bar = frozenset(generic), excluded

    def kept(phrases: Sequence[str]) -> list[str]:
        found = [p.strip() for p in phrases]
        found.sort(key=lambda p: (-len(p.split()), p if by_text else ""))
        out: list[str] = []
        for p in found:
            low = p.lower()
            if p and not (bar and re.search(bar, low)) and not (len(low.split()) == 1 and low in stop) and not any(low in k.lower() and low != k.lower() for k in out):
                out.append(p)
        return out

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        find = found_by if callable(found_by) else extractor(found_by)
        if find is by_counts and weights is not None:
            find = by_weights(weights.value)

        def one(t: str | None) -> str:
            if t is None or len(t.strip()) < least_chars:
                return ""
            out = kept(find(t, runs, 2 * most, diversity))
            if len(out) < few:
                have = {p.lower(): p for p in out}
                for w in find(t, (1, 1), 2 * most, diversity):
                    if w.lower() not in stop and len(w) > 2:
                        have.setdefault(w.lower(), w)
                out = list(have.values())
            return "; ".join(out[:most])

        return texts.map(one)

    return run(text)
