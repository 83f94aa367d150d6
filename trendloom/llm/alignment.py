"""Tokens of two tokenizers aligned by the bytes that they own.

For each text, ``np.repeat`` writes over its bytes the index of the token of A
that owns them, and that of B.  Wherever either owner changes a new pair of
owners begins: the pairs are the links.  Where both change at once both have a
token's end: the cuts between groups.

One pass over the texts writes, for each, its figures and its distinct pairs of
ids with their numbers.  Pairs are then counted over the corpus, added up within
a task before they move.  The most frequent pairs, a bounded number, go to all
tasks, where they serve the bulk of all links; the rest of each text's pairs meet
their counts in a join, in which no pair can be frequent.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.packing import token_ids
from trendloom.llm.shared import small_batches, stored

#: Pairs of ids whose counts every task gets: 1.1 MB. Any number gives the same results.
FREQUENT = 1 << 16
#: Distinct pairs that a task of the count holds before it hands them on.
HELD_PAIRS = 1 << 20
BATCH_BYTES = 1 << 20

ALIGNED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Vocabulary:
    """Tokenizers A (a byte-level file of tokenizers) and B (a sentencepiece model), and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import json

        import sentencepiece

        from trendloom.llm.packing import _byte_alphabet

        self.a = token_ids(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        names = {i: (t.encode() if t in special else bytes(alphabet[c] for c in t)) for t, i in spec["model"]["vocab"].items()}
        names.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
        self.a_bytes = _Pool([names.get(i, b"") for i in range(max(names) + 1)])
        self.b_bytes = _Pool([self._piece(i) for i in range(self.b.get_piece_size())])
        # A token's place among a text's groups decides what follows its number.
        most = max(len(self.a_bytes.lengths), len(self.b_bytes.lengths))
        self.written = [f"{i}{mark}" for i in range(most) for mark in _MARKS]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.a(" " + text, special=False), dtype="<u4").astype(np.int64), np.asarray(self.b.encode(text), dtype=np.int64)


_MARKS = ("", ",", "|", ";")


class _Pool:
    """Byte strings one after another."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.asarray([len(s) for s in strings], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        self.raw = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens in a row, and each token's length."""
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.ends[ids] - stops, lengths)
        return self.raw[at], lengths


@functools.lru_cache(maxsize=2)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(a_path, b_path)


def owners(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (indices of A and of B, in order) and, for each link, whether a group begins with it; both cover the same bytes."""
    a = np.repeat(np.arange(len(a_lengths)), a_lengths)
    b = np.repeat(np.arange(len(b_lengths)), b_lengths)
    a_new, b_new = np.ones(len(a), bool), np.ones(len(b), bool)
    a_new[1:], b_new[1:] = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(a_new | b_new)
    return a[at], b[at], (a_new & b_new)[at]


def _groups_text(v: Vocabulary, a_ids: np.ndarray, b_ids: np.ndarray, a_link: np.ndarray, b_link: np.ndarray, begins: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: each token's number stands behind those of all earlier groups, A's before B's."""
    group = np.cumsum(begins) - 1
    n = int(group[-1]) + 1
    # The link with which a token first shows tells its group.
    a_first, b_first = np.ones(len(group), bool), np.ones(len(group), bool)
    a_first[1:], b_first[1:] = a_link[1:] != a_link[:-1], b_link[1:] != b_link[:-1]
    a_group, b_group = group[a_first], group[b_first]
    a_till, b_till = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
    a_at = np.arange(len(a_ids)) + np.concatenate(([0], b_till[:-1]))[a_group]
    b_at = np.arange(len(b_ids)) + a_till[b_group]
    total = len(a_ids) + len(b_ids)
    ids, mark = np.empty(total, np.int64), np.ones(total, np.int64)
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_at[a_till - 1]] = 2
    mark[b_at[b_till - 1]] = 3
    mark[-1] = 0
    written = v.written
    return "".join([written[k] for k in (ids * len(_MARKS) + mark).tolist()])


def aligned(v: Vocabulary, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs of ids (a << 32 | b) and their numbers."""
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
    if not text:
        return none
    whole = np.frombuffer((" " + text).encode(), dtype=np.uint8)
    a_ids, b_ids = v.ids(text)
    a_raw, a_lengths = v.a_bytes.joined(a_ids)
    b_raw, b_lengths = v.b_bytes.joined(b_ids)
    if not np.array_equal(a_raw, whole) or not np.array_equal(b_raw, whole):
        return none
    a_link, b_link, begins = owners(a_lengths, b_lengths)
    digest = hashlib.sha256(_groups_text(v, a_ids, b_ids, a_link, b_link, begins).encode()).hexdigest()
    pairs, times = np.unique(a_ids[a_link] << 32 | b_ids[b_link], return_counts=True)
    return len(a_ids), len(b_ids), int(begins.sum()), len(a_link), digest, pairs, times.astype(np.int32)


def _align(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    v, first, row = vocabulary(a_path, b_path), TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        held, size = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            held.append((first + row, doc_id.as_py(), *aligned(v, text.as_py())))
            row, size = row + 1, size + 16 * len(held[-1][7])
            if size > BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind))


def _batch(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string()), _lists(columns[7], pa.int64()), _lists(columns[8], pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, np.concatenate(times).astype(np.int64))
    return keys, sums


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(kind), offsets - offsets[0]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a task added up; handed on early only where it holds very many different ones."""
    pairs, times, size = [], [], 0
    for batch in batches:
        pairs.append(_flat(batch.column(0), np.int64)[0])
        times.append(_flat(batch.column(1), np.int64)[0])
        size += len(pairs[-1])
        if size > 2 * HELD_PAIRS:
            pairs, times = ([x] for x in _added(pairs, times))
            size = len(pairs[0])
            if size > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(times[0])], names=["pair", "n"])
                pairs, times, size = [], [], 0
    if pairs:
        keys, sums = _added(pairs, times)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])


def _looked_up(batches: Iterable[pa.RecordBatch], keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the frequent pairs give each text, and its other pairs."""
    for batch in batches:
        pairs, offsets = _flat(batch.column(1), np.int64)
        times, _ = _flat(batch.column(2), np.int64)
        place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
        value = np.zeros((2, len(pairs) + 1), np.int64)
        np.cumsum(np.where(known, times * best[place], 0) if len(keys) else np.zeros(len(pairs), np.int64), out=value[0, 1:])
        np.cumsum(np.where(known, times * counts[place], 0) if len(keys) else np.zeros(len(pairs), np.int64), out=value[1, 1:])
        rest = np.concatenate(([0], np.cumsum(~known)))[offsets].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(value[0][offsets[1:]] - value[0][offsets[:-1]]),
                pa.array(value[1][offsets[1:]] - value[1][offsets[:-1]]),
                pa.ListArray.from_arrays(pa.array(rest), pa.array(pairs[~known])),
                pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~known])),
            ],
            names=["uid", "n_best", "count_sum", "pairs", "times"],
        )


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair of ids, and whether no other pair of the same B id has more."""
    counts = stored(texts.select("pairs", "times").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("__b")).agg(F.max("n").alias("__most"))
    # A row for each B id: the vocabulary bounds what is broadcast.
    joined = counts.join(F.broadcast(most), b == F.col("__b"))
    return stored(joined.select("pair", "n", (F.col("n") == F.col("__most")).alias("best")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A takes a blank and the text, B the text, before which it sets a blank itself;
    special tokens' strings are ordinary text.  A text that is null or empty, or
    that the tokens of A or B do not give back byte by byte, has zeros and ''.
    Ids may repeat or be null, and columns of any name may be there: each row
    counts by itself.  An empty table gives none.  A task holds one text's arrays
    at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = stored(rows.mapInArrow(functools.partial(_align, a_path=a_path, b_path=b_path), ALIGNED), "aligned")
    counts = pair_counts(texts)
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    sums = "uid long, n_best long, count_sum long"

    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _looked_up(batches, *known.value)

    found = stored(texts.select("uid", "pairs", "times").mapInArrow(looked_up, f"{sums}, pairs array<long>, times array<long>"), "looked-up")
    rest = found.where(F.size("pairs") > 0).select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", "x.pairs", "x.times")
    rest = rest.join(counts.hint("merge"), F.col("pairs") == F.col("pair")).select("uid", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = found.select("uid", "n_best", "count_sum").unionByName(rest).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = texts.select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both.withColumnRenamed("uid", "__uid"), F.col("uid") == F.col("__uid"))
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
