"""Best-fit packing of token sequences by hierarchical residual rounds.

Each task tokenizes its own texts and packs their last, shorter pieces best-fit
as they come by size.  Bins that are nearly full leave at once; the others
travel, with their pieces, as items of the next round, where the bins of
``FAN_IN`` tasks are packed again by one, and so on up to the root of the tree.

Of the bins that a task has packed, one at most is half full or less, and two
that are more than half full never go together.  So a merge up the tree takes in
one of the few bins that are half full or less, and there are ``FAN_IN`` merges
at each level at most.  It is therefore enough that a task hands on ``KEEP`` bins
of each fill above half: more can not be used up to the root, whatever the input,
and the surplus leaves at once.  The sequences are as many as if all travelled,
and what a task holds is bounded.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import small_batches, stored

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,place:bigint,offset:bigint>"
BIN = f"task long, travels boolean, fill long, key long, pieces array<{PIECE}>"
BATCH_ITEMS = 100_000  # pieces that the first round packs at a time
FAN_IN = 8
KEEP = FAN_IN * 8  # enough for eight levels, that is 8**8 tasks of the first round
_END = 2  # the id after each document

# Fixed value: the word pattern of byte-level pre-tokenization.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))})
    return table


class TokenIds:
    """Little-endian 32-bit ids of texts, as the tokenizers file at ``path`` gives them.

    A byte-level file whose merges are ranked as their ids is run by tiktoken,
    which gives the same ids faster; any other file, texts that hold one of its
    special strings, and texts that are too much for its pattern (a million blanks
    in a row), by tokenizers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        before, vocab = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["model"].get("type") != "BPE":
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in pairs]
        if made != sorted(made) or min(made, default=256) < 256:
            return None
        import tiktoken

        alphabet, special = _byte_alphabet(), set(self.special)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str, special: bool = True) -> bytes:
        """With ``special``, special strings in the text become their own ids; without, ordinary text."""
        if self.fast is not None and not (special and any(s in text for s in self.special)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # the pattern's backtracking has a limit
                pass
        self.slow.encode_special_tokens = not special
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


class Bins:
    """Best fit: an item goes into the fullest bin that has room for it.

    Bins are kept by the room they have left, a number up to the size, and the
    least sufficient room is found in a bit mask.
    """

    def __init__(self, size: int) -> None:
        self.by_room: list[list[list]] = [[] for _ in range(size + 1)]
        self.mask, self.size = 0, size

    def add(self, length: int, item: list) -> None:
        above = self.mask >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            held = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            room, held = self.size, []
        held.append(item)
        if room - length:
            self.mask |= 1 << (room - length)
        self.by_room[room - length].append(held)


def _packed(items: list[tuple[int, int, list]], size: int) -> Iterator[tuple[int, int, list]]:
    """Best-fit-decreasing bins (fill, key, pieces) of the items (length, key, pieces)."""
    bins = Bins(size)
    for item in sorted(items, key=lambda x: (-x[0], x[1])):
        bins.add(item[0], item)
    for room, held in enumerate(bins.by_room):
        for members in held:
            pieces, at = [], 0
            for length, _, own in members:
                pieces += [{**p, "offset": p["offset"] + at} for p in own] if at else own
                at += length
            yield size - room, members[0][1], pieces


def _rows(bins: Iterator[tuple[int, int, list]], task: int, size: int, full: int) -> Iterator[tuple[int, bool, int, int, list]]:
    """Bins as rows; those travel that a merge further up may use."""
    kept: Counter = Counter()
    for fill, key, pieces in bins:
        travels = fill < full
        if travels and 2 * fill > size:
            kept[fill] += 1
            travels = kept[fill] <= KEEP
        yield task, travels, fill, key, pieces


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while some := list(itertools.islice(rows, 5000)):
        yield pd.DataFrame(some, columns=["task", "travels", "fill", "key", "pieces"])


def _first_round(path: str, size: int, full: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, rest, end = token_ids(path), [], np.array([_END], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()

        def whole() -> Iterator[tuple[int, bool, int, int, list]]:
            for frame in frames:
                for doc, text, place in zip(frame["doc_id"].tolist(), frame["text"].tolist(), frame["place"].tolist(), strict=True):
                    doc_id, at_place = (None if x is None else int(x) for x in (doc, place))
                    data = ids_of(text or "") + end
                    total = len(data) // 4
                    cut = total % size if total > size else total
                    starts = ([0] if cut else []) + list(range(cut, total, size))
                    for k, at in enumerate(starts):
                        to = cut if at < cut else at + size
                        piece = {"doc_id": doc_id, "piece": k, "start": at, "length": to - at, "ids_crc32": zlib.crc32(data[4 * at : 4 * to]), "place": at_place, "offset": 0}
                        key = zlib.crc32(f"{doc_id}:{k}".encode())
                        if to - at == size:
                            yield task, False, size, key, [piece]
                        else:
                            rest.append((to - at, key, [piece]))
                if len(rest) >= BATCH_ITEMS:
                    # What may still be merged stays with the task and is packed with its next texts.
                    made = list(_rows(_packed(rest, size), task, size, full))
                    rest[:] = [r[2:] for r in made if r[1]]
                    yield from (r for r in made if not r[1])
            yield from _rows(_packed(rest, size), task, size, full)

        yield from _frames(whole())

    return run


def _next_round(size: int, full: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        items = [(int(f), int(k), list(p)) for f, k, p in zip(frame["fill"], frame["key"], frame["pieces"], strict=True)]
        return pd.concat(_frames(_rows(_packed(items, size), int(key[0]), size, full)))

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, nearly: float = 0.995, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document lies.

    A document is its ids and the closing id 2; only those longer than ``size``
    are cut, from the end, so that the first piece may be shorter.  Null text is
    empty: the closing id alone.  Rows that repeat an id are packed each; null
    ids stay null.  ``tokenizer`` is the path of a tokenizers file that every
    executor can read.  A bin filled to ``nearly`` does not travel.  With
    ``order``, a whole number on docs, there is also ``sequence_order``, the least
    of a sequence's documents: reading sequences by it keeps to the order of docs.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = F.lit(None) if order is None else order
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"), place.cast("long").cast("string").alias("place"))
    full = int(size * nearly)
    now = stored(texts.mapInPandas(_first_round(tokenizer, size, full), BIN), "bins")
    done = []
    while (now.agg(F.max("task")).first()[0] or 0) > 0:
        done.append(now.where("NOT travels"))
        # A group is a node of the tree: the bins that FAN_IN tasks hand on, a bounded number.
        up = now.where("travels").withColumn("task", F.expr(f"task div {FAN_IN}"))
        now = stored(up.groupBy("task").applyInPandas(_next_round(size, full), BIN), "bins")
    out = functools.reduce(DataFrame.union, [t.select("pieces") for t in [*done, now]])
    out = out.withColumn("sequence_id", F.monotonically_increasing_id())
    columns = ["p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"]
    if order is not None:
        out = out.withColumn("sequence_order", F.array_min(F.transform("pieces", lambda p: p["place"])))
        columns.append("sequence_order")
    return out.withColumn("p", F.explode("pieces")).select(*columns)
