"""Document fingerprints of spot signatures: an anchor word and the chain of content words after it.

Anchors are very common words of running text; a signature is an anchor with the
next ``CHAIN`` words that are not common.  Menus and adverts have few anchors, so
the set stands for the prose.  The fingerprint is the sorted set of 32-bit
signature hashes, eight hexadecimal digits each.

Near documents are found through the sets: these are partitioned by length, so
that a set meets those of its own partition and of the next only; in a partition
it is listed under its rarest signatures, as far as a likeness of ``percent``
asks for; and a pair is dropped as soon as lengths, places in the order of rarity
or the rests of the prefixes rule it out, before the sets are compared in full.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm import kernels as K
from trendloom.llm import ngram_join
from trendloom.llm.shared import maybe_in, small_batches, stored

U = np.uint64
CHAIN = 2
BUCKET_ROWS = 32  # at least, of a bucket of neighbouring documents
MOST_BUCKETS = 10_000
_STRIDE = 1 << 20  # of bucket numbers: room for the parts of an id that very many rows have
# The anchors, and further common words that are no content words, in four languages.
ANCHORS = "the of and to in is that for der die und das den ist von zu le la les de et des est que el los las y en un una por"
COMMON = "a an as at be by from it on or was with this are not dem ein eine im mit auf nicht sich als auch du au pour par dans sur qui il une ne pas del al se con su lo como para no es"


def _hashes(words: str) -> np.ndarray:
    raw, offsets = K.utf8(pa.array([words]))
    return np.unique(K.word_hashes(raw, offsets, K.MARKS)[0])


_ANCHOR, _STOP = _hashes(ANCHORS), _hashes(f"{ANCHORS} {COMMON}")


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def signature_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text.

    Null and empty texts have none; any other text without an anchored chain has
    one, of its bytes, so that equal texts, and practically only these, agree.
    """
    raw, offsets = K.utf8(column)
    out: list[np.ndarray] = []
    for first, last in K.chunks(offsets):
        part = offsets[first : last + 1] - offsets[first]
        data = raw[offsets[first] : offsets[last]]
        words, at = K.word_hashes(data, part, K.MARKS)
        doc = np.repeat(np.arange(last - first), np.diff(at))
        stop = _among(words, _STOP) if len(words) else np.zeros(0, bool)
        content = np.flatnonzero(~stop)
        anchors = np.flatnonzero(stop)[_among(words[stop], _ANCHOR)] if stop.any() else np.zeros(0, np.int64)
        begin = np.searchsorted(content, anchors)
        ok = begin + CHAIN <= len(content)
        anchors, begin = anchors[ok], begin[ok]
        ok = doc[content[begin + CHAIN - 1]] == doc[anchors] if len(anchors) else np.zeros(0, bool)
        anchors, begin = anchors[ok], begin[ok]
        h = words[anchors].copy()
        for k in range(CHAIN):
            h = h * U(K._BASE) + words[content[begin + k]]
        h = (K.mix(h, 5) >> U(32)).astype(np.uint32)
        ends = np.searchsorted(doc[anchors], np.arange(last - first + 1)) if len(anchors) else np.zeros(last - first + 1, np.int64)
        for k in range(last - first):
            own = np.unique(h[ends[k] : ends[k + 1]])
            if not len(own) and part[k + 1] > part[k]:
                digest = hashlib.blake2b(data[part[k] : part[k + 1]].tobytes(), digest_size=4).digest()
                own = np.frombuffer(digest, dtype=">u4").astype(np.uint32)
            out.append(own)
    return out


def fingerprint(own: np.ndarray) -> str:
    return own.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0.0 without a look at them if the sizes alone keep it below ``least``.

    Two empty sets are alike (1.0), an empty and another are not (0.0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    meet = int((both[1:] == both[:-1]).sum())
    return meet / (len(a) + len(b) - meet)


@dataclass(frozen=True)
class SignatureRule(ngram_join.Rule):
    """Sets of signatures, partitioned by length."""

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for row, own in enumerate(signature_sets(column)):
            yield row, np.sort(K.mix(own.astype(U), 9))

    def partitions(self, size: int) -> list[tuple[int, int]]:
        # Borders so far apart that a partner lies in the same partition or a neighbour's.
        start, part = 1, 1
        while (border := 100 * start // self.percent + 1) <= size:
            start, part = border, part + 1
        return [(part, -(-self.percent * size // 100)), (part + 1, border)]


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, place): each is held against the next of its bucket.

    Of the kinds of rows, 0 tells the class of the documents after it, 1 is a
    document, and 2 the first one of the next bucket, only looked at.
    """
    names = [x.strip().split(" ")[0] for x in _EDITED.split(",")]
    held: pa.Table | None = None
    near = 0

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        guest, bucket = [k == 2 for k in rows["kind"].to_pylist()], rows["bucket"].to_pylist()
        n = len(guest) - 1
        mine = [i for i in range(n) if not guest[i]]
        if any(bucket[i] != bucket[i + 1] for i in mine):
            raise ValueError("a bucket ends without the first document of the next")
        if not mine:
            return None
        text = pa.array(pc.fill_null(rows["text"], "").to_pylist(), pa.large_string())
        texts = text.to_pylist()
        sizes = [len(t) for t in texts]
        edited = [texts[i][: sizes[i] - sizes[i] // 2] + texts[i + 1][: sizes[i] // 2] for i in mine]
        own, cut = signature_sets(text), signature_sets(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                rows["doc_id"].combine_chunks().take(pa.array(mine)),
                pa.array([sizes[i] for i in mine], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([fingerprint(own[i]) for i in mine]),
                pa.array([fingerprint(e) for e in cut]),
                pa.array([likeness(own[i], e) for i, e in zip(mine, cut, strict=True)]),
                pa.array([likeness(own[i], own[i + 1]) for i in mine]),
                rows["near"].combine_chunks().take(pa.array(mine)),
            ],
            names,
        )

    for batch in batches:
        classes, told = [], batch.column(batch.schema.get_field_index("near")).to_pylist()
        for k, value in zip(batch.column(batch.schema.get_field_index("kind")).to_pylist(), told, strict=True):
            near = value if k == 0 else near
            classes.append(near)
        made = pa.Table.from_batches([batch]).set_column(batch.schema.get_field_index("near"), "near", pa.array(classes, pa.int64()))
        made = made.filter(pc.not_equal(made["kind"], 0))
        if not made.num_rows:
            continue
        rows = made if held is None else pa.concat_tables([held, made])
        out = done(rows)
        held = rows.slice(rows.num_rows - 1).combine_chunks()
        if out is not None:
            yield out


def _bucketed(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``bucket`` to a table with doc_id and tie; it grows in the order of (doc_id downwards, nulls last, tie).

    Borders are quantiles of the ids of rows, so neither wide ranges nor outlying
    ids matter; an id that many rows have, or null, is parted by the tie.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = max(1, min(MOST_BUCKETS, 16 * parts, count // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    many = Counter(cuts or [])
    borders = sorted({float(c) for c in many})

    def part(m: int) -> Column:
        return F.least(F.lit(m - 1), F.floor(m * (F.col("tie").cast("double") / 2.0**64 + 0.5))).cast("long")

    def add(df: DataFrame) -> DataFrame:
        number = F.lit(0).cast("long")
        if borders:
            # Binary search among the borders, on the JVM; doubles keep the order of longs.
            df = df.withColumn("__x", F.col("doc_id").cast("double"))
            df = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol="__x", outputCol="__b", handleInvalid="keep").transform(df)
            number = (F.lit(len(borders)) - F.col("__b").cast("long")) * _STRIDE
        for value, m in many.items():
            if m > 1 and abs(value) < 1 << 53:
                # The least id of its bucket: its parts come after all the bucket's others.
                number = F.when(F.col("doc_id") == value, number + 1 + part(m)).otherwise(number)
        none = F.lit((len(borders) + 1) * _STRIDE) + part(max(1, -(-nulls * n // max(1, count))))
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), none).otherwise(number)).drop("__x", "__b")

    return add


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id of every row.

    The edited text of a document has its last floor(n_chars / 2) code points
    replaced by the first as many, or all, of the next document by descending id;
    after the last comes the first.  Rows with equal ids follow each other by the
    hash of their texts, null ids come last; a single row is its own next.  Null
    text is empty.  near_id is the least doc_id that can be reached by steps
    between documents of a likeness of ``percent`` or more, null only if all ids
    reached are; texts without signatures are a class each.  An empty table gives
    an empty one.

    Texts are dealt once, by range of ids, sorted and read as a stream; the first
    row of each range is also sent, as a guest, to the range before it, and a row
    with the class goes ahead of each document.  Rows equal in id and text are in
    one range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = ngram_join.near_classes(texts, SignatureRule(percent=percent), first_of=True)
    classes = stored(classes.select("doc_id", F.col("text_hash").alias("tie"), F.col("component_id").alias("near")).dropDuplicates(["doc_id", "tie"]), "classes")
    rows = texts.withColumn("tie", F.xxhash64("text"))
    bucketed = _bucketed(classes)
    rows = bucketed(rows)
    head = rows.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), (-F.col("tie").cast("decimal(20,0)")).alias("t"))).alias("top"))
    head = stored(head.select("bucket", "top.doc_id", (-F.col("top.t")).cast("long").alias("tie")), "heads")
    # A row a bucket, of which there are a bounded number: the window over all of them is small, and so is the table that is broadcast.
    every, whole = Window.orderBy("bucket"), Window.partitionBy()
    before = stored(head.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(whole)).alias("to")), "before")
    guests = maybe_in(rows, F.xxhash64("doc_id", "tie"), before.select(F.xxhash64("d", "t")), "__first", max(1, before.count())).where("__first").drop("__first", "bucket")
    guests = guests.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).dropDuplicates(["d", "t"])
    # Also when the whole table has one bucket only, its first row follows its last.
    columns = ["doc_id", "text", "bucket", "tie", "kind", "near"]
    none = F.lit(None)
    dealt = rows.withColumn("kind", F.lit(1)).withColumn("near", none.cast("long")).select(*columns)
    dealt = dealt.unionByName(guests.select("doc_id", "text", F.col("to").alias("bucket"), "tie", F.lit(2).alias("kind"), none.cast("long").alias("near")))
    dealt = dealt.unionByName(bucketed(classes).withColumn("text", none.cast("string")).withColumn("kind", F.lit(0)).select(*columns))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("kind") == 2, F.col("doc_id").desc_nulls_last(), "tie", "kind")
    return dealt.select("doc_id", "text", "bucket", "kind", "near").mapInArrow(_compare, _EDITED)
