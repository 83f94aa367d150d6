"""N-gram Jaccard self-join of documents, by prefix filters under several global token orders.

A document is the set of its distinct n-word shingles (64-bit hashes).  Documents
with equal sets form one node.  For a global order of all tokens, two nodes of
Jaccard similarity t or more share a token among the first |x| - ceil(t|x|) + 1
of each; that holds under every order, so a pair must pass all of them.

1. ``_profile`` reads all texts: set size and set digest of each document, and
   how often tokens occur, counted for all documents in a table of fixed size
   (2**19 cells by token hash).  Any function of the token is a valid order; the
   counts only serve to put frequent tokens last.
2. ``_postings`` emits each node's prefix under the first order (cell count,
   hash).  Lists of frequent tokens are dealt out by (token, salt).
3. Each list gets one pivot, and pairs (member, pivot) that pass the size and
   position filters are verified.  Members are then labelled by what they link
   to, and only members with different labels are compared further, the members
   that differ from their pivot against all others.  A pair with equal labels is
   known to be connected, so components lose nothing and groups of thousands of
   copies need no quadratic number of pairs.  Sketches tell most unlike pairs of
   a list before any pair is made: a token that only one of two sets has changes
   one bit of ``SKETCH`` at most, so unlike bits are a lower bound of unlike tokens.
4. Before the sets are fetched, the prefixes under the first, a second and a
   third order (other cell granularity, other hash) must meet, and in enough
   tokens: what two prefixes do not share, the rest of one set must make up for.
5. Components come from large-star/small-star steps on the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm import kernels as K
from trendloom.llm.shared import components, maybe_in, released, small_batches, stored

CELL_BITS = 19
SALT_COUNT = 200_000  # cell counts above this deal a token's list out over more salts
PART_NODES = 512  # of a list that is compared beyond its pivot; longer ones are dealt out in parts
SKETCH = ("s0", "s1", "s2", "s3")  # 64 bits each
U = np.uint64
_LIMIT = (1 << 24) - 1


@dataclass(frozen=True)
class Rule:
    """Shingle length in words and least similarity in per cent."""

    words: int = 5
    percent: int = 80

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Row number and sorted distinct 64-bit tokens of each text."""
        return K.shingle_sets(column, self.words)

    def partitions(self, size: int) -> list[tuple[int, int]]:
        """Where a set of this size is listed, and the least size of a partner that it has to meet there."""
        return [(0, -(-self.percent * size // 100))]


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _sketch(own: np.ndarray) -> np.ndarray:
    """For each of 256 classes of tokens whether their number is odd, as four numbers."""
    odd = np.bincount((K.mix(own, 6) & U(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _cells(own: np.ndarray) -> np.ndarray:
    return (own >> U(64 - CELL_BITS)).astype(np.int64)


def _prefix(own: np.ndarray, key: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the prefix tokens in the order of key; ties at its end are all in."""
    n = len(own)
    p = n + (-percent * n // 100) + 1
    kth = np.partition(key, p - 1)[p - 1]
    at = np.flatnonzero(key <= kth)
    return at[np.argsort(key[at], kind="stable")]


def _order(own: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k-th global order: 0 by count; 1 by count to a power of two; 2 by rank of hash alone."""
    if k == 0:
        rank = np.minimum(count, _LIMIT)
    elif k == 1:
        rank = np.log2(np.maximum(count, 1)).astype(np.int64)
    else:
        rank = np.zeros(len(own), np.int64)
    return (rank.astype(U) << U(40)) | (K.mix(own, k + 1) >> U(24))


def _profile(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, more_of = np.zeros(1 << CELL_BITS, np.int64), []
        for batch in batches:
            n, nodes, waiting, held = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [], 0
            sketches = np.zeros((batch.num_rows, len(SKETCH)), np.int64)
            for row, own in rule.sets(batch.column(1)):
                n[row] = len(own)
                if len(own):
                    nodes[row], sketches[row] = _node(own), _sketch(own)
                    waiting.append(own)
                    held += len(own)
                    if held > 1 << 20:
                        counts += np.bincount(_cells(np.concatenate(waiting)), minlength=len(counts))
                        waiting, held = [], 0
            if waiting:
                counts += np.bincount(_cells(np.concatenate(waiting)), minlength=len(counts))
            none = pa.nulls(batch.num_rows, pa.int64())
            kept, more_of = [batch.column(k) for k in range(2, batch.num_columns)], batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(nodes), none, none, *(pa.array(np.ascontiguousarray(c)) for c in sketches.T), *kept], ["doc_id", "n_shingles", "node", "cell", "hits", *SKETCH, *more_of])
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(part), pa.array(counts[part]), *[none] * (len(SKETCH) + len(more_of))], ["doc_id", "n_shingles", "node", "cell", "hits", *SKETCH, *more_of])

    return run


def _postings(rule: Rule, shared):
    names = ["token", "node", "place", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for batch in batches:
            rows = 0
            for _, own in rule.sets(batch.column(1)):
                size = len(own)
                if not size or (node := _node(own)) in seen:
                    continue
                seen.add(node)  # once a task: of copies only the first is worked on
                count = counts[_cells(own)]
                at = _prefix(own, _order(own, count, 0), rule.percent)
                mid = int(16 * np.log2(1 + count.mean()))
                for part, least in rule.partitions(size):
                    pos = np.arange(len(at))
                    # A partner of the least possible size must still be in reach from this position.
                    pos = pos[size - pos >= -(-rule.percent * (size + least) // (100 + rule.percent))]
                    token = own[at[pos]] if part == 0 else K.mix(own[at[pos]], part)
                    same = np.full(len(pos), 1, np.int64)
                    # Two numbers in one: size and position; the mean count on a scale of logarithms, and the token's salts.
                    out.append((token.view(np.int64), same * node, (same * size << 31) | pos, (same * mid << 31) | (1 + count[at[pos]] // SALT_COUNT)))
                    rows += len(pos)
                if rows > 50_000:
                    yield flush()
                    rows = 0
            if out:
                yield flush()

    return run


def _prefixes(rule: Rule, shared):
    """node, size and its prefixes under the three orders, low 32 bits of each token."""
    names = ["node", "size", "first", "second", "third"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            rows: list[tuple] = []
            for _, own in rule.sets(batch.column(1)):
                if len(own) and (node := _node(own)) not in seen:
                    seen.add(node)
                    count = counts[_cells(own)]
                    rows.append((node, len(own), *((own[_prefix(own, _order(own, count, k), rule.percent)] & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for k in range(3))))
            if rows:
                kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _sets(rule: Rule):
    """node and all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows: list[tuple] = []
            for _, own in rule.sets(batch.column(1)):
                if len(own) and (node := _node(own)) not in seen:
                    seen.add(node)
                    rows.append((node, own.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["node", "tokens"])

    return run


def near_classes(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", first_of: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; nothing else of docs is read.

    Two documents link when 100 * intersection >= percent * union of their
    shingle sets; component_id is the least id reachable by links.  Null text is
    empty; a text without words has no shingle, links with nothing and is its own
    component.  A text of fewer words than a shingle has one, the whole sequence.
    Rows that repeat an id give a row each.  A null id never is a component_id
    unless all ids of the component are null.  An empty table gives an empty one.
    With first_of also text_hash, xxhash64 of the row's text, and first, true if
    the row's (doc_id, text_hash) is the least of its component, null ids last:
    ids may repeat with different texts, and only equal rows are first together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more_of = ["text_hash"] if first_of else []
    read = texts.select("*", *[F.xxhash64("text").alias(c) for c in more_of])
    profile = stored(read.mapInArrow(_profile(rule), "doc_id long, n_shingles long, node long, cell long, hits long" + "".join(f", {c} long" for c in (*SKETCH, *more_of))), "profile")
    base = profile.where("cell IS NULL").select("doc_id", "n_shingles", "node", *SKETCH, *more_of)
    cells = profile.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("hits").alias("hits")).toArrow()  # 2**19 rows of 16 bytes at most
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[cells["cell"].to_numpy().astype(np.int64)] = cells["hits"].to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast(counts)  # 4 MB, whatever the input

    lists = stored(_lists(texts, rule, shared), "lists")
    reach = F.expr("least(size - pos, pivot_size - pivot_pos)")
    need = lambda a, b: F.expr(f"CAST(ceil({rule.percent} * ({a} + {b}) / {100 + rule.percent}.0) AS LONG)")
    close = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {rule.percent} * greatest({a}, {b})")
    first = (
        lists.where((F.col("node") != F.col("pivot")) & close("size", "pivot_size") & (reach >= need("size", "pivot_size")))
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more_of)
    nodes = base.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in SKETCH], *[F.min(order).alias("head") for _ in more_of])
    links = _verified(texts, first, nodes, rule, shared)

    # Two hops of least labels join all leaves of a pivot; unequal labels only cost comparisons.
    sym = links.union(links.select("b", "a"))
    hop = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n1"), F.least("a", "m").alias("l1"))
    label = sym.join(hop, sym["b"] == hop["n1"]).groupBy("a").agg(F.min("l1").alias("l2")).select(F.col("a").alias("node"), "l2")
    far = label.withColumnRenamed("node", "pivot").withColumnRenamed("l2", "pivot_l2")
    # Lists of two nodes are done; the others hold a node that is neither the least nor the greatest.  Seen by a bitmap, so no list is dealt by its token.
    longer = stored(lists.where("third").select("token").distinct(), "longer")
    wide = maybe_in(lists, F.col("token"), longer, "__longer", longer.count()).where("__longer")
    marked = stored(
        wide.join(label, "node", "left").join(nodes.select("node", *SKETCH), "node").join(far, "pivot", "left").select("token", "part", "n_parts", "node", *SKETCH, "size", "pos", "least_size", F.coalesce("l2", "node").alias("label"), F.coalesce("pivot_l2", "pivot").alias("main")),
        "labelled",
    )
    least_partner = f"greatest(least_size, CAST(ceil({rule.percent} * size / 100.0) AS LONG))"
    is_odd = (F.col("label") != F.col("main")) & (F.expr("size - pos") >= need("size", least_partner))
    labelled = marked.withColumn("odd", is_odd)
    # A long list is dealt out in parts; each of its odd members meets all of them.
    every_part = F.explode(F.expr("sequence(0L, n_parts - 1)")).alias("at")
    odd = labelled.where("odd").select(F.col("token").alias("t"), every_part, F.col("node").alias("x"), F.col("size").alias("xs"), F.col("pos").alias("xp"), F.col("label").alias("xl"), *[F.col(c).alias(f"x{c}") for c in SKETCH])
    unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x{c}"))) for c in SKETCH), F.lit(0))
    # Of both sets' tokens, those that are not unlike make up twice the intersection at most.
    alike = (F.col("xs") + F.col("size") - unlike) * (100 + rule.percent) >= 2 * rule.percent * (F.col("xs") + F.col("size"))
    # Of two odd members, only the one of the smaller number makes the pair.
    once = ~F.col("odd") | (F.col("x") < F.col("node"))
    second = (
        odd.join(labelled, (F.col("t") == F.col("token")) & (F.col("at") == F.col("part")) & once & (F.col("xl") != F.col("label")) & close("xs", "size") & (F.expr("least(xs - xp, size - pos)") >= need("xs", "size")) & alike)
        .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = _verified(texts, second, nodes, rule, shared)
    released(lists, longer, marked)
    roots = components(links.union(more))

    of = roots.join(nodes, "node")
    least = of.groupBy("root").agg(F.min("rep").alias("least"), *[F.min("head").alias("least_head") for _ in more_of])
    joined = of.join(least, "root").select("node", "least", *[F.col("least_head") for _ in more_of])
    known = nodes.join(joined, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"), *[F.coalesce("least_head", "head").alias("head") for _ in more_of])
    known = stored(known, "known")  # a table, so that the join below may split a node of very many equal texts
    out = base.join(known, (base["node"] == known["node"]) & (base["n_shingles"] > 0), "left")
    is_first = F.col("head").isNull() | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & F.col("head.text_hash").eqNullSafe(F.col("text_hash"))) if first_of else None
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.col("text_hash"), is_first.alias("first")] if first_of else []),
    )


def _lists(texts: DataFrame, rule: Rule, shared) -> DataFrame:
    """Postings of the tokens that two nodes or more have in their prefixes, with each list's pivot and least size.

    The lists are dealt by (token, salt), and a token's figures are first made
    for each salt, then combined: a token in a third of all nodes is split.
    """
    dealt = texts.mapInArrow(_postings(rule, shared), "token long, node long, place long, extra long").withColumn("salt", F.expr("pmod(node, extra & 2147483647)"))
    # Joins would filter nulls below the shuffle; said here, both uses of it stay alike and it is done once.
    dealt = dealt.where("token IS NOT NULL AND salt IS NOT NULL").repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token", "salt")
    size, pos = F.expr("shiftright(place, 31)"), F.expr("place & 2147483647")
    part = dealt.groupBy("token", "salt").agg(
        F.max(F.expr("extra & 2147483647")).alias("n_salts"),
        F.count("*").alias("n"),
        F.min("node").alias("lo"),
        F.max("node").alias("hi"),
        F.min(size).alias("least_size"),
        F.max(F.struct((size - pos).alias("left"), F.expr("shiftright(extra, 31)").alias("mid"), "node", size.alias("size"), pos.alias("pos"))).alias("best"),
    )
    whole = (
        part.where("n_salts > 1 OR lo <> hi")
        .groupBy("token")
        .agg(F.max("n_salts").alias("n_salts"), F.expr(f"1 + sum(n) div {PART_NODES}").alias("n_parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least_size").alias("least_size"), F.max("best").alias("best"))
        .where("lo <> hi")
        .select("token", F.explode(F.expr("sequence(0L, n_salts - 1)")).alias("salt"), "n_parts", "lo", "hi", "least_size", F.col("best.node").alias("pivot"), F.col("best.size").alias("pivot_size"), F.col("best.pos").alias("pivot_pos"))
    )
    # All columns stay up to here, so that both uses of the dealt postings share one shuffle.
    lists = dealt.join(whole.hint("shuffle_hash"), ["token", "salt"]).dropDuplicates(["token", "salt", "node"])
    third = F.expr("node <> lo AND node <> hi").alias("third")
    part = F.expr("pmod(xxhash64(node), n_parts)").alias("part")
    return lists.select("token", part, "n_parts", "node", size.alias("size"), pos.alias("pos"), "least_size", "pivot", "pivot_size", "pivot_pos", third, "extra")


def _fetched(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, make, kind: str, tables: list[DataFrame]) -> DataFrame:
    """What ``make`` says of each node of the pairs, one row a node; only texts that may be wanted go to Python.  The table that it reads joins ``tables``."""
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("rep", "node"), "wanted")
    tables.append(wanted)
    few = maybe_in(texts, F.col("doc_id"), wanted.select("rep"), "__wanted", wanted.count()).where("__wanted OR doc_id IS NULL").select("doc_id", "text")
    return few.mapInArrow(make, kind).where("node IS NOT NULL").join(wanted.select("node").hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])


def _joined(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Pairs with the columns of both nodes, ending in _a and _b."""
    sides = [made.select(*[F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in made.columns]) for k in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b")


def _verified(texts: DataFrame, pairs: DataFrame, nodes: DataFrame, rule: Rule, shared) -> DataFrame:
    """The pairs (a, b) that pass the filters of all orders and whose sets are similar enough, stored."""
    t = rule.percent
    left = stored(pairs, "pairs")
    tables = [left]
    prefixes = _fetched(texts, left, nodes, _prefixes(rule, shared), "node long, size long, first array<int>, second array<int>, third array<int>", tables)
    prefixes = stored(prefixes, "prefixes")
    tables.append(prefixes)
    for k in ("first", "second", "third"):
        # The tokens beyond one of the prefixes are all that can be shared besides those in both.
        # Two tokens of a prefix may have the same low bits: as many are added as one prefix has lost by that.
        enough = f"size(array_intersect({k}_a, {k}_b)) + size({k}_a) - size(array_distinct({k}_a)) >= greatest(1, ceil({t} * (size_a + size_b) / {100 + t}.0) - greatest(size_a - size({k}_a), size_b - size({k}_b)))"
        left = stored(_joined(left, prefixes.select("node", "size", k)).where(F.expr(enough)).select("a", "b"), "candidates")
        tables.append(left)
    sets = _fetched(texts, left, nodes, _sets(rule), "node long, tokens array<long>", tables)
    meet = F.size(F.array_intersect("tokens_a", "tokens_b"))
    links = _joined(left, sets).withColumn("meet", meet).where(F.expr(f"100 * meet >= {t} * (size(tokens_a) + size(tokens_b) - meet)")).select("a", "b")
    links = stored(links, "links")
    released(*tables)
    return links
