"""Mixing of sources to target weights by Pfair scheduling of blocks.

In the ideal, fluid mixture all sources that have blocks left flow at once, in
proportion to their weights.  Block j (from 0) of a source is released in the
slot in which the fluid begins it, and due when the fluid has ended it; in each
slot the released block with the earliest deadline goes (ties: by name).  While
no source has run out these are floor(j / w) and ceil((j + 1) / w) for the share w
of all weights.  Unit blocks on one processor then meet every deadline, so that
at no time of the whole run a source is a whole block ahead of the fluid or
behind it.  Weights count exactly, as the fractions that they are, and the whole
run is scheduled on the driver, which holds a number for each block.  All rows stay.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import stored

OTHER = "(other)"
BUCKET_ROWS = 256
BROADCAST_BLOCKS = 1 << 20
CHUNK = 256  # blocks whose slots make one row of the plan


def shares(weights: Mapping[str, float], period: int = 1000) -> dict[str, int]:
    """Whole shares of the period by largest remainder; each source has one slot at least.

    A period shorter than the number of sources is lengthened to hold them.
    """
    names, total = sorted(weights), sum(weights.values())
    period = max(period, len(names))
    exact = {n: weights[n] / total * period for n in names}
    out = {n: max(1, int(exact[n])) for n in names}
    while (over := sum(out.values()) - period) > 0:
        most = max(names, key=lambda n: (out[n] - exact[n] if out[n] > 1 else -period, n))
        out[most] -= min(over, 1)
    for n in sorted(names, key=lambda n: (out[n] - exact[n], n))[: period - sum(out.values())]:
        out[n] += 1
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, array]:
    """The slot of each block of each source over the whole run."""
    exact = {n: Fraction(weights[n]) for n, b in blocks.items() if b > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    left = {n: int(blocks[n]) for n in sorted(exact)}
    w = {n: int(exact[n] * scale) for n in left}
    # Sources in the order in which the fluid ends them, the blocks of those ended, the weight of those left.
    ends = sorted(left, key=lambda n: Fraction(left[n], w[n]))
    done, rest = [0], [sum(w.values())]
    for n in ends:
        done.append(done[-1] + left[n])
        rest.append(rest[-1] - w[n])
    limit = [(left[n], w[n]) for n in ends]
    at_end = dict.fromkeys(left, 0)  # how many sources had ended before a source's last block looked at

    def fluid(n: str, j: int) -> tuple[int, int]:
        """floor and ceiling of the time at which the fluid has given j blocks of n."""
        k, own = at_end[n], w[n]
        if k < len(limit) and limit[k][0] * own <= j * limit[k][1]:
            k = at_end[n] = bisect_right(limit, 0, k, key=lambda x: 0 if x[0] * own <= j * x[1] else 1)
        whole, part = divmod(done[k] * own + j * rest[k], own)
        return whole, whole + (part > 0)

    slots = {n: array("q") for n in left}
    ready: list[tuple[int, str, int]] = []
    waiting = [(0, n, 0, *fluid(n, 1)) for n in left]
    heapq.heapify(waiting)
    for slot in range(sum(left.values())):
        while waiting and waiting[0][0] <= slot:
            _, n, j, after, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, n, j, after))
        _, n, j, after = heapq.heappop(ready)  # never empty: the fluid fills every slot
        slots[n].append(slot)
        if j + 1 < left[n]:
            heapq.heappush(waiting, (after, n, j + 1, *fluid(n, j + 2)))
    return slots


def one_period(share: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period of whole shares."""
    return {n: list(s) for n, s in schedule(share, share).items()}


def mix(docs: DataFrame, weights: Mapping[str, float], block: int = 100_000, period: int | None = None, size: str = "octet_length(coalesce(text, ''))", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, source, block, slot, place of every row; sorting by (slot, place) gives the mixture.

    A source's rows are taken in an order scattered by id and text and cut into blocks of
    about ``block`` units of ``size``, an SQL expression on docs: a row belongs to
    the block in which it begins.  Rows of a source that ``weights`` does not
    list, null too, are mixed as "(other)", whose weight is ``weights["(other)"]``
    or else the mean weight.  Weights hold exactly; only with ``period`` are they
    first rounded to whole shares of so many slots.  The driver holds a number
    for each source and each block: ``block`` is to be chosen so that there are
    some millions of blocks at most.  Their numbers are broadcast if they are few.
    Null ids, repeated rows, empty texts and ties are rows like others.  With keep_row the struct
    ``row`` holds the columns of docs, whatever their names.  An empty table
    gives an empty one.
    """
    named = {n: float(w) for n, w in weights.items() if w > 0}
    named.setdefault(OTHER, sum(named.values()) / max(1, len(named)) or 1.0)
    listed = docs.sparkSession.createDataFrame([(n,) for n in named if n != OTHER], "__listed string")
    source = F.col(source_col).cast("string")
    # With the text, so that rows without an id, or with the same, are scattered too.
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col) if c in docs.columns]
    order = F.conv(F.substring(F.sha2(F.concat_ws("\n", *said), 256), 1, 15), 16, 10).cast("long")
    rows = docs.join(F.broadcast(listed), source == F.col("__listed"), "left").select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce("__listed", F.lit(OTHER)).alias("source"),
        F.greatest(F.expr(size).cast("long"), F.lit(1)).alias("__size"),
        order.alias("__order"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []),
    )
    # Rows before a row, without a window over a whole source: sums of hash ranges first, then within each.
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (int(most) // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("__part", F.shiftright("__order", 60 - bits))
    sums = stored(rows.groupBy("source", "__part").agg(F.sum("__size").alias("n")), "sums")
    # Sums before a hash range in two steps, over ranges of ranges and within each: no window holds more than the root of a source's ranges.
    sums = sums.withColumn("__wide", F.shiftright("__part", (bits + 1) // 2))
    wide = sums.groupBy("source", "__wide").agg(F.sum("n").alias("w"))
    running = lambda n, keys, by: F.sum(n).over(Window.partitionBy(*keys).orderBy(by)) - F.col(n)
    wide = wide.select("source", "__wide", running("w", ["source"], "__wide").alias("__start"))
    before = sums.join(wide, ["source", "__wide"]).select("source", "__part", (F.col("__start") + running("n", ["source", "__wide"], "__part")).alias("__before"))
    inner = Window.partitionBy("source", "__part").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(before, ["source", "__part"]).withColumn("__at", F.col("__before") + F.coalesce(F.sum("__size").over(inner), F.lit(0)))
    rows = rows.withColumn("block", F.expr(f"__at div {int(block)}"))

    # A block that no row begins in has no rows; its slot stays empty and shifts nothing.
    totals = {r["source"]: -(-int(r["n"]) // int(block)) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each stated source
    blocks = {n: b for n, b in totals.items() if b > 0}
    plan = schedule(blocks, shares({n: named[n] for n in blocks}, period) if period and blocks else named)
    chunks = [(n, k // CHUNK, s[k : k + CHUNK]) for n, s in plan.items() for k in range(0, len(s), CHUNK)]
    kind = pa.schema([("__s", pa.string()), ("__chunk", pa.int64()), ("__slots", pa.list_(pa.int64()))])
    steps = stored(docs.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*chunks, strict=True)) or [[]] * 3, kind, strict=True)], kind)), "slots")
    chunk = F.floor(F.col("block") / CHUNK).cast("long")
    # Eight bytes a block: broadcast up to 8 MB, beyond that the planner deals both sides out.
    timed = rows.join(F.broadcast(steps) if sum(map(len, plan.values())) <= BROADCAST_BLOCKS else steps, (F.col("source") == F.col("__s")) & (chunk == F.col("__chunk")))
    slot = F.get("__slots", (F.col("block") % CHUNK).cast("int"))
    return timed.select("doc_id", "source", "block", slot.alias("slot"), F.col("__at").alias("place"), *(["row"] if keep_row else []))


def tempered_weights(docs: DataFrame, power: float = 0.5, size: str = "octet_length(coalesce(text, ''))", source_col: str = "source") -> dict[str, float]:
    """Target weights in proportion to a power of each source's size, null's under "(other)"; the driver holds a number for each source."""
    sums = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(OTHER)).alias("s")).agg(F.sum(F.expr(size).cast("double")).alias("n"))
    out = {r["s"]: max(float(r["n"] or 0), 1.0) ** power for r in sums.collect()}
    out.setdefault(OTHER, 1.0)
    return out
