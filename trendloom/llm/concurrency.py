"""Peak concurrency: how many intervals of a group are open after each change, by interval trees over chunks of time.

Time is dealt into chunks of fixed width.  An interval leaves a piece in the
chunk where it starts and in the chunk where it stops, and pieces of equal
places are added up before they move: a chunk of ``units`` moments can hold no
more than about units**2 / 2 pieces of different places, whatever the input.
What covers a chunk from end to end comes from running sums of the chunks'
totals, a row a group and chunk, and joins the pieces as one more.  Each chunk's
pieces form a static centred interval tree, whose nodes keep their intervals
sorted by start and by stop, with cumulative counts and amounts; every moment of
change stabs it.  The maxima and first moments of the chunks are then scanned to
find successors, running maxima and peaks across chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import stored

UNIT = 60  # seconds in a moment
UNITS = 1440  # moments in a chunk
EVERYONE = -2
NO_NATION = -1

ROWS = "group int, chunk long, from_s long, to_s long, n_open long, open_cents long, high_open long"


def utc_seconds(df: DataFrame, column: str, unit: int = UNIT) -> Column:
    """Seconds since 1970 in UTC, rounded down to ``unit``; a time without a zone counts as UTC whatever the session's zone."""
    kind = dict(df.dtypes)[column]
    at = F.col(f"`{column}`")
    micros = F.unix_micros(at) if kind == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{column}` AS TIMESTAMP_NTZ))")
    step = F.lit(unit * 1_000_000)
    return ((micros - F.pmod(micros, step)) / F.lit(1_000_000)).cast("long")


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, after_days: int = 7) -> DataFrame:
    """group (the client's nation, or NO_NATION), start, stop (null: never) and cents of every sale that is open at all.

    A sale stops ``after_days`` after the latest shipping time of its lines; one
    whose lines have none never does.  Sales without a time, or whose stop is not
    after the start, are left out.  A null total is 0 cents.  A sale_id that
    occurs twice in ``sales`` counts twice; a client_id that occurs twice in
    ``clients`` counts with its least nation; null ids match nothing.  Empty
    tables and further columns do no harm.
    """
    shipped = lines.select(F.col("sale_id").cast("long").alias("__sale"), utc_seconds(lines, "shipped_at").alias("__at")).where("__sale IS NOT NULL AND __at IS NOT NULL")
    # Tables, so that the joins below may split a sale or client that holds very many rows.
    stops = stored(shipped.groupBy("__sale").agg((F.max("__at") + after_days * 86_400).alias("stop")), "stops")
    nations = stored(clients.where("client_id IS NOT NULL AND nation_id IS NOT NULL").groupBy(F.col("client_id").cast("long").alias("__client")).agg(F.min(F.col("nation_id").cast("int")).alias("__nation")), "nations")
    cents = F.coalesce(F.floor(F.col("total") * 100 + 0.5).cast("long"), F.lit(0).cast("long"))
    sold = sales.select(F.col("sale_id").cast("long").alias("sale"), F.col("client_id").cast("long").alias("client"), utc_seconds(sales, "sold_at").alias("start"), cents.alias("cents")).where("start IS NOT NULL")
    found = sold.join(nations.hint("merge"), F.col("client") == F.col("__client"), "left").select("sale", "start", "cents", F.coalesce("__nation", F.lit(NO_NATION)).alias("group"))
    found = found.join(stops.hint("merge"), F.col("sale") == F.col("__sale"), "left")
    return found.where("stop IS NULL OR stop > start").select("group", "start", "stop", "cents")


def pieces(intervals: DataFrame, everyone: int | None = EVERYONE, unit: int = UNIT, units: int = UNITS) -> DataFrame:
    """group, chunk, lo, hi, n, cents: what each chunk holds of the intervals that start or stop in it, equal places added up.

    Places are moments of the chunk; lo = -1 is open before it, hi = units open
    after it.  With ``everyone`` each interval also counts for that group.
    """
    width = unit * units
    of = lambda c: ((F.col(c) - F.pmod(c, F.lit(width))) / width).cast("long")
    place = lambda c: F.floor(F.pmod(F.col(c), F.lit(width)) / unit).cast("int")
    piece = lambda chunk, lo, hi: F.struct(chunk.alias("chunk"), lo.alias("lo"), hi.alias("hi"))
    before, after = F.lit(-1), F.lit(units)
    first, last = of("start"), of("stop")
    own = (
        F.when(first == last, F.array(piece(first, place("start"), place("stop"))))
        .when(F.col("stop").isNull(), F.array(piece(first, place("start"), after)))
        .otherwise(F.array(piece(first, place("start"), after), piece(last, before, place("stop"))))
    )
    own_group = F.col("group").cast("int")
    groups = F.array(own_group, F.lit(everyone)) if everyone is not None else F.array(own_group)
    rows = intervals.select(F.explode(own).alias("p"), "cents", groups.alias("groups")).select("p.*", "cents", F.explode("groups").alias("group"))
    return rows.groupBy("group", "chunk", "lo", "hi").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def covering(parts: DataFrame, units: int = UNITS) -> DataFrame:
    """For each group and chunk of ``parts``, one more piece: the intervals that are open all through it.

    They started in a chunk before and have stopped neither before nor in it.
    The window holds a row a chunk, as many as the time has chunks.
    """
    sums = [F.sum(F.when(test, F.col(c)).otherwise(0)).alias(f"{name}_{c}") for name, test in (("begun", F.col("lo") >= 0), ("over", F.col("hi") < units), ("carried", F.col("lo") < 0)) for c in ("n", "cents")]
    chunks = parts.groupBy("group", "chunk").agg(*sums)
    earlier = Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    open_ = lambda c: (F.coalesce(F.sum(F.col(f"begun_{c}") - F.col(f"over_{c}")).over(earlier), F.lit(0)) - F.col(f"carried_{c}")).cast("long")
    return chunks.select("group", "chunk", F.lit(-1).alias("lo"), F.lit(units).alias("hi"), open_("n").alias("n"), open_("cents").alias("cents")).where("n <> 0 OR cents <> 0")


class IntervalTree:
    """A static centred interval tree over [-1, units): all nodes of a level in one pair of sorted endpoint lists.

    A node covers a range of moments and keeps the intervals that hold its
    centre; those wholly before or behind go to its children.  The lists, by
    start and by stop, carry cumulative sums, so that a stab costs two look-ups a
    level and there are about log2(units) levels.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray, units: int) -> None:
        """values: a column for each number that is summed."""
        self.units, self.levels = units, []
        a, b = np.full(len(lo), -1), np.full(len(lo), units)
        while len(lo):
            centre = (a + b) // 2
            here = (lo <= centre) & (hi > centre)
            self.levels.append((*self._listed(a[here], lo[here], values[here]), *self._listed(a[here], hi[here], values[here])))
            left = hi <= centre
            a, b = np.where(left, a, centre + 1)[~here], np.where(left, centre, b)[~here]
            lo, hi, values = lo[~here], hi[~here], values[~here]

    def _key(self, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (node + 1) * (self.units + 3) + place + 1

    def _listed(self, node: np.ndarray, place: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self._key(node, place)
        order = np.argsort(key, kind="stable")
        return key[order], np.concatenate((np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[order], axis=0)))

    def stabbed(self, moments: np.ndarray) -> np.ndarray:
        """Sums of the values of all intervals that hold each moment."""
        out = np.zeros((len(moments), self.levels[0][1].shape[1] if self.levels else 2), np.int64)
        who, t = np.arange(len(moments)), moments
        a, b = np.full(len(moments), -1), np.full(len(moments), self.units)
        for starts, start_sums, stops, stop_sums in self.levels:
            centre = (a + b) // 2
            early = t < centre
            begun = start_sums[np.searchsorted(starts, self._key(a, t), "right")] - start_sums[np.searchsorted(starts, self._key(a, np.full(len(a), -1)))]
            going = stop_sums[np.searchsorted(stops, self._key(a, np.full(len(a), self.units)), "right")] - stop_sums[np.searchsorted(stops, self._key(a, t), "right")]
            out[who] += np.where(early[:, None], begun, going)
            on = t != centre
            a, b = np.where(early, a, centre + 1)[on], np.where(early, centre, b)[on]
            who, t = who[on], t[on]
        return out


def chunk_rows(part: pd.DataFrame, unit: int = UNIT, units: int = UNITS) -> pd.DataFrame:
    """The changes of one group in one chunk: each moment at which its sums differ from those just before."""
    lo, hi = part["lo"].to_numpy(np.int64), part["hi"].to_numpy(np.int64)
    tree = IntervalTree(lo, hi, part[["n", "cents"]].to_numpy(np.int64), units)
    moments = np.unique(np.concatenate(([-1], lo[lo >= 0], hi[hi < units])))
    sums = tree.stabbed(moments)
    changed = np.flatnonzero((sums[1:] != sums[:-1]).any(axis=1)) + 1
    at = int(part["chunk"].iloc[0]) * unit * units + moments[changed] * unit
    following = pd.array(np.append(at[1:], 0), dtype="Int64")
    if len(at):
        following[-1] = pd.NA
    n = sums[changed, 0]
    return pd.DataFrame({"group": part["group"].iloc[0], "chunk": part["chunk"].iloc[0], "from_s": at, "to_s": following[: len(at)], "n_open": n, "open_cents": sums[changed, 1], "high_open": np.maximum.accumulate(n)})


def concurrency(intervals: DataFrame, everyone: int | None = EVERYONE, unit: int = UNIT, units: int = UNITS) -> DataFrame:
    """A row for each group and moment at which its open intervals change in number or amount.

    ``intervals`` has group (int), start, stop (multiples of ``unit`` with stop >
    start; null: open forever) and cents.  Moments whose starts and stops cancel
    out give no row.  to_s is the group's next moment, null at its last; high_open
    the largest n_open so far, this row's too; is_peak marks the largest of all.
    Repeated intervals count each; no intervals give no rows.
    """
    parts = stored(pieces(intervals, everyone, unit, units), "pieces")
    whole = parts.unionByName(covering(parts, units))
    rows = stored(whole.groupBy("group", "chunk").applyInPandas(lambda p: chunk_rows(p, unit, units), ROWS), "changes")
    chunks = rows.groupBy("group", "chunk").agg(F.min("from_s").alias("first"), F.max("n_open").alias("most"))
    by_time = Window.partitionBy("group").orderBy("chunk")
    chunks = chunks.select(
        F.col("group").alias("__group"),
        F.col("chunk").alias("__chunk"),
        F.lead("first").over(by_time).alias("next_first"),
        F.max("most").over(by_time.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.max("most").over(Window.partitionBy("group")).alias("peak"),
    )
    joined = rows.join(chunks.hint("merge"), (F.col("group") == F.col("__group")) & (F.col("chunk") == F.col("__chunk")))
    return joined.select(
        F.col("group").alias("nation_id"),
        "from_s",
        F.coalesce("to_s", "next_first").alias("to_s"),
        "n_open",
        "open_cents",
        F.greatest("high_open", "before").alias("high_open"),
        (F.col("n_open") == F.col("peak")).alias("is_peak"),
    )
