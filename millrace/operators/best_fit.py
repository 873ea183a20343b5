"""Best-fit decreasing over a whole table: the plan comes from the histogram of lengths, rows find their places by rank.

The rule takes rows by falling length and puts each into the fullest bin that holds it, the earliest of equals. All
rows of one length, and all bins with equal room, are alike to it. So runs of rows fill runs of bins: a run of bins
with room r takes r // a rows of length a each, one bin after the other. The plan lists these runs. It is made on the
driver from one count for each length up to the bin size, whatever the number of rows, and goes to the tasks as a
small table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import dense_index
from millrace.operators.rows import RowError


@dataclass(frozen=True)
class Run:
    """Rows ``low`` to ``high`` (exclusive) in the order of falling lengths: ``each`` of them go to bin ``first``, as many to the next, and so on."""

    length: int
    low: int
    high: int
    first: int
    each: int


class _Rooms:
    """Runs of bins (first bin, number) by the room that is left in each of them; a whole number has a bit for each room."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.bits = 0

    def add(self, room: int, first: int, count: int) -> None:
        if count:
            heapq.heappush(self.runs.setdefault(room, []), (first, count))
            self.bits |= 1 << room

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(room, first bin, number) of the earliest run with the least room of at least ``least``; it is gone then."""
        left = self.bits >> least
        if not left:
            return None
        room = least + (left & -left).bit_length() - 1
        first, count = heapq.heappop(self.runs[room])
        if not self.runs[room]:
            self.bits ^= 1 << room
        return room, first, count


def plan(histogram: dict[int, int], size: int) -> list[Run]:
    """Runs for all rows; lengths over ``size`` count as size + 1 and fill a bin alone."""
    rooms, used, at, runs = _Rooms(), 0, 0, []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            found = rooms.take(length) if length <= size else None
            if found is None:  # as many new bins as the rest of the rows needs
                room = max(size, length)
                each = room // length if length else left
                found = (room, used, -(-left // each))
                used += found[2]
            room, first, count = found
            each = room // length if length else left
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            runs.append(Run(length, at, at + full * each + rest, first, each))
            rooms.add(room - each * length, first, full)
            if rest:
                rooms.add(room - rest * length, first + full, 1)
            rooms.add(room, first + full + (rest > 0), count - full - (rest > 0))
            at += full * each + rest
            left -= full * each + rest
    return runs


def best_fit(df: DataFrame, tokens: str, size: int, *order: str, into: str = "bin") -> DataFrame:
    """``df`` with the bin of each row by best-fit decreasing over the whole table, rows of equal length in ``order``.

    Rows longer than ``size`` fill a bin alone; a row of length 0 joins the fullest bin. Rows without a length (null)
    are refused, as are negative ones. Rows that tie in ``order`` too may change places. An empty table gives no rows.
    """
    if size < 1:
        raise RowError(f"bins hold at least 1 token, got {size}")
    kind = "__length"
    n = F.col(tokens).cast("long")
    capped = df.withColumn(kind, F.when(n > size, size + 1).otherwise(n))
    counts = capped.groupBy(kind).count().collect()  # at most size + 2 rows, and one of all that is refused
    if any(r[kind] is None or r[kind] < 0 for r in counts):
        raise RowError(f"{tokens} must be a length in every row")
    runs = plan({r[kind]: r["count"] for r in counts}, size)
    table = df.sparkSession.createDataFrame([(r.length, r.low, r.high, r.first, r.each) for r in runs], f"{kind} long, __low long, __high long, __first long, __each long")
    ranked = dense_index(capped, F.desc(tokens), *[F.asc(o) for o in order], into="__rank")
    within = (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    placed = ranked.join(F.broadcast(table), kind).filter(within)  # some runs for each length
    return placed.withColumn(into, F.col("__first") + F.floor((F.col("__rank") - F.col("__low")) / F.col("__each"))).drop(kind, "__rank", "__low", "__high", "__first", "__each")


def best_fit_pieces(df: DataFrame, key: str, tokens: str, size: int) -> DataFrame:
    """(key, start, length, bin): rows over ``size`` are cut into pieces of it and a rest, then all are placed by best_fit(); rows without tokens have no piece."""
    n = F.col(tokens).cast("long")
    pieces = df.filter(F.col(tokens) > 0).select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("start"))
    pieces = pieces.select(key, "start", F.least(F.lit(size).cast("long"), F.col("__n") - F.col("start")).alias("length"))
    return best_fit(pieces, "length", size, key, "start").select(key, "start", "length", "bin")
