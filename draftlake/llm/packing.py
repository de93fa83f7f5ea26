"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut in pieces of that length and a rest.  How many
pieces there are of each size is all that the packing needs: that table has at most as many rows as
the largest length, whatever the input, and the plan is made from it.  Sizes go from large to
small; pieces fill the open bins with the least room that holds them.  Where none does, bins of
the length with the least cost for each token expected in them are opened; lengths compete by what
is still to come for their room.  In the end every bin shrinks to the least permitted length
that holds its contents.  Pieces get their place by their rank within their size, counted in
slots so that no task sees all pieces of one size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, save

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # cost of a sequence beside its tokens

WORDS = r"[^\x20\x09-\x0D]+"


class Plan:
    """Runs of bins: a move puts pieces first_rank.. of one size in bins first_bin.. at one offset."""

    def __init__(self, count: dict[int, int], lengths: tuple[int, ...], overhead: int):
        self.moves: list[tuple[int, int, int, int]] = []  # size, first rank, first bin, offset
        self.bins = 0
        self.room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> runs (first bin, bins, length)
        self.rooms: list[int] = []
        self.lengths, self.overhead = sorted(lengths), overhead
        self.rank: dict[int, int] = {}
        sizes = sorted(count)
        volume = dict(zip(sizes, np.cumsum([s * count[s] for s in sizes]).tolist(), strict=True))
        for s in reversed(sizes):
            left = count[s]
            while left:
                at = bisect.bisect_left(self.rooms, s)
                if at == len(self.rooms):
                    self._open(s, left, sizes, volume)
                    continue
                left -= self._fill(self.rooms[at], s, left)
        runs = sorted((first, n, length - room) for room, held in self.room.items() for first, n, length in held)
        self.first_bin = np.array([r[0] for r in runs], np.int64)
        self.used = np.array([r[2] for r in runs], np.int64)
        self.length = np.array(self.lengths, np.int64)[np.searchsorted(self.lengths, self.used)]
        self.cost = int(sum(n * (length + overhead) for (_, n, _), length in zip(runs, self.length.tolist(), strict=True)))

    def _open(self, s: int, left: int, sizes: list[int], volume: dict[int, int]) -> None:
        def price(length: int) -> tuple[float, int]:
            each = length // s
            n = -(-left // each)
            rest = length - each * s
            k = bisect.bisect_right(sizes, min(rest, s - 1))
            to_come = volume[sizes[k - 1]] if k else 0
            return (length + self.overhead) / (each * s + min(rest, to_come / n)), length

        length = min((x for x in self.lengths if x >= s), key=price)
        self._put(length, (self.bins, -(-left // (length // s)), length))
        self.bins += -(-left // (length // s))

    def _put(self, room: int, run: tuple[int, int, int]) -> None:
        if room not in self.room:
            bisect.insort(self.rooms, room)
            self.room[room] = []
        self.room[room].append(run)

    def _fill(self, room: int, s: int, left: int) -> int:
        """Put up to left pieces of size s in the bins with this room, one in each."""
        held, placed, stay = self.room.pop(room), 0, []
        self.rooms.remove(room)
        for first, n, length in held:
            take = min(n, left - placed)
            if take:
                self.moves.append((s, self.rank.get(s, 0), first, length - room))
                self.rank[s] = self.rank.get(s, 0) + take
                self._put(room - s, (first, take, length))
                placed += take
            if take < n:
                stay.append((first + take, n - take, length))
        for run in stay:
            self._put(room, run)
        return placed

    def look_up(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bin, offset in it, its tokens and its length, for pieces by size and rank."""
        m = np.array(sorted(self.moves), np.int64).reshape(-1, 4)
        at = np.searchsorted((m[:, 0] << 44) + m[:, 1], (size << 44) + rank, side="right") - 1
        bin_ = m[at, 2] + rank - m[at, 1]
        run = np.searchsorted(self.first_bin, bin_, side="right") - 1
        return bin_, m[at, 3], self.used[run], self.length[run]


def make_plan(count: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> Plan:
    """The cheaper of the joint plan and the one that opens the largest length only, both shrunk in the end."""
    plans = [Plan(count, lengths, overhead)]
    single = Plan(count, (max(lengths),), overhead)
    single.length = np.array(sorted(lengths), np.int64)[np.searchsorted(sorted(lengths), single.used)]
    ends = np.append(single.first_bin[1:], single.bins)
    single.cost = int(((single.length + overhead) * (ends - single.first_bin)).sum()) if len(single.used) else 0
    return min([*plans, single], key=lambda p: p.cost)


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_offset, bin_tokens, bin_length: every word of every document once.

    A document has its words and one end mark as tokens, so null and empty texts have one token.
    Repeated rows are packed one by one; rows without id too.  Other columns are ignored.
    """
    spark, most = docs.sparkSession, max(lengths)
    slots = 4 * partitions(spark)
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORDS)).cast("long") + 1
    sized = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")), "sizes")
    pieces = sized.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_tokens"), F.pmod(F.xxhash64("row", "piece"), F.lit(slots)).alias("slot"))
    counts = save(pieces.groupBy("n_tokens", "slot").agg(F.count(F.lit(1)).alias("n")), "counts")
    plan = make_plan({r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}, tuple(lengths), overhead)  # at most max(lengths) rows
    before = Window.partitionBy("n_tokens").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("n_tokens", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("n_tokens", "slot").orderBy("doc_id", "row", "piece")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(base, ["n_tokens", "slot"])
    ranked = ranked.select("doc_id", "piece", "n_tokens", (F.col("base") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = plan.look_up(b.column("n_tokens").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("n_tokens"), *map(pa.array, found)], names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "bin_length"])

    return ranked.mapInArrow(place, "doc_id long, piece long, n_tokens long, bin_id long, bin_offset long, bin_tokens long, bin_length long")
