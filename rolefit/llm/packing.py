"""Operator 4: best-fit-decreasing packing with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm._work import id_and_text, mapped, staged
from rolefit.llm.tokens import encoded_rows

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open bins each has, and the tightest that holds a size, in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, size: int) -> int | None:
        """The least capacity of an open bin that is `size` or more."""
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


class Step(NamedTuple):
    """Pieces of one size with ranks rank.. go, `each` to a bin, into bins first_bin.. from `offset` on."""

    size: int
    rank: int
    first_bin: int
    each: int
    offset: int


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """Best-fit decreasing over how many pieces each size has.

    Bins with equal remaining capacity are alike, so whole runs of bins take pieces of a size in one step. The work follows
    the number of sizes and capacities (`capacity` at most), not the number of pieces. Each size goes, bin after bin, to
    the tightest open capacity, as best-fit decreasing does with one piece after the other; a bin that can take more of
    the size is then the tightest itself, so it takes as many as fit.
    """
    tree, bins_with, steps, opened = CapacityTree(capacity), defaultdict(list), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def place(first: int, bins: int, room: int, each: int, size: int = size) -> None:
            nonlocal left, rank
            steps.append(Step(size, rank, first, each, capacity - room))
            rank, left = rank + bins * each, left - bins * each
            if rest := room - each * size:
                bins_with[rest].append((first, bins))
                tree.add(rest, bins)

        def fill(first: int, bins: int, room: int, size: int = size) -> int:
            """Puts pieces into a run of bins; the number of bins used."""
            each = room // size
            if full := min(bins, left // each):
                place(first, full, room, each)
            if full < bins and left:
                place(first + full, 1, room, left)
                full += 1
            return full

        while left and (room := tree.tightest(size)) is not None:
            first, bins = bins_with[room].pop()
            tree.add(room, -bins)
            used = fill(first, bins, room)
            if used < bins:
                bins_with[room].append((first + used, bins - used))
                tree.add(room, bins - used)
        if left:
            each = capacity // size
            opened += fill(opened, -(-left // each), capacity)
    return steps


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded_rows(batch.column("text"), path, end_id), strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return cut


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of `docs`.

    Every text is encoded whole (null text: empty), followed by `end_id`; texts of more than `capacity` ids are cut into
    pieces of `capacity`, the last one shorter. Best-fit decreasing then runs over all pieces of the table at once: the driver
    plans with the number of pieces of each length (`capacity` numbers at most, whatever the size of the table), and
    each piece finds its bin by its rank among the pieces of its length. Equal lengths are ranked by input partition and place.

    Null ids and repeated rows are packed like any others; an empty table gives no rows. Other columns are not read.
    """
    pieces = staged(mapped(id_and_text(docs, id_col, text_col), _cutter(tokenizer, capacity, end_id), _PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.max("place").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = staged(by_part.select("length", "part", before.alias("base"), "last"), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    size, rank, first_bin, each, offset = (np.array(c, np.int64) for c in (zip(*plan, strict=True) if plan else [[]] * 5))
    order = np.lexsort((rank, size))
    size, rank, first_bin, each, offset = (c[order] for c in (size, rank, first_bin, each, offset))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, ranked: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), ranked.to_numpy()
        at = np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            low, high = np.searchsorted(size, n), np.searchsorted(size, n, "right")
            own = lengths == n
            at[own] = low + np.searchsorted(rank[low:high], ranks[own], "right") - 1
        gone = ranks - rank[at]
        return pd.DataFrame({"sequence_id": first_bin[at] + gone // each[at], "offset": offset[at] + gone % each[at] * lengths})

    ranked = pieces.join(bases.select("length", "part", "base").hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.withColumn("at", where("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
