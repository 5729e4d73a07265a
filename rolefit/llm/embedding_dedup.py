"""Operator 6: embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rolefit.llm._work import mapped, staged
from rolefit.llm.graph import connected_components


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, width or 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to 1/2 .. 1: exact, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int, apart: float = 0.8) -> np.ndarray:
    """Up to `n` unit vectors of the sample, no two of which have a cosine over `apart`: copies of a vector give one pivot."""
    unit = _unit(sample)
    chosen, taken = np.empty((min(n, len(unit)), sample.shape[1])), 0
    for x in unit:
        if taken < n and (not taken or (chosen[:taken] @ x).max() <= apart):
            chosen[taken] = x
            taken += 1
    return chosen[:taken]


def _describe(pivots: dict[int, np.ndarray], prefix: int, shared: int):
    """Each vector's nearest pivots, nearest first: its permutation, cut to `prefix` places."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                p = pivots.get(int(dim), np.empty((0, int(dim))))
                m = min(prefix, len(p))
                if m < shared:  # too few pivots to tell vectors apart: all stand in the same lists
                    m = shared
                    near = np.tile(np.arange(m), (own.num_rows, 1))
                else:
                    near = np.argsort(-(_unit(_matrix(own.column("vector"))) @ p.T), axis=1, kind="stable")[:, :m]
                lists = pa.ListArray.from_arrays(pa.array((np.arange(own.num_rows + 1) * m).astype(np.int32)), pa.array(near.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([own.column("node"), own.column("dim"), lists], names=["node", "dim", "near"])

    return describe


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def shared_pivots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many pivots every row of `x` has in common with every row of `y`."""
    known, at = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    has = np.zeros((len(x) + len(y), len(known)), np.float32)
    has[np.repeat(np.arange(len(has)), x.shape[1]), at] = 1
    return has[: len(x)] @ has[len(x) :].T


def _homes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows the pivot that both have and that is nearest to them: least sum of its two places, then least number."""
    width = x.shape[1]
    places = np.add.outer(np.arange(width), np.arange(width))
    rank = np.where(x[:, :, None] == y[:, None, :], places * (1 << 40) + x[:, :, None], 1 << 60)
    return rank.reshape(len(x), width * width).min(axis=1) % (1 << 40)


def _linker(threshold: float, shared: int):
    """Compares the vectors of one list, or of two of its blocks: for each vector the rows linked with it and its local component."""

    def link(table: pa.Table) -> pa.Table:
        first, second, pivot = (table.column(c)[0].as_py() for c in ("first", "second", "pivot"))
        block = table.column("block").to_numpy()
        raw, near, node, size = _scaled(_matrix(table.column("vector"))), _matrix(table.column("near")).astype(np.int64), table.column("node").to_numpy(), table.column("size").to_numpy()
        unit = _unit(raw)
        rows, cols = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links, label, pairs = np.zeros(len(node), np.int64), np.arange(len(node)), [np.empty((2, 0), np.int64)]
        step = max(1, (1 << 20) // max(1, len(cols)))
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            i, j = np.nonzero((unit[own] @ unit[cols].T >= threshold - 1e-9) & (shared_pivots(near[own], near[cols]) >= shared))
            i, j = own[i], cols[j]
            ahead = i < j if first == second else np.ones(len(i), bool)
            i, j = i[ahead], j[ahead]
            # A pair meets in the list of every pivot that both have, and counts in that of the nearest alone.
            here = (_cosines(raw[i], raw[j]) >= threshold) & (_homes(near[i], near[j]) == pivot)
            i, j = i[here], j[here]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            pairs.append(_spread(label, i, j))
        while True:
            before = label.copy()
            _spread(label, *np.concatenate(pairs, axis=1))
            if (label == before).all():
                break
        hit = links > 0
        return pa.table({"node": node[hit], "links": links[hit], "other": node[label[hit]]})

    return link


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Brings the least label to all that pairs (i, j) connect, and returns a star of pairs that connects the same."""
    while len(i):
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label[:] = label[label]
        if (label == before).all():
            break
    ends = np.unique(np.concatenate([i, j]))
    return np.stack([ends, label[ends]])


def embedding_links(vectors: DataFrame, threshold: float = 0.95, prefix: int = 6, shared: int = 2, block_rows: int = 1024, most_pivots: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`.

    Pivots are vectors of a bounded sample (at most 4 * `most_pivots` distinct vectors by least hash), about twice the square root of the number of
    distinct vectors, `most_pivots` at most, none close to another. Every vector is described by the order of its `prefix` nearest pivots and stands in
    the inverted list of each. Two vectors that meet in a list are a candidate if they share `shared` pivots or more, and are linked if their
    cosine in double precision is `threshold` or more. Only vectors of equal length are compared; where these give fewer than `shared`
    pivots, as a tight group does, they all stand in the same lists, and every two of them meet.

    Equal vectors are one node with a weight. A list of more than `block_rows` nodes is dealt out as pairs of blocks; a task sends on
    counts and one edge for each of its vectors, never pairs. Lists are made and sized of ids alone; vectors, in the table's own precision, join those
    that have company. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Null ids are returned with 0
    links and null component. Rows that share an id are one node of the components. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("vector"))
    sound = F.expr(f"coalesce(size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < {number}('Infinity')) and exists(vector, x -> x <> 0), false) and vec_id is not null")
    good = base.where(sound).withColumn("vector", F.expr(f"transform(vector, x -> x + cast(0 as {number}))"))
    nodes = staged(good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")).withColumn("dim", F.size("vector")), "nodes")
    pivots = {}
    for dim, n in nodes.groupBy("dim").count().collect():
        m = min(most_pivots, max(24, math.ceil(2 * math.sqrt(n))))
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(4 * m).select("vector").toArrow()
        pivots[dim] = choose_pivots(_matrix(sample.column("vector")), m)
    few = max(1, shared)
    described = staged(mapped(nodes.select("node", "dim", "vector"), _describe(pivots, prefix, few), "node long, dim int, near array<int>"), "described")
    listed = described.select("node", "dim", "near", F.explode("near").alias("pivot"))
    sizes = staged(listed.groupBy("dim", "pivot").agg(F.count("*").alias("n")).where("n > 1").select("dim", "pivot", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "lists")
    met = listed.join(sizes.hint("merge"), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = met.join(nodes.select("node", "dim", "size", "vector").hint("merge"), ["node", "dim"])
    dealt = whole.withColumn("pair", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as first, greatest(o, block) as second))"))).select("dim", "pivot", "pair.first", "pair.second", "block", "node", "size", "vector", "near")
    found = staged(dealt.groupBy("dim", "pivot", "first", "second").applyInArrow(_linker(threshold, few), "node long, links long, other long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    member = good.join(nodes.select("vector", "node", "size").hint("merge"), "vector").select("vec_id", "node", "size")
    linked = member.join(counts.hint("merge"), "node", "left").join(parts.hint("merge"), "node", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rest = base.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
