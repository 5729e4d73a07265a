"""Operator 1: MinHash near-duplicates by one-permutation hashing with optimal densification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm import _hashing as H
from rolefit.llm._work import id_and_text, mapped, staged, text_chunks
from rolefit.llm.graph import connected_components

_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
#: Star rounds before the remaining pairs of different components are tested directly, and the pairs a bucket row may bring.
STAR_ROUNDS, PAIRS_A_ROW = 2, 8
#: Longs of a set's bitmap: one bit for each shingle's hash modulo the bits. A bit that only one of two sets has proves a shingle that the other lacks.
BITMAP_LONGS = 32


def _probes(bins: int, tries: int) -> np.ndarray:
    """For every bin its sequence of bins to borrow from, each step a fresh hash of (bin, attempt)."""
    grid = np.arange(bins, dtype=H.U)[:, None] * H.U(0x9E3779B97F4A7C15) + np.arange(1, tries + 1, dtype=H.U)[None] * H.U(0xC2B2AE3D27D4EB4F)
    return (H.mix(grid) % H.U(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation signature: the least hash of each bin; an empty bin copies the first occupied bin of its probe sequence.

    `shingles`: sorted, distinct, not empty; bins are equal ranges of hashes, so a bin's least is its first.
    """
    width = H.U(-(-(1 << 64) // bins))
    at = np.searchsorted(shingles, np.arange(bins, dtype=H.U) * width)
    filled = np.zeros(bins, bool)
    filled[(shingles // width).astype(np.int64)] = True
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    for wide in (16, probes.shape[1]):
        if len(empty):
            there = filled[probes[empty, :wide]]
            hit = there.any(axis=1)
            out[empty[hit]] = out[probes[empty[hit], there.argmax(axis=1)[hit]]]
            empty = empty[~hit]
    if len(empty):  # none of the tries met an occupied bin: the next one round the circle
        full = np.flatnonzero(filled)
        out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
    return out


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, probes = H.table(1, fold_case=True), _probes(bands * rows, 1024)
        band = np.arange(1, bands + 1, dtype=H.U) * H.U(0x9FB21C651E98DF25)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column("text")):
                sets = H.shingle_sets(data, offsets, values, size)
                keys, s1, s2 = [], [], []
                for s in sets:
                    s1.append(H.mix(s).sum(dtype=H.U))
                    s2.append(H.mix(s ^ H.U(0xA0761D6478BD642F)).sum(dtype=H.U))
                    if len(s):
                        grid = signature(s, bands * rows, probes).reshape(bands, rows)
                        key = band.copy()
                        for r in range(rows):
                            key = H.mix(key + grid[:, r])
                        keys.append(key)
                counts = np.array([len(s) for s in sets], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum((counts > 0) * bands)]).astype(np.int32)),
                    pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(counts), pa.array(np.array(s1, H.U).view(np.int64)), pa.array(np.array(s2, H.U).view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return sign


def _bitmapper(size: int):
    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = H.table(1, fold_case=True)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column("text")):
                sets = H.shingle_sets(data, offsets, values, size)
                bits = np.zeros((len(sets), 64 * BITMAP_LONGS), np.uint8)
                for row, s in zip(bits, sets, strict=True):
                    row[(s % H.U(bits.shape[1])).astype(np.int64)] = 1
                longs = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BITMAP_LONGS), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits.sum(axis=1, dtype=np.int64)), longs], names=["node", "n_shingles", "ones", "bits"])

    return bitmaps


def _possible(percent: int) -> str:
    """SQL condition on rows x and y with (n_shingles, ones, b0, b1, ...): false only if the bits alone show that the sets share too little; true without bits (ones below 0)."""
    alone = " + ".join(f"bit_count(x.b{i} & ~y.b{i})" for i in range(BITMAP_LONGS))
    return f"(x.ones < 0 or y.ones < 0 or {100 + percent} * (least(x.n_shingles, y.n_shingles - y.ones + x.ones) - ({alone})) >= {percent} * (x.n_shingles + y.n_shingles))"


def _verifier(size: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = H.table(1, fold_case=True)

        def sets(column: pa.Array) -> list[np.ndarray]:
            return [s for _, _, data, offsets in text_chunks(column) for s in H.shingle_sets(data, offsets, values, size)]

        for batch in batches:
            linked = []
            for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return verify


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Documents are linked if their sets of `size`-word shingles (words: runs without ASCII white space, A-Z lower-cased;
    all words as one shingle if there are fewer) share `percent` of the union or more, checked on the full sets.
    Candidates share one of `bands` bands of `rows` bins; two documents at similarity 0.8 miss each other with a chance of 3e-6.

    Equal sets become one node first. Each bucket then gives a star of edges from its smallest node, not all its pairs. Where
    members of a bucket remain in different components, stars from other members follow, and at last the pairs between
    different components alone, until no untested pair could join two components: components are those of all links. That last join
    compares bitmaps of the sets, and gives out only pairs that these do not rule out; none that is linked is ever ruled out.

    Null or empty text: an empty set, linked with nothing. Null ids: returned with null component and kept false.
    Rows that share an id count as one node. Empty table: no rows. Other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col)
    signed = staged(mapped(base, _signer(size, bands, rows), _SIGNED), "signed")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    keyed = staged(nodes.select("node", "n_shingles", F.explode("bands").alias("bucket")), "buckets")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(keyed.join(shared.select("bucket").hint("merge"), "bucket"), "members")
    texts = staged(base.join(members.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")

    def with_bits(rows: DataFrame) -> DataFrame:
        # Rows of one id with equally large sets have no bitmap of their own, and pass the filter.
        once = F.count("*") == 1
        known = mapped(texts, _bitmapper(size), "node long, n_shingles long, ones long, bits array<long>").groupBy("node", "n_shingles").agg(*(F.when(once, F.first(c)).alias(c) for c in ("ones", "bits")))
        plain = [F.coalesce("ones", F.lit(-1)).alias("ones"), *(F.coalesce(F.col("bits")[i], F.lit(0)).alias(f"b{i}") for i in range(BITMAP_LONGS))]
        return rows.join(known.hint("merge"), ["node", "n_shingles"], "left").select("bucket", "node", "n_shingles", "component", *plain)

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        wide = near.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
        return mapped(wide, _verifier(size, percent), "a long, b long")

    exact = _same_set_links(signed)
    links, tested, labels = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        rows_now = members if labels is None else members.join(labels.hint("merge"), members.node == labels.node, "left").select(members["*"], F.coalesce("component", members.node).alias("component"))
        if labels is None:
            rows_now = rows_now.withColumn("component", F.col("node"))
        split = rows_now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high").select("bucket", "m")
        open_rows = staged(rows_now.join(split.hint("merge"), "bucket"), "open")
        n, worst = open_rows.agg(F.count("*"), F.sum(F.col("m") - 1)).first()
        if not n:
            break
        last = turn == STAR_ROUNDS or (turn > 0 and worst <= 2 * PAIRS_A_ROW * n)
        if last:
            known = with_bits(open_rows)
            near = f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles) and {_possible(percent)}"
            pairs = known.alias("x").join(known.hint("merge").alias("y"), F.expr(f"x.bucket = y.bucket and x.component <> y.component and x.node < y.node and {near}"))
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n_shingles").alias("n_a"), F.col("y.n_shingles").alias("n_b"))
        else:
            order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            centre = open_rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "n_shingles", "component")).alias("c"))
            pairs = open_rows.join(centre.hint("merge"), "bucket").where("component <> c.component").select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n_shingles").alias("n_a"), F.col("n_shingles").alias("n_b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        found = staged(confirmed(pairs), "links")
        links = found if links is None else links.union(found)
        # One star round's labels are not yet components: the last turn contracts all links, also where it found none itself.
        labels = staged(connected_components(links, None if last else 1), "labels")
        if last:
            break
    if labels is None:
        labels = members.sparkSession.createDataFrame([], "node long, component long")
    out = exact.join(labels.hint("merge"), exact.node == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", exact.node, "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _same_set_links(signed: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node): every row with the smallest id of its equal sets; empty sets and null ids with their own."""
    full = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "s1", "s2")
    copies = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").select("s1", "s2", "n_shingles", "node")
    known = full.join(copies.hint("merge"), ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"))
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    return known.union(rest)
