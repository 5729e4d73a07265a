"""Operator 5: removal of bytes under 200-byte strings that occur more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm import _hashing as H
from rolefit.llm._work import id_and_text, staged, text_chunks

#: Bytes of an anchor. A span's anchor is the run of so many bytes with the least hash inside it, the first of equals.
ANCHOR = 32
#: Bytes looked at in one go (positions take 24 of a packed number's bits); windows held at a time when blocks are compared.
_SLICE, _WINDOWS = 1 << 23, 1 << 22
#: Blocks that may share an anchor before its windows are dealt over SLICES tasks by their distance from the anchor.
HOT, SLICES = 20_000, 8
_VALUES = H.table(4)


def _blocks(data: np.ndarray, bounds: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `span` bytes with one anchor: (row, first window in the row, windows, anchor hash, hash of the block's bytes, anchor's distance from the first window)."""
    n, wide = len(data), span - ANCHOR + 1
    p, back = H.prefix_hash(data, _VALUES), H.unshift(n + 1)
    grams = H.mix((p[ANCHOR:] - p[:-ANCHOR]) * back[: n - ANCHOR + 1])
    packed = np.full(-(-(len(grams) + wide) // wide) * wide, np.iinfo(np.uint64).max, H.U)
    packed[: len(grams)] = (grams & H.U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=H.U)
    rows = packed.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - span + 1
    least = (np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count]) & H.U(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.maximum(0, np.diff(bounds) - 1 - span + 1))
    first_of = np.cumsum(np.maximum(0, np.diff(bounds) - span)) - np.maximum(0, np.diff(bounds) - span)
    start = np.arange(len(row)) - first_of[row] + bounds[:-1][row]
    if not len(start):
        return tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, H.U, H.U, np.int64))
    least = least[start]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    windows = np.diff(np.append(new, len(row)))
    s, anchor = start[new], least[new]
    e = s + windows - 1 + span
    return row[new], s - bounds[:-1][row[new]], windows, grams[anchor], H.mix((p[e] - p[s]) * back[s] + windows.astype(H.U)), anchor - s


def _row_blocks(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """`_blocks` of a run of rows; a row that is too long for one go is cut into overlapping slices."""
    if len(data) < span:
        return _blocks(np.zeros(span, np.uint8), np.array([0, 1]), span)
    if len(data) <= _SLICE:
        return _blocks(data, offsets, span)
    found = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)):
        for s in range(a, max(a + 1, b - span + 1), _SLICE // 2):
            e = min(b, s + _SLICE // 2 + span - 1)
            if e - s >= span:
                own = _blocks(data[s:e], np.array([0, e - s + 1]), span)
                found.append((own[0] + k, own[1] + (s - a), *own[2:]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else _blocks(np.zeros(span, np.uint8), np.array([0, 1]), span)


def _anchored(span: int):
    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for first, _, data, offsets in text_chunks(batch.column("text")):
                row, start, windows, anchor, block, away = _row_blocks(data, offsets, span)
                yield pa.RecordBatch.from_arrays([pa.array(uid[first + row]), pa.array((start * 256 + away) * 256 + windows), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64))], names=["uid", "place", "anchor", "block"])

    return anchored


def _bytes_of(span: int):
    """The bytes of the blocks asked for, one row for each slice of their windows."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for uid, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "wanted")), strict=True):
                data = text.encode()
                for w in wanted:
                    start, first_away, windows, anchor, parts = w["place"] // 65536, w["place"] // 256 % 256, w["place"] % 256, w["anchor"], w["parts"]
                    # Equal windows lie equally far from their anchor, so slices of that distance never part them.
                    for part in range(parts):
                        away = np.arange(first_away, first_away - windows, -1)
                        mine = np.flatnonzero((away * parts) // span == part)
                        if len(mine):
                            s, n = start + int(mine[0]), len(mine)
                            out.append((anchor, part, uid, s, n, int(away[mine[0]]), data[s : s + n - 1 + span]))
                            size += n - 1 + span
                if size > 4 << 20:
                    yield _wide(out)
                    out, size = [], 0
            if out:
                yield _wide(out)

    return bytes_of


_WIDE = "anchor long, part int, uid long, start long, windows int, away int, bytes binary"


def _wide(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _WIDE.split(", ")])


def _compare(span: int):
    """Spans of windows that occur twice or more among the blocks with their anchor. All blocks of an anchor and part are in this task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        anchor, windows, away, uid, start = (table.column(c).to_numpy() for c in ("anchor", "windows", "away", "uid", "start"))
        texts = table.column("bytes").combine_chunks()
        buckets = max(1, -(-int(windows.sum()) // _WINDOWS))
        bucket = (H.mix(anchor.view(H.U)) % H.U(buckets)).astype(np.int64)
        for b in range(buckets):
            own = np.flatnonzero(bucket == b)
            if not len(own):
                continue
            # A bucket that one anchor fills is gone through by ranges of the distance from the anchor.
            steps = max(1, -(-int(windows[own].sum()) // (4 * _WINDOWS)))
            for low in range(0, span, -(-span // steps)):
                yield from _repeated(anchor[own], windows[own], away[own], uid[own], start[own], texts.take(pa.array(own)), span, low, low + -(-span // steps))

    return compare


def _repeated(anchor, windows, away, uid, start, texts, span, low, high) -> Iterator[pa.RecordBatch]:
    first = np.maximum(0, away - (high - 1))
    end = np.minimum(windows, away - low + 1)
    keys, where = [], []
    begin = 0
    for _, stop, data, offsets in text_chunks(texts, 1 << 22):
        p, back = H.prefix_hash(data, _VALUES), H.unshift(len(data) + 1)
        rows = np.arange(begin, stop)
        n = np.maximum(0, end[rows] - first[rows])
        which = np.repeat(rows, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
        at = offsets[which - begin] + k
        keys.append(H.mix(H.mix((p[at + span] - p[at]) * back[at]) + H.mix(anchor.view(H.U)[which]) * H.U(3) + (away[which] - k).astype(H.U)))
        where.append(which * 256 + k)
        begin = stop
    keys, where = np.concatenate(keys), np.concatenate(where)
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.sort(where[twice])
    if len(hit):
        head = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
        run, s = np.diff(np.append(head, len(hit))), hit[head]
        at = start[s // 256] + s % 256
        yield pa.RecordBatch.from_arrays([pa.array(uid[s // 256]), pa.array(at), pa.array(at + run - 1 + span)], names=["uid", "start", "end"])


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            data, kept, at, removed, runs = text.encode(), [], 0, 0, 0
            for s, e in merged(spans or []):
                kept.append(data[at:s])
                removed, runs, at = removed + e - s, runs + 1, e
            kept.append(data[at:])
            rows.append((doc, len(data), removed, runs, b"".join(kept)))
        doc, n, removed, runs, rest = zip(*rows, strict=True) if rows else [[]] * 5
        longs = [pa.array(x, pa.int64()) for x in (doc, n, removed, runs)]
        yield pa.RecordBatch.from_arrays([*longs, pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch become one."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, span: int = 200) -> DataFrame:
    """(uid, start, end) of bytes under `span`-byte strings that start more than once in `docs` (uid, text); spans may overlap or repeat.

    All windows of `span` bytes that have one anchor form a block. Equal windows have equal anchors at equal distances, so windows meet where their
    anchors do. Where all blocks of an anchor are equal, all their windows repeat. Else the blocks' bytes are brought together by anchor
    and their windows compared; an anchor of very many blocks is dealt over tasks by the windows' distance from it, which parts no equal windows.
    Blocks are counted by anchor before they are shuffled, and the join of the counts can split a frequent anchor's rows.
    """
    blocks = staged(docs.mapInArrow(_anchored(span), "uid long, place long, anchor long, block long"), "blocks")
    shared = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).where("n > 1")
    met = staged(blocks.join(shared.hint("shuffle_hash"), "anchor").select("uid", "place", "anchor", F.when(F.col("low") == F.col("high"), 0).when(F.col("n") > HOT, SLICES).otherwise(1).alias("parts")), "shared-blocks")
    start = F.shiftrightunsigned("place", 16)
    whole = met.where("parts = 0").select("uid", start.alias("start"), (start + F.col("place") % 256 - 1 + span).alias("end"))
    wanted = met.where("parts > 0").groupBy("uid").agg(F.collect_list(F.struct("place", "anchor", "parts")).alias("wanted"))
    wide = docs.join(wanted.hint("merge"), "uid").select("uid", "text", "wanted").mapInArrow(_bytes_of(span), _WIDE)
    part = wide.repartition("anchor", "part").mapInArrow(_compare(span), "uid long, start long, end long")
    return whole.union(part)


def without_repeated_spans(docs: DataFrame, span: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs`; kept: the bytes that stay.

    Texts are whole, as UTF-8 (null: empty); strings never cross rows and are judged on the input. Rows with equal id and text repeat each other in full.
    Null ids keep their rows; an empty table gives no rows.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = staged(repeated_spans(base.select("uid", "text"), span), "spans").groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = base.join(spans.hint("merge"), "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
