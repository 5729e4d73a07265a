"""Operator 7: token ids in files of independent zstandard frames with a trailing seek table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm._work import id_and_text, mapped, new_folder, staged
from rolefit.llm.tokens import encoded_rows

#: Fixed values of the file format. File: frames, seek table, footer. A frame: one zstandard frame of the little-endian uint32 ids of
#: a run of documents. The seek table: the documents' (doc_id, has_id, ids) and the frames' (compressed bytes, ids, documents, crc32 of the
#: compressed bytes), as one zstandard frame. Footer: table bytes, table crc32, documents, frames, version, magic.
MAGIC, VERSION = b"RFTOKS\x00\x01", 1
_FOOTER = struct.Struct("<QIQQI8s")
_DOC, _FRAME = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("ids", "<u4")]), np.dtype([("bytes", "<u8"), ("ids", "<u8"), ("docs", "<u4"), ("crc32", "<u4")])


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Writes documents in order; a frame closes once it holds `frame_ids` ids, always at a document's end."""

    def __init__(self, sink, frame_ids: int = 1 << 16) -> None:
        self._sink, self._most, self._pack = sink, frame_ids, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._docs, self._frames, self._open, self._held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self._open.append(ids)
        self._held += len(ids)
        if self._held >= self._most:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            data = self._pack.compress(np.concatenate(self._open).astype("<u4").tobytes())
            self._sink.write(data)
            self._frames.append((len(data), self._held, len(self._open), zlib.crc32(data)))
            self._open, self._held = [], 0

    def close(self) -> None:
        self._close_frame()
        table = self._pack.compress(np.array(self._docs, _DOC).tobytes() + np.array(self._frames, _FRAME).tobytes())
        self._sink.write(table + _FOOTER.pack(len(table), zlib.crc32(table), len(self._docs), len(self._frames), VERSION, MAGIC))


class TokenFileReader:
    """Reads the seek table once, then only the frames of the documents asked for; every frame is checked before use."""

    def __init__(self, source) -> None:
        self._source, self._unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - _FOOTER.size)
        size, check, docs, frames, version, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        source.seek(end - _FOOTER.size - size)
        table = source.read(size)
        if zlib.crc32(table) != check:
            raise ValueError("the seek table is damaged")
        raw = self._unpack.decompress(table)
        self.docs = np.frombuffer(raw, _DOC, docs)
        self.frames = np.frombuffer(raw, _FRAME, frames, docs * _DOC.itemsize)
        self._at = np.concatenate([[0], np.cumsum(self.frames["bytes"].astype(np.int64))])
        self._first = np.concatenate([[0], np.cumsum(self.frames["docs"].astype(np.int64))])

    def frame(self, k: int) -> np.ndarray:
        self._source.seek(int(self._at[k]))
        data = self._source.read(int(self.frames["bytes"][k]))
        if zlib.crc32(data) != self.frames["crc32"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(self._unpack.decompress(data), "<u4")

    def read(self, first: int, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents first .. end-1 of the file, decompressing their frames only."""
        k = int(np.searchsorted(self._first, first, "right")) - 1
        while first < end:
            ids, doc = self.frame(k), int(self._first[k])
            bounds = np.concatenate([[0], np.cumsum(self.docs["ids"][doc : int(self._first[k + 1])].astype(np.int64))])
            for d in range(first, min(end, int(self._first[k + 1]))):
                row = self.docs[d]
                yield (int(row["doc_id"]) if row["has_id"] else None), ids[bounds[d - doc] : bounds[d - doc + 1]]
            first, k = max(first, int(self._first[k + 1])), k + 1


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 16) -> DataFrame:
    """Writes `docs` in ascending doc_id order (null ids first) to files in `folder`, and returns their list: (part, path, docs, ids).

    One file for each range partition, named by it, so the names' order is the documents' order. A file is written under a task's own name and then
    moved: a task that runs again, or twice at once, leaves one whole file with the same content. Repeated ids keep their rows,
    ordered by text. The folder may be in any store that pyarrow opens by its URI. An empty table gives files without documents or none.
    """
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        path, own = f"{root}/part-{task.partitionId():06d}.tok", f"{root}/_writing-{task.partitionId()}-{task.taskAttemptId()}"
        n = total = 0
        with store.open_output_stream(own) as sink:
            out = TokenFileWriter(sink, frame_ids)
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded_rows(batch.column("text"), tokenizer, end_id), strict=True):
                    out.add(doc, ids)
                    n, total = n + 1, total + len(ids)
            out.close()
        store.move(own, path)
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": [n], "ids": [total]})

    return staged(mapped(ordered, write, "part int, path string, docs long, ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str, docs_a_task: int = 20_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document of the files in list `files`; start: ids of all documents before it.

    A file with many documents is read by several tasks, each from its own first frame on.
    """
    spark = files.sparkSession
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.withColumn("base", before).select("path", "base", F.explode(F.expr(f"sequence(0L, greatest(docs - 1, 0L), {docs_a_task}L)")).alias("first"), "docs").where("first < docs")
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for run in batch.to_pylist():
                with store.open_input_file(run["path"]) as source:
                    file = TokenFileReader(source)
                    first, end = run["first"], min(run["first"] + docs_a_task, run["docs"])
                    at = run["base"] + int(file.docs["ids"][:first].sum(dtype=np.int64))
                    rows = []
                    for doc, ids in file.read(first, end):
                        rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(runs, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes `docs` to token files in the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
