"""Operator 10: WARC archives of pages, and a salvage reader."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm._work import mapped, new_folder, staged
from rolefit.llm.token_files import open_store

#: Fixed values of the archive format.
VERSION, MEMBER, VERSION_LINE = b"WARC/1.1\r\n", b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    start: int
    end: int


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as one gzip member; a revisit keeps the payload's length and digest, not its bytes."""
    digest = hashlib.sha256(payload).hexdigest()
    body = payload if refers_to is None else b""
    name = f"urn:page:{'' if page_id is None else page_id}"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", _DATE)]
    if url:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    return gzip.compress(head + body + b"\r\n\r\n", 1, mtime=0)


def _parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at `start`; ValueError if any check fails."""
    if not VERSION_LINE.match(data, start):
        raise ValueError("no version line")
    cut = data.find(b"\r\n\r\n", start)
    if cut < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[start:cut].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("a header line has no colon")
        headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = cut + 4 + int(headers["content-length"])
    payload = data[cut + 4 : end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where its length says")
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest and digest != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("the payload has another digest")
    return headers, payload, end + 4


#: Compressed bytes that are inflated in one go.
_PIECE = 1 << 16


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(what the gzip member at `at` inflates to, its end, None), or (what could be inflated before an error, the end of what was read, the error)."""
    unpack, out, p = zlib.decompressobj(31), [], at
    while not unpack.eof:
        if p >= len(data):
            return b"".join(out), p, "the member is cut off"
        piece = data[p : p + _PIECE]
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            # The same again up to the piece, then byte by byte: what comes before the error is kept.
            again = zlib.decompressobj(31)
            again.decompress(data[at:p])
            for k in range(len(piece)):
                try:
                    out.append(again.decompress(piece[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), p, str(e)
        p += len(piece)
    return b"".join(out), p - len(unpack.unused_data), None


def _verified(headers: dict[str, str]) -> bool:
    """A record whose payload was held against a digest: the only kind taken from a member that itself failed its check."""
    return headers.get("warc-type") == "response" and bool(headers.get("warc-payload-digest"))


def _records_of(raw: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """All valid records of inflated bytes, and the first error; after an error reading goes on at the next version line that starts a valid record."""
    records, at, error = [], 0, None
    while at < len(raw):
        try:
            headers, payload, at = _parse(raw, at)
            records.append((headers, payload))
        except ValueError as e:
            error = error or str(e)
            found = VERSION_LINE.search(raw, at + 1)
            at = found.start() if found else len(raw)
    return records, error


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive in order, compressed or plain. Where a check fails, the bytes up to the next member or version line that
    starts a valid record become a Gap, and reading goes on there.

    A member that inflates but holds a bad record is searched inside: its other records come out, and its bytes are a Gap too. Of a member that
    does not inflate to its end, the records before the error come out if their payloads have the digests they name. Members are inflated
    in pieces of 64 KB, so many small ones take time in proportion to their bytes.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        records, end, error, whole = [], len(data), None, True
        if data.startswith(MEMBER, at):
            raw, end, error = _inflated(data, at)
            whole = error is None
            records, inner = _records_of(raw)
            if not whole:
                records = [r for r in records if _verified(r[0])]
            error = error or inner
        else:
            try:
                headers, payload, end = _parse(data, at)
                records = [(headers, payload)]
            except ValueError as e:
                error, whole = str(e), False
        if bad is not None and (error is None or records):
            yield Gap(bad, at, reason)
            bad = None
        for headers, payload in records:
            yield Record(headers, payload, at, end)
        if error is None:
            at = end
        elif whole:
            yield Gap(at, end, error)
            at = end
        else:
            if bad is None:
                bad, reason = at, error
            found = _CANDIDATE.search(data, at + 1)
            at = found.start() if found else len(data)
    if bad is not None:
        yield Gap(bad, len(data), reason)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, file_bytes: int = 32 << 20, broadcast_rows: int = 50_000) -> DataFrame:
    """Writes a record for every row of `pages` (page_id, url, html) to archives in `folder`; returns their list (part, path, records).

    Of equal payloads of `min_bytes` or more the smallest page_id is the response and the others revisit it; rows that share that id are all
    responses, and so are payloads that only null ids have. Null html is empty, null urls have no header. First digests are matched, then
    each page meets its digest's first page: by broadcast if the list of repeated digests has `broadcast_rows` rows at most, else by a merge join.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    repeated = keyed.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(repeated.where("n > 1 and first is not null").select("digest", "first"), "digests")
    ways = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated.hint("merge")
    rows = keyed.join(ways, "digest", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done, held, size, n = [], [], 0, 0

        def close() -> None:
            nonlocal held, size, n
            name = f"{task.partitionId():06d}-{len(done):04d}"
            own, path = f"{root}/_writing-{name}-{task.taskAttemptId()}", f"{root}/pages-{name}.warc.gz"
            with store.open_output_stream(own) as sink:
                for x in held:
                    sink.write(x)
            store.move(own, path)
            done.append((path, n))
            held, size, n = [], 0, 0

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(encode_record(page, url, html.encode(), first))
                size, n = size + len(held[-1]), n + 1
                if size >= file_bytes:
                    close()
        if n:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()] * len(done), pa.int32()), "path": [p for p, _ in done], "records": [k for _, k in done]})

    return staged(mapped(rows, write, "part int, path string, records long"), "archives")


_READ = "path string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in list `files` (path), and a row for every quarantined gap of bytes (gap_start, gap_end, gap_reason).

    Length and digest are taken from the payload where a response has it, and from the headers of a revisit.
    """
    spread = files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as source:
                    data = source.read()
                rows = []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        rows.append((path, None, None, None, None, None, None, x.start, x.end, x.reason))
                        continue
                    kind, h = x.headers.get("warc-type"), x.headers
                    page, first = (re.search(r"urn:page:(-?\d+)", h.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                    size, digest = (len(x.payload), hashlib.sha256(x.payload).hexdigest()) if kind == "response" else (int(h.get("x-payload-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha256:"))
                    rows.append((path, page and int(page[1]), size, digest, kind, first and int(first[1]), x.payload if payloads and kind == "response" else None, None, None, None))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _READ.split(", ")])

    return mapped(spread, read, _READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), written to archives in the shared folder and read back.

    A gap in what was just written is an error. Other columns of `pages` are left out, whatever their names; an empty table gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = read_archives(write_archives(pages, folder), folder, payloads=False)
    damaged = F.raise_error(F.concat_ws(" ", F.lit("damaged archive"), "path", F.lit("from byte"), F.col("gap_start").cast("string"), "gap_reason")).cast("boolean")
    return rows.where(F.when(F.col("gap_start").isNull(), True).otherwise(damaged)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
