"""Operator 12: alignment of two tokenizers over a corpus: token groups that end at the same byte, and how many documents link a pair of ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm._work import id_and_text, mapped, staged

#: Bytes that a worker's cache of aligned chunks may take, by estimate; a full cache starts anew. Any size gives the same result.
CACHE_BYTES = 96 << 20
#: Pairs of ids, the most frequent ones, whose counts are broadcast; all others meet their counts in a merge join.
BROADCAST_PAIRS = 1 << 20
#: Texts are cut before a space that follows anything but white space, unless the space is the text's last character. No token of either tokenizer
#: crosses such a place. Characters that only some versions of Unicode call white space count as it: fewer cuts are as right.
_NO_CUT = "\\s\u180e\u200b\ufeff"
_CUT, _OPEN_END = re.compile(f"(?<=[^{_NO_CUT}])(?= (?!\\Z))"), re.compile(f"[{_NO_CUT}]\\Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Aligned(NamedTuple):
    """What texts give, a row for each: tokens of A and B, groups, links, the groups as text, and the bounds of their distinct pairs of ids in `a`, `b` and `times`."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    bounds: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times: np.ndarray


class _Numbers(dict):
    """Numbers chunks in the order in which they are first asked for; the new ones are in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 for every i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Aligns the ids of a byte-level BPE (a `tokenizers` file, A) and of a piece BPE that adds a space (a `sentencepiece` model, B).

    A text is cut where both tokenizers always part it, so a chunk that was met before costs one lookup. New chunks are joined, and encoded and
    aligned together; arrays hold what each chunk gives, and a text's figures are sums and runs of its chunks'.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True
        letters = _byte_letters()
        special = {i: t.content.encode() for i, t in self._a.get_added_tokens_decoder().items()}
        vocabulary = {i: bytes(letters[c] for c in x) for x, i in self._a.get_vocab().items() if i not in special} | special
        self._bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        pieces = [self._b.id_to_piece(i) for i in range(len(self._b))]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("a piece holds a space after another character: texts can't be cut before spaces")
        self._bytes_b = [bytes([int(m[1], 16)]) if self._b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._sizes_a, self._sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self._bytes_a, self._bytes_b))
        self._bits_b = len(self._bytes_b).bit_length()
        self._bits = self._bits_b + len(self._bytes_a).bit_length()
        plain = [str(i).encode() for i in range(max(len(self._bytes_a), len(self._bytes_b)))]
        self._said = {end: np.array([x + end for x in plain], object) for end in (b",", b"|", b";")}
        self.clear()

    def clear(self) -> None:
        self._numbers, self._held, self._groups = _Numbers(), 0, []
        self._bad, self._figures, self._links = np.empty(0, bool), np.empty((4, 0), np.int64), np.empty(0, np.int64)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with a space; B is given what follows it, and adds it."""
        return np.array(self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self._b.encode(text[1:]), np.int64)

    def _aligned(self, chunks: list[str]) -> Iterator[tuple[bool, np.ndarray, list[bytes], np.ndarray]]:
        """(not told by its ids, (tokens of A, of B, groups, links), groups as texts, links as pairs of ids) for runs of `chunks`, in order."""
        joined = "".join(chunks)
        whole, (a, b) = joined.encode(), self._ids(joined)
        ends = np.cumsum(np.fromiter((len(c) for c in chunks) if len(whole) == len(joined) else (len(c.encode()) for c in chunks), np.int64, len(chunks)))
        ends_a, ends_b = np.cumsum(self._sizes_a[a]), np.cumsum(self._sizes_b[b])
        told = b"".join([self._bytes_a[i] for i in a.tolist()]) == whole == b"".join([self._bytes_b[i] for i in b.tolist()])
        if not told or not all((e[np.searchsorted(e, ends)] == ends).all() for e in (ends_a, ends_b)):
            if len(chunks) == 1:
                yield True, np.zeros((4, 1), np.int64), [b""], np.empty(0, np.int64)
            else:
                yield from self._aligned(chunks[: len(chunks) // 2])
                yield from self._aligned(chunks[len(chunks) // 2 :])
            return
        last_a, last_b = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y for x, y in ((ends_b, ends_a), (ends_a, ends_b)))
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(of_a), np.bincount(of_b)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        chunk = np.searchsorted(ends, ends_a[last_a])  # of each group
        per_chunk = [np.bincount(chunk, x, len(chunks)).astype(np.int64) for x in (size_a, size_b, np.ones(len(chunk)), size_a * size_b)]
        links = np.repeat(a, size_b[of_a]) << self._bits_b | b[_runs(first_b[of_a], size_b[of_a])]
        said = np.empty(len(a) + len(b), object)  # the groups' tokens in order, each with the mark that follows it
        said[np.arange(len(a)) + first_b[of_a]] = np.where(last_a, self._said[b"|"][a], self._said[b","][a])
        said[np.arange(len(b)) + (first_a + size_a)[of_b]] = np.where(last_b, self._said[b";"][b], self._said[b","][b])
        said, bounds = said.tolist(), np.cumsum([0, *(per_chunk[0] + per_chunk[1])]).tolist()
        yield False, np.array(per_chunk), [b"".join(said[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], links

    def _learn(self, chunks: list[str]) -> None:
        """Adds what new chunks give, in their order. A chunk that ends with white space is encoded alone, the others joined."""
        first, found = 0, []
        while first < len(chunks):
            end = first + 1
            if not _OPEN_END.search(chunks[first], len(chunks[first]) - 1):
                while end < len(chunks) and not _OPEN_END.search(chunks[end], len(chunks[end]) - 1):
                    end += 1
            found += self._aligned(chunks[first:end])
            first = end
        self._bad = np.concatenate([self._bad, *(np.full(len(texts), bad) for bad, _, texts, _ in found)])
        self._figures = np.concatenate([self._figures, *(x for _, x, _, _ in found)], axis=1)
        self._links = np.concatenate([self._links, *(x for _, _, _, x in found)])
        self._groups += [t for _, _, texts, _ in found for t in texts]
        self._held = 8 * len(self._links) + 300 * len(self._groups) + sum(map(len, self._numbers)) + sum(map(len, self._groups))

    def _numbered(self, chunks: Iterator[str], n: int) -> np.ndarray:
        at = np.fromiter(map(self._numbers.__getitem__, chunks), np.int64, n)
        if self._numbers.new:
            self._learn(self._numbers.new)
            self._numbers.new = []
        return at

    def align(self, texts: list[str]) -> Aligned:
        """The alignment of a space and each text, none of which is empty; no tokens where the bytes of A or B are not those."""
        if self._held > CACHE_BYTES:
            self.clear()
        cut = [_CUT.split(" " + t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = self._numbered(chain.from_iterable(cut), int(sizes.sum()))
        ends = np.cumsum(sizes)
        odd = np.add.reduceat(self._bad[at], ends - sizes, dtype=np.int64) > 0
        if odd.any():  # those texts at once
            again = self._numbered((" " + texts[k] for k in np.flatnonzero(odd).tolist()), int(odd.sum()))
            keep = np.repeat(~odd, sizes)
            sizes = np.where(odd, 1, sizes)
            mixed = np.empty(int(sizes.sum()), np.int64)
            alone = np.repeat(odd, sizes)
            mixed[alone], mixed[~alone] = again, at[keep]
            at, ends = mixed, np.cumsum(sizes)
        first = ends - sizes
        n_a, n_b, n_groups, n_links = np.add.reduceat(self._figures[:, at], first, axis=1)
        own, starts = self._figures[3][at], np.cumsum(self._figures[3]) - self._figures[3]
        rows = np.repeat(np.arange(len(texts)), n_links) << self._bits | self._links[_runs(starts[at], own)]
        rows.sort()
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        times, pairs = np.diff(new, append=len(rows)), rows[new]
        bounds = np.searchsorted(pairs >> self._bits, np.arange(len(texts) + 1))
        groups, numbers = self._groups, at.tolist()
        said = [b"".join([groups[k] for k in numbers[x:y]])[:-1] for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
        pairs &= (1 << self._bits) - 1
        return Aligned(n_a, n_b, n_groups, n_links, said, bounds, pairs >> self._bits_b, pairs & ((1 << self._bits_b) - 1), times)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of tokenizer files and Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_TEXTS = "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def align_texts(texts: DataFrame, path_a: str, path_b: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Every row of `texts` (digest, copies, text; texts that aren't empty) with the figures of its alignment, and its distinct pairs of ids with their links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column("text").to_pylist(), 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size + len(texts[end]) <= chunk_bytes):
                    size += len(texts[end])
                    end += 1
                own = aligner(path_a, path_b).align(texts[first:end])
                lists = [pa.ListArray.from_arrays(pa.array(own.bounds, pa.int32()), pa.array(c, pa.int32())) for c in (own.a, own.b, own.times)]
                figures = [pa.array(c, pa.int64()) for c in (own.n_a, own.n_b, own.n_groups, own.n_links)]
                shas = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in own.groups])
                kept = [batch.column(c).slice(first, end - first) for c in ("digest", "copies")]
                yield pa.RecordBatch.from_arrays([*kept, *figures, shas, *lists], names=[x.split()[0] for x in _TEXTS.split(", ")])
                first = end

    return mapped(texts.select("digest", "copies", "text"), work, _TEXTS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents link a pair of ids, each distinct text counted with its copies; `best`: no pair of the same a is in more."""
    pairs = aligned.select("copies", F.explode(F.arrays_zip("a", "b")).alias("pair"))
    counts = staged(pairs.groupBy("pair.a", "pair.b").agg(F.sum("copies").alias("documents")), "pairs")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # a row for each id of A: bounded by its vocabulary
    return staged(counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "counts")


def _measured(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(digest, n_best, count_sum). The most frequent pairs, `BROADCAST_PAIRS` at most, are broadcast, so that no frequent pair is a key of a shuffle."""
    by_size = counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("size")).count().collect()  # 63 rows at most
    least, kept = 64, 0
    for size, n in sorted(((r["size"], r["count"]) for r in by_size), reverse=True):
        if kept + n > BROADCAST_PAIRS:
            break
        least, kept = size, kept + n
    frequent = F.floor(F.log2("documents")).cast("int") >= least
    pairs = aligned.select("digest", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("digest", "p.*")
    figures = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    found = pairs.join(F.broadcast(counts.where(frequent)), ["a", "b"]).groupBy("digest").agg(*figures)
    if kept < sum(r["count"] for r in by_size):
        rare = counts.where(~frequent)
        tail = pairs.join(rare.hint("merge"), ["a", "b"]).groupBy("digest").agg(*figures)
        found = found.union(tail).groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of its text.

    Texts are grouped by themselves, so that each distinct one is encoded and aligned once, whatever its copies, which count in the pairs' documents;
    its figures then find the documents by the text's SHA-256, a join whose crowded keys Spark parts. Null and empty texts, and those that a
    tokenizer doesn't give back, have zeros and an empty digest; very long texts are taken whole; null ids and repeated rows have a row each, and
    every row counts as a document; an empty table gives no rows; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    aligned = staged(align_texts(distinct, path_a, path_b), "aligned")
    figures = aligned.select("digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    measures = staged(figures.join(_measured(aligned, pair_counts(aligned)).hint("merge"), "digest", "left"), "measures")
    keyed = rows.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("digest"))
    joined = keyed.join(measures.hint("merge"), "digest", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
