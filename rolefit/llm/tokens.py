"""Token ids of whole texts with a public tokenizer, through a cache of white-space-delimited words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes that a worker's cache of words may take, by estimate; a full cache keeps the words met again since it was last full. Any size gives the same ids.
CACHE_BYTES = 64 << 20
#: What a cached word takes beside its own bytes and its ids: dictionary entry, objects and three numbers.
_ENTRY_BYTES = 200

#: The tokenizer's pattern for runs, its letters and digits narrowed to those of `_PLAIN`, and the newlines that part words here.
_PLAIN = re.compile(r"[a-zß-öø-ÿÀ-ÖØ-Þ0-9!-/:-@\[-`{-~]+")
_RUN = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+")


def _byte_letters() -> np.ndarray:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on. White space stays."""
    letters, printable = np.arange(256, dtype="<u4"), np.zeros(256, bool)
    printable[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
    letters[~printable] = 256 + np.arange((~printable).sum())
    letters[list(b" \n")] = list(b" \n")
    return letters


_LETTERS = _byte_letters()


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for, and keeps the new ones in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes bytes of text to ids, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    For tokenizers that lower-case, drop white space, never join text across it and end every run with a word-end piece (word_bpe_49k.json is one):
    then a text's ids are those of its words in order, and a word that is known already costs one lookup. New words of plain letters, digits
    and punctuation are parted into runs here and go to the tokenizer's model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer, self._runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._runs.normalizer, self._runs.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self._tokenizer.get_vocab()
        self._ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_run[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self._special = [t.content.lower().encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self._numbers, self._held = _Numbers(), 0
        self._starts, self._sizes, self._hits, self._pool = (np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint32))

    def _shrink(self) -> None:
        """Keeps the words met again since the cache was last full, unless these fill half of it."""
        again = self._hits > 1
        words = [w for w, keep in zip(self._numbers, again.tolist(), strict=True) if keep]
        sizes, starts, pool = self._sizes[again], self._starts[again], self._pool
        self.clear()
        held = self._cost(words, int(sizes.sum()))
        if held < CACHE_BYTES / 2:
            self._numbers.update(zip(words, range(len(words)), strict=True))
            ends = np.cumsum(sizes)
            self._add(pool[np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())], sizes)
            self._held = held

    def _cost(self, words: list[bytes], ids: int) -> int:
        return sum(map(len, words)) + 4 * ids + _ENTRY_BYTES * len(words)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self._pool) + np.cumsum(sizes) - sizes
        self._starts, self._sizes = np.concatenate([self._starts, starts]), np.concatenate([self._sizes, sizes])
        self._hits = np.concatenate([self._hits, np.zeros(len(sizes), np.int64)])
        self._pool = np.concatenate([self._pool, ids.astype(np.uint32)])

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words of `_PLAIN` characters."""
        runs = _RUN.findall("\n".join([*texts, ""]).lower())
        joined = " ".join(runs)
        if not joined.isascii():
            joined = _LETTERS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self._runs.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        run_ends = np.flatnonzero(self._ends_run[ids]) + 1
        word_ends = np.flatnonzero(np.fromiter((r == "\n" for r in runs), bool, len(runs))) - np.arange(len(texts))
        if len(run_ends) != len(runs) - len(texts):
            raise ValueError("the tokenizer does not end every run with a word-end piece")
        ends = np.concatenate([[0], run_ends])[word_ends]
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: list[bytes]) -> None:
        """Adds new words to the cache, in their order."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter((_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts), bool, len(texts))
        ids, sizes = self._plain_ids([t for t, p in zip(texts, plain.tolist(), strict=True) if p]) if plain.any() else (np.empty(0, np.int64), np.empty(0, np.int64))
        if not plain.all():
            others = [e.ids for e in self._tokenizer.encode_batch_fast([t for t, p in zip(texts, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
            all_sizes = np.empty(len(texts), np.int64)
            all_sizes[plain], all_sizes[~plain] = sizes, [len(x) for x in others]
            merged, of_plain = np.empty(all_sizes.sum(), np.int64), np.repeat(plain, all_sizes)
            merged[of_plain], merged[~of_plain] = ids, np.fromiter(chain.from_iterable(others), np.int64)
            ids, sizes = merged, all_sizes
        self._add(ids, sizes)
        self._held += self._cost(words, len(ids))

    def _plain(self, text: bytes) -> bytes:
        """ASCII letters in lower case, unless that could make a special token, which is found before lower-casing."""
        low = text.lower()
        return text if b"<|" in low and any(x in low for x in self._special) else low

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their bounds)."""
        if self._held > CACHE_BYTES:
            self._shrink()
        words = [self._plain(t).split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self._numbers.new:
            self._learn(self._numbers.new)
            self._numbers.new = []
        self._hits += np.bincount(at, minlength=len(self._hits))
        sizes = self._sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._pool[np.repeat(self._starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded_rows(column: pa.Array, path: str, end_id: int, max_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each row its ids and `end_id`, as little-endian uint32; a null row counts as empty."""
    texts = [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= max_bytes):
            size += len(texts[end])
            end += 1
        ids, bounds = encoder(path).encode(texts[first:end])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            row = np.empty(b - a + 1, "<u4")
            row[:-1], row[-1] = ids[a:b], end_id
            yield row
        first = end
