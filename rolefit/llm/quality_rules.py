"""Operator 11: quality rules by distribution divergence: a document's histograms of character classes and of common words, held against its language's."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm._work import mapped, staged, text_chunks

#: The bytes of ASCII white space, and the ASCII punctuation that is cut off both ends of a word before it is compared with common words.
SPACE, PUNCTUATION, SYMBOLS, MARKS = b" \t\n\v\f\r", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#*$%&|<>", b".,;:!?"
#: The classes of code points, in the order of the histogram.
CLASSES = ("space", "lower", "upper", "digit", "mark", "symbol", "other_ascii", "to_u07ff", "from_u0800")
#: Entries of a worker's word counts at which it passes them on to Spark's aggregate and starts anew.
FLUSH_WORDS = 200_000


class Rules(NamedTuple):
    """Thresholds. A document without `least_words` words, or whose repeated three-word windows cover over `repeat_percent` of them, fails at once.

    Texts under `least_chars` code points are not compared by character classes, under `least_words` not by words. A language is a reference from
    `reference_words` words on; of more languages than `most_languages`, those with most words are. Distances are Jensen-Shannon, 0 to 1. The squared
    threshold of words is widened by `sampling` times what a sample of the document's length differs from its own source, on average.
    References are counted twice: over all documents, then over all those within `loose` times the thresholds of the first.
    """

    least_words: int = 50
    repeat_percent: int = 50
    least_chars: int = 200
    char_distance: float = 0.15
    word_distance: float = 0.3
    sampling: float = 1.0
    loose: float = 1.5
    common_words: int = 100
    reference_words: int = 2000
    most_languages: int = 200


def _class_of_byte() -> np.ndarray:
    """The class of the code point that starts with a byte; bytes inside a code point have the number after the last class."""
    of = np.full(256, CLASSES.index("other_ascii"), np.uint8)
    of[0x80:0xC0], of[0xC0:0xE0], of[0xE0:] = len(CLASSES), CLASSES.index("to_u07ff"), CLASSES.index("from_u0800")
    for name, members in (("space", SPACE), ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("mark", MARKS), ("symbol", SYMBOLS)):
        of[list(members)] = CLASSES.index(name)
    return of


_OF_BYTE = _class_of_byte()


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, classes) counts of code points; row i is `data[offsets[i]:offsets[i+1]-1]`."""
    kinds, counts = _OF_BYTE[data], np.empty((len(offsets) - 1, len(CLASSES)), np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)):
        counts[row] = np.bincount(kinds[a:b], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    return counts


def bare(word: bytes) -> bytes:
    """The form in which words are compared with common words: ASCII punctuation cut off both ends, ASCII letters in lower case."""
    return word.strip(PUNCTUATION).lower()


def repeated_window_words(texts: list[list[bytes]], size: int = 3) -> np.ndarray:
    """For each text, how many of its words lie in a window of `size` words that it holds twice or more."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1]) if len(text) >= size else np.empty(0, np.int64)
    keys, most = text[at], len(texts)
    for k in range(size):
        if most * len(numbers) >= 1 << 62:  # numbered anew, to stay within 64 bits
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            most = len(keys)
        keys, most = keys * len(numbers) + ids[at + k], most * len(numbers)
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(ids) + 1, np.int64)
    for k in range(size):
        covered[at[again] + k] = 1
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[ends] - total[ends - sizes]


def repeated_lines(text: bytes) -> int:
    """How many lines that hold a word equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def _entropy(shares: np.ndarray) -> np.ndarray:
    return -(shares * np.log2(np.maximum(shares, 1e-300))).sum(axis=-1)


def divergence(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """(texts, languages) Jensen-Shannon distances, roots of divergences to base 2: of counts (texts, languages or 1, bins) from shares (languages, bins)."""
    p = counts / counts.sum(axis=-1, keepdims=True)
    return np.sqrt(np.clip(_entropy((p + references) / 2) - (_entropy(p) + _entropy(references)) / 2, 0, 1))


def _split(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The words of each row."""
    whole = data.tobytes()
    return [whole[a:b].split() for a, b in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)]


def _read(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


class References(NamedTuple):
    """For each language its shares of the classes, its common words with their places, and their shares, the last that of all other words."""

    langs: list[str]
    classes: np.ndarray
    words: list[dict[bytes, int]]
    shares: np.ndarray


class CommonWords(dict):
    """Numbers words by their bare forms: those that are common in some language, and one number for all others; `of` has each language's numbers by place."""

    #: Words that it keeps; a full one starts anew.
    MOST = 500_000

    def __init__(self, near: References) -> None:
        super().__init__()
        self._bare: dict[bytes, int] = {}
        for words in near.words:
            for word in words:
                self._bare.setdefault(word, len(self._bare))
        self.of = np.full((len(near.langs), near.shares.shape[1] - 1), len(self._bare) + 1)
        for k, words in enumerate(near.words):
            for word, place in words.items():
                self.of[k, place] = self._bare[word]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        number = self[word] = self._bare.get(bare(word), len(self._bare))
        return number

    def counts(self, words: list[bytes]) -> np.ndarray:
        """For each language how often its common words are among `words`, then all others."""
        own = np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=len(self._bare) + 2)
        common = own[self.of]
        return np.concatenate([common, len(words) - common.sum(axis=1, keepdims=True)], axis=1)


def distances(words: list[list[bytes]], chars: np.ndarray, near: References, common: CommonWords, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) distances by classes and by words; NaN where a guard leaves them out."""
    char_d, word_d = np.full((2, len(words), len(near.langs)), np.nan)
    n_chars, n_words = chars.sum(axis=1), np.fromiter(map(len, words), np.int64, len(words))
    a_time = max(1, (1 << 20) // max(1, near.shares.size))  # texts, to bound the arrays
    for d, who in ((char_d, np.flatnonzero(n_chars >= rules.least_chars)), (word_d, np.flatnonzero(n_words >= rules.least_words))):
        for first in range(0, len(who) if near.langs else 0, a_time):
            own = who[first : first + a_time]
            d[own] = divergence(chars[own, None], near.classes) if d is char_d else divergence(np.stack([common.counts(words[k]) for k in own.tolist()]), near.shares)
    return char_d, word_d


def fitting(char_d: np.ndarray, word_d: np.ndarray, n_words: np.ndarray, rules: Rules, loose: float = 1.0) -> np.ndarray:
    """(texts, languages) whether a language is near enough; a distance that was left out fits."""
    allowed = np.sqrt(rules.word_distance**2 + rules.sampling * rules.common_words / (8 * np.log(2) * np.maximum(n_words, 1)))[:, None]
    return ~(char_d > loose * rules.char_distance) & ~(word_d > loose * allowed)


def _counting(sent, rules: Rules):
    """Partial counts (lang, kind, item, n) of classes and of bare words, passed on whenever they grow past `FLUSH_WORDS`; of documents near a reference in `sent`, or of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, words, classes = sent and sent.value, defaultdict(Counter), defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        common = near and CommonWords(near)

        def flush() -> pa.RecordBatch:
            rows = [(lang, "class", name.encode(), n) for lang, own in classes.items() for name, n in zip(CLASSES, own.tolist(), strict=True)]
            for lang, own in words.items():
                plain = Counter()
                for word, n in own.items():
                    plain[bare(word)] += n
                rows += [(lang, "word", word, n) for word, n in plain.items()]
            words.clear()
            classes.clear()
            lang, kind, item, n = zip(*rows, strict=True) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(item, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "kind", "item", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, end, data, offsets in text_chunks(batch.column("text")):
                texts, chars = _split(data, offsets), class_counts(data, offsets)
                taken = np.ones(len(texts), bool)
                if near is not None:
                    taken = fitting(*distances(texts, chars, near, common, rules), np.fromiter(map(len, texts), np.int64, len(texts)), rules, rules.loose).any(axis=1)
                for lang, own, held in compress(zip(langs[first:end], chars, texts, strict=True), taken.tolist()):
                    classes[lang] += own
                    words[lang].update(held)
                if sum(map(len, words.values())) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return count


def _counted(texts: DataFrame, rules: Rules, near: References | None) -> References:
    sent = None if near is None else texts.sparkSession.sparkContext.broadcast(near)
    counts = staged(mapped(texts, _counting(sent, rules), "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "histograms")
    totals = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= rules.reference_words)
    totals = totals.orderBy(F.desc("total"), "lang").limit(rules.most_languages).toPandas().sort_values("lang")
    langs = totals.lang.tolist()
    if not langs:
        return References([], np.empty((0, len(CLASSES))), [], np.empty((0, rules.common_words + 1)))
    of = counts.where(F.col("lang").isin(langs))
    common = of.where("kind = 'word' and item <> ''").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))).where(F.col("place") <= rules.common_words)
    chars = np.zeros((len(langs), len(CLASSES)))
    for r in of.where("kind = 'class'").collect():
        chars[langs.index(r["lang"]), CLASSES.index(r["item"])] = r["n"]
    words, shares = [{} for _ in langs], np.zeros((len(langs), rules.common_words + 1))
    for r in common.collect():
        k = langs.index(r["lang"])
        words[k][r["item"].encode()] = r["place"] - 1
        shares[k, r["place"] - 1] = r["n"]
    shares[:, -1] = totals.total.to_numpy() - shares.sum(axis=1)
    return References(langs, chars / chars.sum(axis=1, keepdims=True), words, shares / shares.sum(axis=1, keepdims=True))


def references(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> References:
    """The histograms of each language, over all documents of `docs` and then over all that are near those first ones; rows without a language count for none.

    Only `most_languages` times `common_words` words reach the driver. Words of equal count are taken in the order of their UTF-8 bytes.
    """
    texts = _read(docs.where(F.col(lang_col).isNotNull()), id_col, text_col, lang_col)
    return _counted(texts, rules, _counted(texts, rules, None))


_FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, char_distance double, word_distance double"


def judge(docs: DataFrame, known: References, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: its counts, `base_failed`, `kept`, and its distances from the language whose distances add up to least (`nearest`).

    `kept`: it passed the base rules, and its distances from one language are within both thresholds. The language column is not asked: a document with
    a wrong language, or without one, is held to the nearest. A distance that the guards leave out, or without references, is null and passes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)  # most_languages x (classes + common_words) numbers at most

    def figures(data: np.ndarray, offsets: np.ndarray, near: References, common: CommonWords) -> list[pa.Array]:
        words, chars, whole = _split(data, offsets), class_counts(data, offsets), data.tobytes()
        n_words, repeats = np.fromiter(map(len, words), np.int64, len(words)), repeated_window_words(words)
        lines = [repeated_lines(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)]
        failed = (n_words < rules.least_words) | (100 * repeats > rules.repeat_percent * n_words)
        base = [n_words, chars[:, 1:].sum(axis=1), chars[:, CLASSES.index("symbol")], lines, repeats]
        char_d, word_d = distances(words, chars, near, common, rules)
        none = np.full(len(words), np.nan)
        if near.langs:
            best = np.argmin(np.round(np.nan_to_num(char_d) + np.nan_to_num(word_d), 9), axis=1)
            kept, rows = ~failed & fitting(char_d, word_d, n_words, rules).any(axis=1), np.arange(len(words))
            char_d, word_d = char_d[rows, best], word_d[rows, best]
            nearest = [near.langs[k] if known else None for k, known in zip(best.tolist(), (~np.isnan(char_d) | ~np.isnan(word_d)).tolist(), strict=True)]
        else:
            kept, nearest, char_d, word_d = ~failed, [None] * len(words), none, none
        rounded = [pa.array(np.round(d, 4), pa.float64(), from_pandas=True) for d in (char_d, word_d)]
        return [*(pa.array(c, pa.int64()) for c in base), pa.array(failed), pa.array(kept), pa.array(nearest, pa.string()), *rounded]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, common = sent.value, CommonWords(sent.value)
        names = [x.split()[0] for x in _FIGURES.split(", ")]
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), *figures(data, offsets, near, common)], names=names)

    return mapped(_read(docs, id_col, text_col, lang_col).select("doc_id", "text"), work, _FIGURES)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`judge` by the languages of `docs` itself, counted over all its rows.

    Null and empty texts have no words and fail the base rules; very long texts are read whole; null ids, and repeated rows, have a row each; without
    a language of enough words the base rules alone decide; an empty table gives no rows; other columns are not read.
    """
    return judge(docs, references(docs, rules), rules)
