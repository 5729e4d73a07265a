"""Operator 3: benchmark decontamination by a BM25 index of the items with block-max WAND."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm import _hashing as H
from rolefit.llm._work import mapped, text_chunks

K1, B, BLOCK = 1.2, 0.75, 16
#: ASCII bytes other than letters and digits part words.
_APART = np.array([32 if i < 128 and not chr(i).isalnum() else i for i in range(256)], np.uint8)
_VALUES = H.table(3, fold_case=True)


def _words(text: str) -> np.ndarray:
    return H.word_hashes(_APART[np.frombuffer(text.encode(), np.uint8)], _VALUES)[2]


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; of one sentence alone, the last quarter of its words."""
    parts = [x for x in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if x.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index(NamedTuple):
    """Impacts are BM25 scores divided by the item's score for its own text, so 1 is the whole item and one threshold serves all."""

    item_ids: list
    terms: np.ndarray  # sorted word hashes
    bounds: np.ndarray  # postings of term t: bounds[t]..bounds[t+1]
    items: np.ndarray
    impacts: np.ndarray
    block_max: list  # for each term the largest impact of every BLOCK postings
    list_max: np.ndarray
    keep: np.ndarray  # postings that are essential to their item
    slack: np.ndarray  # what an item's other terms add at most
    questions: list
    answers: list
    passage: int  # words of a passage; passages start at every half of it


def build_index(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_words: float, threshold: float) -> Index:
    docs = [(k, t, _words(t)) for k, t in items]
    docs = [d for d in docs if len(d[2])]
    rows = []
    for i, (_, _, words) in enumerate(docs):
        terms, tf = np.unique(words, return_counts=True)
        df = np.array([frequency[int(t)] for t in terms])
        impact = np.log1p((n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        impact /= impact.sum()
        order = np.argsort(impact, kind="stable")
        keep = np.empty(len(terms), bool)
        keep[order] = np.cumsum(impact[order]) > threshold / 2  # the others together stay below half the threshold
        rows.append((terms, np.full(len(terms), i), impact, keep))
    term, item, impact, keep = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, d) for k, d in enumerate((H.U, np.int64, float, bool)))
    order = np.lexsort((item, term))
    term, item, impact, keep = term[order], item[order], impact[order], keep[order]
    terms, first = np.unique(term, return_index=True)
    bounds = np.append(first, len(term))
    block_max = [np.maximum.reduceat(impact[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    halves = [question_and_answer(t) for _, t, _ in docs]
    return Index(
        [k for k, _, _ in docs], terms, bounds, item, impact, block_max, np.array([m.max() for m in block_max]), keep, np.bincount(item, impact * ~keep, len(docs)),
        [_words(q) for q, _ in halves], [_words(a) for _, a in halves], max(64, 2 * max((len(w) for _, _, w in docs), default=0)),
    )


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items that the distinct `terms` (numbers of index terms) score `threshold` or more, by block-max WAND."""
    eps = 1e-9
    lists = [(index.items[index.bounds[t] : index.bounds[t + 1]], index.impacts[index.bounds[t] : index.bounds[t + 1]], index.block_max[t], index.list_max[t]) for t in terms]
    at, found = [0] * len(lists), []
    alive = [k for k in range(len(lists)) if len(lists[k][0])]
    while alive:
        alive.sort(key=lambda k: lists[k][0][at[k]])
        bound, pivot = 0.0, None
        for n, k in enumerate(alive):
            bound += lists[k][3]
            if bound >= threshold - eps:
                pivot = n
                break
        if pivot is None:
            break
        item = lists[alive[pivot]][0][at[alive[pivot]]]
        while pivot + 1 < len(alive) and lists[alive[pivot + 1]][0][at[alive[pivot + 1]]] == item:
            pivot += 1
        front = alive[: pivot + 1]
        blocks = {k: min(int(np.searchsorted(lists[k][0], item)), len(lists[k][0]) - 1) // BLOCK for k in front}
        if sum(lists[k][2][blocks[k]] for k in front) < threshold - eps:  # no item up to the nearest end of these blocks can score enough
            ends = [lists[k][0][min((blocks[k] + 1) * BLOCK, len(lists[k][0])) - 1] + 1 for k in front]
            target = max(item + 1, min(ends)) if pivot + 1 == len(alive) else max(item + 1, min(*ends, lists[alive[pivot + 1]][0][at[alive[pivot + 1]]]))
        else:
            score = 0.0
            for k in front:
                p = int(np.searchsorted(lists[k][0], item))
                if p < len(lists[k][0]) and lists[k][0][p] == item:
                    score += lists[k][1][p]
            if score >= threshold - eps:
                found.append((int(item), float(score)))
            target = item + 1
        for k in front:
            at[k] += int(np.searchsorted(lists[k][0][at[k] :], target))
        alive = [k for k in alive if at[k] < len(lists[k][0])]
    return found


def _overlap(part: np.ndarray, passage: np.ndarray, size: int = 5) -> float:
    """Share of the part's distinct `size`-word shingles that the passage has; a shorter part counts as one run; an empty one is covered."""
    if not len(part):
        return 1.0
    size = min(size, len(part))
    own = np.unique(H.sequence_hash(part, size))
    return float(np.isin(own, H.sequence_hash(passage, size)).mean())


def _searcher(sent, threshold: float, overlap: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        first, n_items, half = index.keep.nonzero()[0], len(index.item_ids), max(1, index.passage // 2)
        posting_term = np.repeat(np.arange(len(index.terms)), np.diff(index.bounds))
        essential = np.unique(posting_term[first])
        seen = np.zeros(1 << 20, bool)
        seen[(index.terms[essential] >> H.U(44)).astype(np.int64)] = True
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for row, end, data, offsets in text_chunks(batch.column("text")):
                starts, _, words = H.word_hashes(_APART[data], _VALUES)
                bounds = np.searchsorted(starts, offsets)
                may = np.flatnonzero(seen[(words >> H.U(44)).astype(np.int64)])
                term = np.minimum(np.searchsorted(index.terms, words[may]), max(0, len(index.terms) - 1))
                sure = (index.terms[term] == words[may]) if len(index.terms) else np.zeros(len(may), bool)
                may, term = may[sure], term[sure]
                doc = np.searchsorted(bounds, may, "right") - 1
                turn = (may - bounds[doc]) // half
                # A word lies in the passage that starts at its half and in the one before; passages have ids that rise over the run.
                base = np.concatenate([[0], np.cumsum((bounds[1:] - bounds[:-1]) // half + 2)])
                passage, term = np.concatenate([base[doc] + turn + 1, base[doc] + turn]), np.concatenate([term, term])
                keys = np.unique(passage * len(index.terms) + term)
                passage, term = keys // max(1, len(index.terms)), keys % max(1, len(index.terms))
                low, n = index.bounds[term], np.diff(index.bounds)[term]
                posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                passage = np.repeat(passage, n)[index.keep[posting]]
                posting = posting[index.keep[posting]]
                pair, at = np.unique(passage * n_items + index.items[posting], return_inverse=True)
                mass = np.bincount(at, index.impacts[posting], len(pair))
                hopeful = np.unique(pair[mass + index.slack[pair % max(1, n_items)] >= threshold - 1e-9] // max(1, n_items))
                best: dict[tuple[int, int], tuple] = {}
                for p in hopeful.tolist():
                    d = int(np.searchsorted(base, p, "right")) - 1
                    a = max(0, p - int(base[d]) - 1) * half + int(bounds[d])
                    run = words[a : min(a + index.passage, int(bounds[d + 1]))]
                    known = np.searchsorted(index.terms, np.unique(run))
                    known = np.unique(known[(known < len(index.terms))])
                    known = known[np.isin(index.terms[known], run)]
                    for item, score in wand(index, known, threshold):
                        q, w = _overlap(index.questions[item], run), _overlap(index.answers[item], run)
                        if q >= overlap and w >= overlap:
                            key = (d, item)
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, w))
                out += [(ids[row + d].as_py(), index.item_ids[item], *found) for (d, item), found in sorted(best.items())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return search


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words, n = np.unique(_words(text), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.int64()), pa.array(words.view(np.int64)), pa.array(n)], names=["item_id", "word", "n"])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, slice_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every document and benchmark item found in it.

    Every half-overlapping passage of every text (twice the longest item's words, 64 at least) is a query to a BM25 index of the items: an item is
    retrieved if the passage scores `threshold` or more of what the item's own text scores. It counts if the passage also has `overlap`
    or more of the five-word shingles of its question and of its answer. Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.

    Before the block-max WAND search, a passage must hold enough of some item's rarer terms; the others cannot add up to the
    threshold. Items are taken `slice_items` at a time, so that an index has a bounded size to broadcast; corpus statistics are those
    of all items. Items or texts that are null or without words match nothing; repeated rows are each answered; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    counted = mapped(items, _item_words, "item_id long, word long, n long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_items, n_words = counted.agg(F.countDistinct("item_id"), F.sum("n")).first()
    if not n_items:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    slices = -(-n_items // slice_items)
    chosen = lambda k: F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k
    frequency, result = counted.groupBy("word").agg(F.countDistinct("item_id").alias("df")), None
    for k in range(slices):
        own = counted.where(chosen(k)).select("word").distinct()
        df = {r["word"] % (1 << 64): r["df"] for r in frequency.join(own.hint("merge"), "word", "left_semi").collect()}
        rows = [(r["item_id"], r["text"]) for r in items.where(chosen(k)).orderBy("item_id", "text").collect()]
        index = build_index(rows, df, n_items, n_words / n_items, threshold)
        found = mapped(texts, _searcher(spark.sparkContext.broadcast(index), threshold, overlap), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        result = found if result is None else result.union(found)
    return result
