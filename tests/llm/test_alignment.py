import hashlib
import random
from bisect import bisect
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rolefit.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def letters():
    """The usual byte alphabet of byte-level vocabularies, as in its published description."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            out[chr(256 + n)] = b
            n += 1
    return out


def brute(texts):
    """The contract on whole texts, one after the other, without cuts or caches."""
    a, b, of = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]), letters()
    a.encode_special_tokens = True
    groups = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        of_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            groups.append([])
            continue
        ends = [list(accumulate(map(len, own))) for own in (of_a, of_b)]
        common, own, at = sorted(set(ends[0]) & set(ends[1])), [], 0
        for end in common:
            own.append(tuple(ids[bisect(es, at) : bisect(es, end)] for ids, es in zip((ids_a, ids_b), ends)))
            at = end
        groups.append(own)
    links = [[(x, y) for xs, ys in own for x in xs for y in ys] for own in groups]
    counts = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for own, pairs in zip(groups, links):
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in own)
        yield (sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if own else "")


def texts():
    r = random.Random(4)
    odd = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "x　 y", "x​ y", "x᠎ y", "x\x1c y", "x▁ y", "▁", "it's 'sa", "<|endoftext|> a<s> </s><unk> <0x41>", "é é ﬁ", "\x00 a", "日本語 テスト ✓", "😀 😀😀", "\t\t", "a\n\n\nb  c   d\r\n", "ﷺ  ﻿ b"]
    alphabet = ["a", "B", "é", "1", " ", " ", "  ", "\n", ".", "'s", "　", "ing", "the", "中", "😀", "\xa0", "\x1f", "|"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(300)]
    usual = [" ".join(r.choice("the of and internationalisation Vergleich où naïve 2024 don't (see e.g. www.x.org) — end.".split()) for _ in range(80)) for _ in range(20)]
    return odd + made + usual + usual[:5] * 3 + ["x" * 5000, " ".join(usual) * 3]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_alignment_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", most)
    rows = texts()
    docs = spark.createDataFrame([(k, t, "d", "a", 1) for k, t in enumerate(rows)] + [(None, "a", "d", "a", 1), (4, "a", "d", "a", 1)], "doc_id long, text string, digest string, a string, copies int").repartition(3)
    got = A.alignment(docs, *PATHS)
    assert got.columns == ["doc_id", *COLUMNS]
    expected = [(k, *x) for k, x in zip([*range(len(rows)), None, 4], brute([*rows, "a", "a"]))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_small_cache_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(A, "CACHE_BYTES", 2000)
    own, rows = A.Aligner(*PATHS), [t for t in texts() if t]
    plain = list(brute(rows))
    for k in range(0, len(rows), 7):
        x = own.align(rows[k : k + 7])
        shas = [hashlib.sha256(t).hexdigest() if t else "" for t in x.groups]
        assert list(zip(x.n_a, x.n_b, x.n_groups, x.n_links, shas)) == [(*p[:4], p[6]) for p in plain[k : k + 7]]
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert A.alignment(docs.limit(0), *PATHS).collect() == []
    assert [tuple(r) for r in A.alignment(docs.select("doc_id", docs.text.substr(5, 1).alias("text")), *PATHS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
