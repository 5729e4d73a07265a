import numpy as np

from rolefit.llm import _hashing as H
from rolefit.llm.near_dedup import near_duplicates


def patterned(order):
    """The Thue-Morse word of 2**order letters and its complement: equal under any polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_patterned_words_differ(spark):
    for order in range(3, 14):
        one, other = patterned(order)
        data = np.frombuffer(f"{one} {other} {one.upper()}".encode(), np.uint8)
        a, b, c = H.word_hashes(data, H.table(1, fold_case=True))[2].tolist()
        assert a == c != b
        a, b, c = H.word_hashes(data, H.table(1))[2].tolist()
        assert len({a, b, c}) == 3
    docs = spark.createDataFrame([(1, patterned(10)[0]), (2, patterned(10)[1]), (3, patterned(10)[0].upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, size=4).collect()) == [(1, 1), (2, 2), (3, 1)]
