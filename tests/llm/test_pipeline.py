import random

import corpus_pipeline


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}x" for _ in range(n))


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    item = f"{words(30, 1)}. {words(8, 2)}."
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words(80, 3), "a"), (1, words(80, 3), "b"), (2, words(80, 4), "c"), (2, words(80, 5), "d"), (3, words(80, 3), "e"), (None, item, "f"), (None, words(40, 6), "g"), (4, item, "h"), (4, words(60, 7), "i"), (5, None, "j"), (6, "", "k")]
    docs = spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id long, text string, _listed string, key string")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    kept = sorted((r.doc_id, r.text or "") for r in near.collect() if r.doc_id is not None)
    assert near.columns == docs.columns
    assert kept == sorted([(1, words(80, 3)), (2, words(80, 4)), (2, words(80, 5)), (4, item), (4, words(60, 7)), (5, ""), (6, "")])
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.key for r in clean.collect()) == list("abcdegijk")
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == corpus_pipeline.decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0
