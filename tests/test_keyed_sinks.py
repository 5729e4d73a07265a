import glob

import pytest
from pyspark.sql import functions as F

from rolefit.operators import match
from rolefit.sources import keyed
from tests.test_match import CAND_FEATURE, CANDIDATE, JOB, JOB_FEATURE

RANKING = "company_slug string, candidate_id string, job_id string, status string, score double"


def files_of(path):
    return set(glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_a_changed_decision_moves_and_other_files_stay(spark, tmp_path):
    path = f"{tmp_path}/rankings"
    rows = [("x", f"c{k}", f"j{k}", "match" if k % 2 else "mismatch", k / 100) for k in range(60)]
    keyed.publish_rankings(spark.createDataFrame(rows, RANKING), path, 16)
    before = files_of(path)
    changed = spark.createDataFrame([("x", "c3", "j3", "mismatch", 0.1)], RANKING)
    keyed.publish_rankings(changed, path, 16)
    after = files_of(path)
    assert len(before - after) == 1 and len(after - before) == 1 and len(before & after) == len(before) - 1
    want = {r[1]: r[3:] for r in rows} | {"c3": ("mismatch", 0.1)}
    assert {r.candidate_id: (r.status, r.score) for r in keyed.read_keyed(spark, path).collect()} == want
    keyed.publish_rankings(changed, path, 16)  # again: nothing changes
    assert keyed.read_keyed(spark, path).count() == 60 and keyed.read_keyed(spark, path).columns == changed.columns
    with pytest.raises(ValueError, match="16 buckets, not 8"):
        keyed.publish_rankings(changed, path, 8)
    with pytest.raises(Exception, match="job_id is missing"):
        keyed.publish_rankings(changed.withColumn("job_id", F.lit(" ")), path, 16)
    assert keyed.read_keyed(spark, path).count() == 60  # the failed one left all as it was


def test_repeats_nulls_new_columns_and_removal(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 1, "null"), ("b", 1, "b")], "k string, v int, t string")
    keyed.upsert_keyed(first, path, ["k"], F.col("v"), 4)
    keyed.upsert_keyed(spark.createDataFrame([(None, 5, True)], "k string, v int, extra boolean"), path, ["k"], buckets=4)
    got = {r.k: (r.v, r.t) for r in keyed.read_keyed(spark, path).collect()}
    assert got == {"a": (2, "new"), None: (5, None), "b": (1, "b")}
    keyed.upsert_keyed(first.limit(0), path, ["k"], buckets=4)
    keys = spark.createDataFrame([("b",), ("zz",), ("b",)], "k string")
    keyed.remove_keyed(keys, path, ["k"], 4)
    keyed.remove_keyed(keys, f"{tmp_path}/absent", ["k"], 4)
    assert {r.k for r in keyed.read_keyed(spark, path).collect()} == {"a", None}
    keyed.upsert_keyed(first.where("k = 'b'"), path, ["k"], buckets=4)
    assert {r.k for r in keyed.read_keyed(spark, path).collect()} == {"a", None, "b"}
    with pytest.raises(ValueError, match="no keyed sink"):
        keyed.read_keyed(spark, f"{tmp_path}/absent")


def inputs(spark):
    job = lambda k, place="eindhoven": (k, f"j{k}", place, "Hybrid", "senior", 0.8, 4, "required", 0.7, None)
    cand = spark.createDataFrame([(1, "c", "Eindhoven, Netherlands", None, None, "senior", 0.9, 6, 0.8)], CANDIDATE)
    feats = spark.createDataFrame([(1, "skills", "python", "core", 1.0), (1, "protocols", "can", "strong", 0.9)], CAND_FEATURE)
    jobs = spark.createDataFrame([job(1), job(2, "delft"), job(3)], JOB).select("*", F.lit("x").alias("company_slug"), F.format_string("Title %d", "job_key").alias("title"), F.format_string("http://x/%d", "job_key").alias("url"))
    items = spark.createDataFrame([(k, b, n, p, "required", 0.9) for k in (1, 2) for p, (b, n) in enumerate([("skills", "python"), ("protocols", "can")])] + [(3, "skills", "excel", 0, "required", 1.0)], JOB_FEATURE)
    return cand, feats, jobs, items


def test_rank_publish_and_drop(spark, tmp_path):
    cand, feats, jobs, items = inputs(spark)
    decisions, rankings = f"{tmp_path}/decisions", f"{tmp_path}/rankings"
    other = jobs.limit(1).withColumn("url", F.lit("http://x/other"))
    keyed.publish_layer(jobs.withColumn("layer", F.lit("match")).unionByName(jobs.withColumn("layer", F.lit("raw"))).unionByName(other.withColumn("layer", F.lit("match"))), decisions, 4)
    keyed.rank_and_publish(cand, feats, jobs, items, rankings, decisions, 0.5, 4)
    want = {r.job_key: (r.status, r.score, r.reasons) for r in match.evaluate(cand, feats, jobs, items, 0.5).collect()}
    assert {r.job_key: (r.status, r.score, r.reasons) for r in keyed.read_keyed(spark, rankings).collect()} == want and want[1][0] == "match"
    left = sorted((r.layer, r.url) for r in keyed.read_keyed(spark, decisions).collect())
    assert left == [("match", "http://x/other"), ("raw", "http://x/1"), ("raw", "http://x/2"), ("raw", "http://x/3")]
    keyed.rank_and_publish(cand, feats, jobs, items, rankings, decisions, 0.9, 4)
    assert {r.status for r in keyed.read_keyed(spark, rankings).collect()} == {"mismatch"}


def test_a_batch_replayed_after_a_failure_publishes_once(spark, tmp_path, monkeypatch):
    cand, feats, jobs, items = inputs(spark)
    jobs.write.parquet(f"{tmp_path}/in")
    rankings, ledger, runs = f"{tmp_path}/rankings", f"{tmp_path}/ledger", []
    real = keyed.rank_and_publish

    def failing(*args, **kwargs):
        real(*args, **kwargs)
        runs.append(1)
        if len(runs) == 1:
            raise RuntimeError("lost between publish and ledger")

    monkeypatch.setattr(keyed, "rank_and_publish", failing)

    def stream():
        own = spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/in")
        keyed.stream_rankings(own, cand, feats, items, rankings, ledger, f"{tmp_path}/checkpoint", threshold=0.5, buckets=4).awaitTermination()

    with pytest.raises(Exception, match="lost between"):
        stream()
    stream()
    stream()
    assert len(runs) == 2 and spark.read.parquet(ledger).count() == 1
    got = sorted((r.job_key, r.status, r.score) for r in keyed.read_keyed(spark, rankings).collect())
    assert got == sorted((r.job_key, r.status, r.score) for r in match.evaluate(cand, feats, jobs, items, 0.5).collect())
    assert not keyed.publish_once(jobs, lambda x: runs.append(2), ledger, "rankings", 0) and len(runs) == 2
