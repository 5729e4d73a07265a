from pyspark.sql import functions as F

from rolefit.operators import match

CANDIDATE = "cand_key long, candidate_id string, preferred_location string, requires_visa_sponsorship boolean, avoid_export_control_roles boolean, seniority string, seniority_confidence double, years int, years_confidence double"
CAND_FEATURE = "cand_key long, bucket string, name string, strength string, confidence double"
JOB = "job_key long, job_id string, location string, remote_policy string, seniority string, seniority_confidence double, min_years int, years_level string, years_confidence double, restriction string"
JOB_FEATURE = "job_key long, bucket string, name string, pos int, requirement_level string, confidence double"


def evaluated(spark, jobs, job_features, candidate=None, threshold=0.6):
    own = candidate or (1, "c", "Eindhoven, Netherlands", None, None, "senior", 0.9, 6, 0.8)
    feats = [(1, "skills", " Python ", "core", 1.0), (1, "skills", "python", "exposure", 0.4), (1, "languages", "English", "strong", 1.0), (1, "protocols", "CAN", "strong", 0.9), (1, "domains", "medical", "secondary", 0.8)]
    rows = match.evaluate(spark.createDataFrame([own], CANDIDATE), spark.createDataFrame(feats, CAND_FEATURE), spark.createDataFrame(jobs, JOB), spark.createDataFrame(job_features, JOB_FEATURE), threshold)
    return {r.job_key: r for r in rows.collect()}


def test_gates_and_score(spark):
    job = lambda k, location="eindhoven", restriction=None, level="senior": (k, f"j{k}", location, "Hybrid", level, 0.8, 4, "required", 0.7, restriction)
    jobs = [job(1), job(2, "delft"), job(3), job(4, restriction="work_authorization"), job(5, level="lead"), job(6, location=None)]
    features = [(k, b, n, p, "required", c) for k in (1, 2, 4, 5, 6) for p, (b, n, c) in enumerate([("skills", "PYTHON", 0.9), ("protocols", "can", 0.8)])] + [(3, "skills", "excel", 0, "required", 1.0), (1, "domains", "", 5, "required", 1.0), (1, "standards", "iso", 6, "preferred", 0.5)]
    got = evaluated(spark, jobs, features)
    assert (got[1].stage, got[1].status) == ("ranking", "mismatch")
    assert got[1].skills_score == 1.0 and got[1].protocols_score == 0.72 and got[1].standards_score == 0.0 and got[1].seniority_score == 0.72 and got[1].years_score == 0.56
    assert abs(got[1].score - (0.4 + 0.15 * 0.72 + 0.05 * 0.72 + 0.05 * 0.56)) < 1e-9 and got[1].reasons == ["score_below_threshold"]
    assert got[2].reasons == ["preferred_location_not_matched"] and got[2].score == 0
    assert got[3].reasons == ["required_feature_missing"]
    assert got[4].reasons == ["work_authorization_unknown"]
    assert got[5].reasons == ["seniority_not_satisfied"]
    assert got[6].reasons == ["preferred_location_unknown"]
    assert evaluated(spark, jobs, features, threshold=0.5)[1].status == "match"


def test_stance_and_unknowns(spark):
    job = (1, "j", "x", "Remote", None, None, None, None, None, "work_authorization")
    got = evaluated(spark, [job], [(1, "skills", "python", 0, None, None)], (1, "c", None, True, None, None, None, None, None))
    assert got[1].stage == "candidate_must_have" and got[1].reasons == ["candidate_requires_visa_sponsorship"]
    got = evaluated(spark, [job], [(1, "skills", "python", 0, None, None)], (1, "c", None, False, None, None, None, None, None))
    assert got[1].stage == "ranking" and got[1].score == 0


def test_rank_and_constraints(spark):
    rows = spark.createDataFrame([(1, 1, "mismatch", 0.5), (1, 2, "match", 0.7), (1, 3, "match", 0.9), (1, 4, "mismatch", 0.59)], "cand_key long, job_key long, status string, score double")
    assert [r.job_key for r in match.ranked_jobs(rows).orderBy("place").collect()] == [3, 2, 1, 4]
    assert [r.job_key for r in match.top_matches(rows, 1).collect()] == [3]
    jobs = spark.createDataFrame([(1, "j", "x", "Remote", "senior", 1.0, 0, "required", 1.0, "citizenship")], JOB)
    features = spark.createDataFrame([(1, "domains", "b", 0, "required", 1.0), (1, "skills", "a", 1, "required", 1.0), (1, "skills", " A", 2, "required", 1.0), (1, "skills", "c", 3, "preferred", 1.0)], JOB_FEATURE)
    kinds = lambda stored: [(r.kind, r.value) for r in match.job_constraints(jobs, features, stored).orderBy("pos").collect()]
    assert kinds(True) == [("feature", "a"), ("feature", "b"), ("seniority", "senior"), ("years_experience", None), ("restriction", "citizenship")]
    assert kinds(False) == [("feature", "a"), ("feature", "b"), ("seniority", "senior")]


def test_empty(spark):
    assert evaluated(spark, [], []) == {}
    assert F is not None


def test_counters_come_with_the_run(spark, tmp_path):
    rows = [(1, 1, "ranking", "match", 0.7), (1, 2, "ranking", "mismatch", 0.2), (2, 1, "job_must_have", "mismatch", 0.0), (2, 2, "candidate_must_have", "mismatch", 0.0), (3, 1, "ranking", "match", 0.9)]
    table = spark.createDataFrame(rows, "cand_key long, job_key long, stage string, status string, score double")
    run, counters = match.counted(table)
    run.write.parquet(f"{tmp_path}/out")
    assert counters.get == {"pairs": 5, "matches": 2, "stopped_by_candidate": 1, "stopped_by_job": 1, "ranked": 3, "best": 0.9}
    empty, none = match.counted(table.limit(0), "empty")
    assert empty.collect() == [] and none.get["pairs"] == 0 and none.get["best"] is None
