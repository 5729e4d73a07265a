from pyspark.sql import functions as F

from rolefit.functions.extract import recruiter_contact
from rolefit.operators import match

C = "cand_key long, preferred_locations array<string>, excluded_locations array<string>, preferred_workplaces array<string>, excluded_workplaces array<string>, requires_visa_sponsorship boolean, avoid_export_control_roles boolean, seniority string, seniority_confidence double, years int, years_confidence double"
CF = "cand_key long, bucket string, name string, strength string, level string, confidence double"
J = "job_key long, location string, remote_policy string, workplace_type string, seniority string, seniority_confidence double, min_years int, years_level string, years_confidence double, restrictions array<string>"
JF = "job_key long, bucket string, name string, pos int, requirement_level string, confidence double"


def tables(spark, candidate, jobs, features=(), own=()):
    return spark.createDataFrame([candidate], C), spark.createDataFrame(list(own), CF), spark.createDataFrame(jobs, J), spark.createDataFrame(list(features), JF)


def details(spark, *args):
    return {r.job_key: (r.stage, [(d.bucket, d.reason, d.expected, d.actual) for d in r.details], r.reasons) for r in match.evaluate(*tables(spark, *args)).collect()}


def test_locations_and_workplaces(spark):
    candidate = (1, ["Delft", " Eindhoven  Region"], ["Paris"], ["remote", "Hybrid"], ["On-site"], None, None, None, None, None, None)
    jobs = [
        (1, "eindhoven", "", "Hybrid", None, None, None, None, None, None), (2, " ", None, None, None, None, None, None, None, None),
        (3, "Paris  La Defense", "On-site", "Hybrid", None, None, None, None, None, None), (4, "Delft", "Remote", None, None, None, None, None, None, []),
    ]
    got = details(spark, candidate, jobs)
    assert got[1][0] == got[4][0] == "ranking" and got[1][1] == []
    assert got[2][1] == [("location", "preferred_location_unknown", "delft, eindhoven region", None), ("workplace_type", "preferred_workplace_type_unknown", "remote, hybrid", None)]
    label = "Paris La Defense"
    assert got[3][1] == [
        ("location", "preferred_location_not_matched", "delft, eindhoven region", label), ("location", "excluded_location_matched", label, label),
        ("workplace_type", "preferred_workplace_type_not_matched", "remote, hybrid", "On-site"), ("workplace_type", "excluded_workplace_type_matched", "On-site", "On-site"),
    ]


def test_every_missing_feature_and_restriction_has_its_reason(spark):
    candidate = (1, None, None, None, None, False, True, "Medior ", 1.0, 2, 1.0)
    jobs = [(1, "x", "Remote", None, "senior", 1.0, 4, "required", 1.0, ["work_authorization", "citizenship", "other"]), (2, "x", "Remote", None, None, None, None, None, None, ["controlled_technology", "citizenship"])]
    features = [(1, "domains", "B", 0, "required", 1.0), (1, "skills", "a", 3, "required", 1.0), (1, "skills", " A ", 4, "required", 0.5), (1, "skills", "known", 1, "required", 1.0), (1, "languages", "dutch", 0, "preferred", 1.0)]
    got = details(spark, candidate, jobs, features, [(1, "skills", "Known", "core", None, 1.0)])
    assert got[1][:2] == ("job_must_have", [
        ("skills", "required_feature_missing", "a", None), ("domains", "required_feature_missing", "b", None), ("seniority", "seniority_not_satisfied", "senior", "Medior"),
        ("years_experience", "years_experience_not_satisfied", "4", "2"), ("restrictions", "citizenship_eligibility_unknown", "citizenship", None), ("restrictions", "restriction_eligibility_unknown", "other", None),
    ])
    assert got[1][2].count("required_feature_missing") == 2
    assert got[2][:2] == ("candidate_must_have", [("restrictions", "candidate_avoids_export_control_roles", "controlled_technology", "candidate avoids export-control roles")])


def test_language_levels_of_candidates(spark):
    frame = spark.createDataFrame([(1, "languages", "Dutch", None, "basic", 0.9), (1, "languages", "dutch", None, "Fluent", 0.5), (1, "skills", "c", "strong", None, 1.0)], CF)
    assert {(r.name, round(r.quality, 6)) for r in match.candidate_index(frame).collect()} == {("dutch", 0.45), ("c", 0.8)}


def test_matches_are_those_of_the_product(spark, monkeypatch):
    own = [(k, b, f"n{(k * 7 + i) % 11}", "core", None, 1.0) for k in range(12) for i, b in enumerate(("skills", "protocols", "standards", "domains", "skills"))]
    asked = [(j, b, f"n{(j * 3 + i) % 11}", i, "required" if (i + j) % 4 == 0 else "preferred", 1.0) for j in range(40) for i, b in enumerate(("skills", "protocols", "standards", "domains")) if (i + j) % 5]
    c = spark.createDataFrame([(k, None, None, None, None, None, None, "senior", 1.0, 5, 1.0) for k in range(12)], C)
    j = spark.createDataFrame([(k, "x", "Remote", None, "senior", 1.0, 3, "required", 1.0, ["citizenship"] if k % 9 == 0 else []) for k in range(41)], J)
    args = c, spark.createDataFrame(own, CF), j, spark.createDataFrame(asked, JF)
    for threshold in (0.3, 0.6):
        want = {(r.cand_key, r.job_key, r.score) for r in match.evaluate(*args, threshold).where("status = 'match'").collect()}
        plan = match.matches(*args, threshold)
        assert want and {(r.cand_key, r.job_key, r.score) for r in plan.collect()} == want
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    items, index = match.job_items(args[3]), match.candidate_index(args[1])
    assert match.matches(*args, 0.05).count() == match.evaluate(*args, 0.05).where("status = 'match'").count()
    need = {k: {(r.bucket, r.name) for r in items.where(f"required and job_key = {k}").collect()} for k in range(6)}
    have = {}
    for r in index.collect():
        have.setdefault(r.cand_key, set()).add((r.bucket, r.name))
    want = {(a, b) for b, n in need.items() for a, h in have.items() if n and n <= h}
    for bits in (4, 1):
        monkeypatch.setattr(match, "SIGNATURE_WORDS", bits)
        monkeypatch.setattr(match, "_WORDS", [f"w{k}" for k in range(bits)])
        assert {(r.cand_key, r.job_key) for r in match.covered_pairs(index, items.where("job_key < 6")).collect()} == want
        index = index.union(spark.createDataFrame([(99, "skills", f"more{k}", 0.5) for k in range(70)], index.schema))  # more features than one word has bits


def test_email_begins_at_a_word(spark):
    row = spark.createDataFrame([("Ask .-ann@x.example.com or b@y.nl",)], "t string").select(recruiter_contact(F.col("t")).alias("r")).first()
    assert row.r.email == "ann@x.example.com"


def test_stored_constraints_are_the_second_gate(spark):
    from tests.test_match import CAND_FEATURE, CANDIDATE, JOB, JOB_FEATURE

    cand = spark.createDataFrame([(1, "c", None, True, None, "medior", 0.9, None, 0.8)], CANDIDATE)
    feats = spark.createDataFrame([(1, "skills", "python", "core", 1.0)], CAND_FEATURE)
    jobs = spark.createDataFrame([(k, f"j{k}", "x", "Hybrid", "lead", 0.8, 4, "required", 0.7, None) for k in (1, 2, 3, 4)], JOB)
    items = spark.createDataFrame([(k, "skills", n, p, "required", 0.9) for k in (1, 2, 3, 4) for p, n in enumerate(("python", "excel"))], JOB_FEATURE)
    rows = [
        (1, 0, " Feature", "Skills", "PYTHON ", None), (1, 1, "note", "x", "y", None), (1, 2, "seniority", "seniority", " ", None), (1, 3, "years_experience", None, None, None),
        (2, 5, "restriction", "restrictions", "work_authorization", None), (2, 2, "years_experience", "years_experience", None, 0), (2, 1, "seniority", "seniority", "Senior", None), (2, 9, "feature", "domains", "python", None), (2, 9, "feature", "domains", "python", None),
        (3, 0, "seniority", "seniority", "junior", None),
    ]
    stored = spark.createDataFrame(rows, "job_key long, pos int, kind string, bucket string, value string, min_years int")
    got = {r.job_key: r for r in match.evaluate(cand, feats, jobs, items, 0.0, stored=stored).collect()}
    assert {k: got[k].stage for k in got} == {1: "ranking", 2: "job_must_have", 3: "ranking", 4: "job_must_have"}
    assert got[2].reasons == ["seniority_not_satisfied", "years_experience_not_satisfied", "work_authorization_not_satisfied", "required_feature_missing", "required_feature_missing"]
    assert got[4].reasons == ["required_feature_missing", "seniority_not_satisfied", "years_experience_not_satisfied"] and got[1].skills_score == 0.5
    plain = {r.job_key: r for r in match.evaluate(cand, feats, jobs, items, 0.0, False, stored).collect()}
    assert {k: (plain[k].stage, plain[k].score) for k in plain} == {k: (got[k].stage, got[k].score) for k in got}


def test_seniority_and_years_are_explained(spark):
    cands = spark.createDataFrame([(1, "Senior", 1.0, 3, 0.5), (2, None, None, None, None), (3, "junior", 1.0, -1, 1.0)], "cand_key long, seniority string, seniority_confidence double, years int, years_confidence double")
    jobs = spark.createDataFrame([(1, " lead", 0.8, 6, 1.0), (2, "boss", 1.0, 0, 1.0), (3, None, None, None, None)], "job_key long, seniority string, seniority_confidence double, min_years int, years_confidence double")
    pairs = cands.select("cand_key").crossJoin(jobs.select("job_key")).withColumn("stage", F.lit("ranking")).unionByName(spark.createDataFrame([(1, 1, "job_must_have")], "cand_key long, job_key long, stage string"))
    got = {(r.cand_key, r.job_key, r.bucket): (r.job_value, r.candidate_value, r.score, r.matched) for r in match.explained_levels(pairs, cands, jobs).collect()}
    gaps = {(c, 1, b): (v, None, None, False) for c in (2, 3) for b, v in (("seniority", "lead"), ("years_experience", "6"))}
    assert got == gaps | {(1, 1, "seniority"): ("lead", "senior", 0.4, True), (1, 1, "years_experience"): ("6", "3", 0.25, True)}
