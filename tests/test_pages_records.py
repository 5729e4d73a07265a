import json
import time

import pytest
from pyspark.sql import functions as F

from rolefit.functions import pages as P
from rolefit.functions import text as T
from rolefit.operators import collect, match, merge, publish, records
from rolefit.sources import files

PAGE = """<body><h1>Dev</h1><div class="job-tags-wrapper"><span class="x job-tag" data-type=" Location "><i></i><span class="job-tag-value"> Eind&amp;hoven </span></span>
<span class='job-tag' title='Location'><b class='job-tag-value'></b></span><span class="job-tagged" title="country"><b class="job-tag-value">X</b></span></div>
<ul><li><span>Work experience</span><span>At least 4 years experience</span></li><li><b>Workplace type</b>: Hybrid <i>x</i></li><li>Our <b>Team</b> is nice</li></ul>
<script type="application/ld+json">{bad</script><script type="application/ld+json">[1,{"@type":"Thing"},{"@type":"jobPosting","jobLocation":{"address":{"addressLocality":" Town ","addressCountry":"NL"}},"employmentType":"FULL"}]</script></body>"""
TEXT = (
    "Role What do you bring to the table? Bachelor’s degree or similar You have 2-3 years of experience You understand design You are fluent in Dutch and English "
    "Knowledge of German is a plus What can you expect in return from us? Pay"
)


def test_page_fields(spark):
    pages = spark.createDataFrame([("u", PAGE, None, ["b", "a"]), ("v", None, "", None)], "url string, html string, title string, disciplines array<string>")
    one, none = records.page_records(pages).orderBy("url").collect()
    assert (one.title, one.location, one.country, one.fulltime_parttime, one.workplace_type, one.team, one.disciplines) == ("Dev", "Eind&hoven", "NL", "FULL", "Hybrid x", None, ["a", "b"])
    assert (one.min_years_experience, one.max_years_experience, one.experience_text) == (4, None, "At least 4 years experience")
    assert (none.location, none.description_text, none.required_degrees, none.disciplines) == (None, "", [], [])


def test_requirement_lines(spark):
    df = spark.createDataFrame([(TEXT,), ("no section",), (None,)], "t string").select(P.requirement_lines(F.col("t")).alias("r"))
    rows = df.select("r", P.spoken_languages(F.col("r.required"), F.col("r.preferred")).alias("l")).collect()
    assert rows[0].r.required == ["Bachelor’s degree or similar", "You have 2-3 years of experience", "You understand design", "You are fluent in Dutch and English"]
    assert (rows[0].r.preferred, rows[0].l.required, rows[0].l.preferred) == (["Knowledge of German is a plus"], ["Dutch", "English"], ["German"])
    assert all((r.r.required, r.r.preferred, r.l.required) == ([], [], []) for r in rows[1:])


def test_typed_profiles(spark):
    def profile(**parts):
        years, wishes = {"value": 3, "confidence": 1, "evidence": ["e"]}, dict.fromkeys(("preferred_locations", "excluded_locations", "preferred_workplace_types", "excluded_workplace_types", "notes"), [])
        wishes |= {"requires_visa_sponsorship": None, "avoid_export_control_roles": None, "confidence": 0, "evidence": ["e"]}
        own = dict.fromkeys(("skills", "languages", "protocols", "standards", "domains"), []) | {"seniority": {"value": None, "confidence": 0, "evidence": []}, "years_experience_total": years, "candidate_constraints": wishes}
        for name, value in parts.items():
            own[name] = own[name] | value if isinstance(own[name], dict) else value
        return json.dumps(own)

    spoken = {"name": "nl", "level": None, "confidence": 1, "evidence": ["e"]}
    cases = [
        (profile(), None), (profile(languages=[spoken]), None), (profile(languages=[spoken | {"level": 5}]), "invalid_item"), (profile(languages=[spoken | {"name": None}]), "invalid_item"),
        (profile(years_experience_total={"value": "4"}), None), (profile(years_experience_total={"value": 4.0}), None), (profile(years_experience_total={"value": 4.5}), "invalid_item"),
        (profile(years_experience_total={"value": "many"}), "invalid_item"), (profile(years_experience_total={"value": -1}), "invalid_item"), (profile(years_experience_total={"value": None}), None),
        (profile(candidate_constraints={"requires_visa_sponsorship": "yes"}), None), (profile(candidate_constraints={"requires_visa_sponsorship": "maybe"}), "invalid_item"),
        (profile(candidate_constraints={"requires_visa_sponsorship": 1}), None), (profile(candidate_constraints={"notes": "x"}), "invalid_item"), (profile(candidate_constraints={"notes": [None]}), "invalid_item"),
    ]
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "candidate_id int, payload string")
    assert [r.error for r in merge.checked_profiles(df).orderBy("candidate_id").collect()] == [e for _, e in cases]


def test_structural_reading(spark):
    tag = lambda key, value, more="": f'<b class="job-tag" title="{key}"{more}><i class="job-tag-value">{value}</i></b>'
    pages = {
        tag("Location", "A"): ({}, None), f"<div class='job-tags-wrapper x'><p>{tag('Location', 'A')}</div>{tag('Location', 'B')}": ({"location": "A"}, None),
        f"<div class=job-tags-wrapper>{tag('x', 'A', ' data-type= Y')}<b class=job-tag title=z><i></i></b></div>": ({"y": "A"}, None),
        f"<div class=job-tags-wrapper><div>{tag('k', 'a <b>b</b>c&eacute;&#33;<br>d<script>e</script>')}": ({"k": "a bcé! d"}, None),
        "<li><a>Jobs</a><a>Team</a></li><li><b>Team</b> <i>Core</i></li>": ({}, None), "<span>Team</span><div><div><b>Core</b> group</div></div>": ({}, "Core group"),
        "<ul><li><b>\n Team </b><li>next</ul>": ({}, None), "<ul><li><p><b>Team</b><p>x</ul>": ({}, None), "<div><b>Team</b>: <u>x</u> &amp;<!-- no --> y</div>z": ({}, "x & y"), "<div><b>Team</b>s</div><div><b>Team</b>: x</div>": ({}, "s"),
        "<div><b>team</b> x</div>": ({}, None), "<p title=it's><div><b>Team</b> x</div>": ({}, "x"), "<div><script>Team</script><b>Team</b> x": ({}, "x"), "": ({}, None), "<": ({}, None), None: (None, None),
    }
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").select("k", P.read_page(F.col("html"), {"team": "Team"}).alias("r"))
    assert [(r.r.tags, r.r.team) for r in df.orderBy("k").collect()][:-1] == list(pages.values())[:-1]


def test_broken_markup_takes_linear_time(spark):
    for piece in ("<div>", "<a ", "<div><p>a", "<!--", "<script>", "</x>", "<p title='", "<b class=\"job-tag job-tags-wrapper", "&#"):
        html = "<i class=job-tags-wrapper>Team</i>" + piece * (20_000 // len(piece))
        df = spark.createDataFrame([(html,)], "html string").select(P.read_page(F.col("html"), {"team": "Team"}).alias("r"))
        start = time.time()
        df.collect()
        assert time.time() - start < 20, piece


def test_json_ld_is_strict(spark):
    block = lambda x: f"<script type='application/ld+json'>{x}</script>"
    good = '{"@type":"JobPosting","employmentType":"B","jobLocation":{"address":{"addressLocality":"T","addressCountry":null}}}'
    pages = {
        block('{"@type":"JobPosting","employmentType":"A"} junk') + block(good): ("T", "None", "B"), block("{'@type':'JobPosting'}") + block(good): ("T", "None", "B"), block(f"[1, null, {good}]"): ("T", "None", "B"),
        block('{"@type":["JobPosting"]}') + block(good): ("T", "None", "B"), block('{"@type":"JobPosting","employmentType":["A","B"],"jobLocation":[1]}'): (None, None, "['A', 'B']"),
        block('{"@type":" jobposting ","employmentType":true,"jobLocation":{"address":"x"}}'): (None, None, "True"), block("5") + block('"x"'): (None, None, None),
    }
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").select("k", P.job_posting(F.col("html")).alias("r"))
    assert [tuple(r.r) for r in df.orderBy("k").collect()] == list(pages.values())


def _item(name="x", level="required", confidence=0.5, evidence=("e",), **more):
    return {"name": name, "requirement_level": level, "confidence": confidence, "evidence": list(evidence)} | more


def _payload(**parts):
    return json.dumps(dict.fromkeys(("skills", "languages", "protocols", "standards", "domains", "restrictions"), []) | {"seniority": {"value": None, "confidence": 0, "evidence": []}} | parts)


def test_payload_errors(spark):
    cases = [
        (_payload(), None), (_payload(skills=[_item()]), None), (_payload(skills=[_item(more=1)]), "item_fields"), (_payload(skills=[_item(evidence=(" ",))]), "invalid_item"),
        (_payload(restrictions=[{"value": "EU", "confidence": 1, "evidence": ["e"]}]), None), (_payload(restrictions=[{"value": "EU", "confidence": 1, "evidence": []}]), "invalid_item"),
        (_payload(restrictions=[{"value": " ", "confidence": 1, "evidence": ["e"]}]), "invalid_item"), (_payload(seniority={"value": "Lead ", "confidence": 1, "evidence": ["e"]}), None),
        (_payload(seniority={"value": "lead", "confidence": 1, "evidence": []}), "invalid_item"), (_payload(seniority={"value": "chief", "confidence": 1, "evidence": ["e"]}), "invalid_item"),
        (_payload() + " junk", "bad_json"), (_payload() + "{}", "bad_json"), (_payload().replace('"', "'"), "bad_json"), ("[" + _payload() + "]", "bad_json"), (_payload() + "]", "bad_json"),
        (_payload(skills=[_item(name=5)]), "invalid_item"), (_payload(skills=[_item(name=None)]), "invalid_item"), (_payload(skills=[_item(level=1)]), "invalid_item"), (_payload(skills=[_item(evidence=("e", 1))]), "invalid_item"),
        (_payload(skills=[_item(confidence="0.5 ")]), None), (_payload(skills=[_item(confidence=True)]), None), (_payload(skills=[_item(confidence=[1])]), "invalid_item"), (_payload(skills=[_item(confidence="x")]), "invalid_item"),
        (_payload(skills=["x"]), "item_fields"), (_payload(skills={}), "item_fields"), (_payload(seniority={"value": 3, "confidence": 1, "evidence": ["e"]}), "invalid_item"),
        (_payload(seniority=None), "item_fields"), (_payload(skills=None), "item_fields"), ("{", "bad_json"), ("{}", "missing_fields"), (_payload(other=1), "unknown_fields"), (None, "bad_json"),
    ]
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(cases)], "job_id int, payload string")
    assert [r.error for r in merge.checked_payloads(df).orderBy("job_id").collect()] == [e for _, e in cases]


def test_cleaned_constraints(spark):
    lists = "preferred_locations array<string>, excluded_locations array<string>, preferred_workplace_types array<string>, excluded_workplace_types array<string>"
    schema = f"{lists}, requires_visa_sponsorship boolean, avoid_export_control_roles boolean, notes array<string>, confidence string, evidence array<string>"
    df = spark.createDataFrame([([" A  b", "a B", ""], None, ["home office", "fully remote", ""], [], None, None, [], "0.5", [])], schema)
    c = merge.cleaned_constraints(F.struct("*"))
    row = df.select(c.alias("c"), merge.valid_constraints(c).alias("ok")).first()
    assert (row.c.preferred_locations, row.c.excluded_locations, row.c.preferred_workplace_types, row.ok) == (["A b"], [], ["Remote"], False)


def test_assembly(spark):
    recs = records.page_records(spark.createDataFrame([("u", PAGE, "T", ["a"])], "url string, html string, title string, disciplines array<string>"))
    body = _payload(
        skills=[_item(" C++ ", "preferred", 0.5, ["a"]), _item("c++", "required", 0.9, ["A", "b"])],
        restrictions=[{"value": v, "confidence": 1, "evidence": ["e"]} for v in ("EU citizens", "nationality")],
    )
    job = recs.first().job_id
    out = records.assembled_jobs(recs, spark.createDataFrame([(job, body), ("other", body)], "job_id string, payload string"))
    row = out.select("*", records.constraints_in_use(F.lit(None).cast(f"array<{records.CONSTRAINT}>"), F.col("job_constraints")).alias("used")).collect()
    assert len(row) == 1
    row = row[0]
    assert [tuple(x) for x in row.skills] == [("c++", "required", 0.9, ["a", "b"], "llm")]
    assert [(c.kind, c.value, c.min_years) for c in row.job_constraints] == [("feature", "c++", None), ("years_experience", None, 4), ("restriction", "citizenship", None)]
    assert [c.kind for c in row.used] == ["feature", "years_experience"]
    assert (row.seniority.value, row.seniority.source_kind, row.years_experience_requirement.source_kind) == (None, None, "regex_text")


def test_hard_filters(spark):
    named = "languages array<struct<name:string,requirement_level:string>>, restrictions array<struct<value:string>>"
    cases = [
        ("Embedded Internship", 1, ["dutch"], [], "hard_filter_exclude_job_type", ["job_type:internship"]),
        ("Engineer", 1, ["english", "dutch"], [], "hard_filter_required_language", ["required_language:dutch"]),
        ("Engineer", 8, [], [], "hard_filter_min_years_experience", ["min_years_experience:8"]),
        ("Engineer", 1, [], ["eligible for Dutch security clearance"], "hard_filter_export_control_clearance", ["restriction:export_control_or_security_clearance"]),
        ("Engineer", None, None, None, None, []),
    ]
    rows = [(k, t, y, l and [(x, "required") for x in l] + [("dutch", "preferred")], r and [(x,) for x in r]) for k, (t, y, l, r, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, title string, years int, {named}")
    met = publish.hard_filters(F.col("title"), publish.required_names(F.col("languages")), F.col("years"), publish.item_values(F.col("restrictions")))
    decided = publish.filtered_decision(met, publish.keyword_decision(F.col("title"), F.lit(""), [], ["engineer"], []))
    out = df.select("k", met.alias("m"), decided.alias("d")).orderBy("k").collect()
    assert [(r.m.reason, r.m.skip_hits) for r in out] == [(reason, hits) for *_, reason, hits in cases]
    assert [r.d.decision for r in out] == ["skip"] * 4 + ["keep"]
    assert publish.kept(df.select(decided.alias("d")).select("d.*")).count() == 1


def test_merged_evidence(spark):
    items = spark.createDataFrame([(1, "EU ", 2, 0.9, ["x"]), (1, "eu", 1, 0.5, ["y", "X"]), (1, "eu", 3, 0.1, None)], "k int, value string, pos int, confidence double, evidence array<string>")
    assert [tuple(r) for r in merge.merged_restrictions(items, ["k"]).collect()] == [(1, "eu", 0.9, 1, ["y", "X"])]
    langs = items.withColumnRenamed("value", "name").withColumn("level", F.lit("basic"))
    assert [tuple(r) for r in merge.merged_languages(langs, ["k"]).collect()] == [(1, "eu", "basic", 0.9, 1, ["y", "X"])]


def test_ids_must_not_be_blank(spark):
    df = spark.createDataFrame([("a", " ")], "c string, j string")
    for bad in (T.ranking_key(F.col("c"), F.col("j")), T.candidate_id(F.col("c"), F.col("j"))):
        with pytest.raises(Exception, match="must not be blank"):
            df.select(bad).collect()
    assert df.select(T.ranking_key(F.col("c"), F.col("c"))).first()[0] == "a_a"


def test_skips_limit_and_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 1, "ranking", "mismatch", 0.5, []), (1, 2, "job_must_have", "mismatch", 0.0, ["r", "s"]), (1, 3, "ranking", "match", 0.9, [])], "cand_key int, job_key int, stage string, status string, score double, reasons array<string>")
    assert [r.line for r in match.skip_explanations(pairs).orderBy("job_key").collect()] == ["score=0.500 < 0.600", "stage=job_must_have | reason=r"]
    assert [r.job_key for r in match.first_jobs(pairs, 2).collect()] == [1, 2]
    with pytest.raises(ValueError, match="1 or more"):
        match.first_jobs(pairs, 0)
    jobs = spark.createDataFrame([("a", "t"), ("b", "u")], "job_id string, title string")
    files.write_decisions(jobs, spark.createDataFrame([("a", "match")], "job_id string, status string"), str(tmp_path / "d"))
    files.write_decisions(jobs, spark.createDataFrame([("a", "mismatch")], "job_id string, status string"), str(tmp_path / "d"))
    assert [r.status for r in spark.read.parquet(str(tmp_path / "d")).collect()] == ["mismatch"]
    files.write_candidates(spark.createDataFrame([("c", 1)], "candidate_id string, n int"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first().candidate_id == "c"
    files.write_report(spark.createDataFrame([("x", 1)], "company_slug string, n int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().company_slug == "x"
    with pytest.raises(Exception, match="candidate_id is missing"):
        files.write_candidates(spark.createDataFrame([(" ", 1)], "candidate_id string, n int"), str(tmp_path / "e"))


def test_retrieval(spark):
    faceted = spark.createDataFrame([("f", "a"), ("g", "a")], "facet string, url string")
    found, report = collect.retrieved_links(faceted, spark.createDataFrame([("b",), ("a",)], "url string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", ["f", "g"]), ("b", [])]
    assert (report.first().left_count, report.first().right_count) == (1, 2)
    assert [r.url for r in collect.unfiltered_links(faceted).collect()] == ["a"]
