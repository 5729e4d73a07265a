"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

_BINDING = """
b_feat AS (
  SELECT l_orderkey, l_suppkey, l_linenumber AS pos, l_returnflag, l_discount,
    CASE WHEN l_linenumber IN (1,2) THEN 'skills' WHEN l_linenumber = 3 THEN 'protocols' WHEN l_linenumber = 4 THEN 'standards' WHEN l_linenumber = 5 THEN 'domains' ELSE 'languages' END AS bucket,
    CASE WHEN l_linenumber IN (1,2) THEN p_name WHEN l_linenumber = 3 THEN lower(p_type) WHEN l_linenumber = 4 THEN lower(p_brand) WHEN l_linenumber = 5 THEN split_part(p_name,' ',2) ELSE 'lang_' || (p_size % 6) END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
), jf AS (
  SELECT l_orderkey AS job_key, bucket, lower(name) AS name, pos, CASE l_returnflag WHEN 'R' THEN 'required' WHEN 'A' THEN 'preferred' END AS lvl, round(1 - 5 * l_discount, 4) AS conf
  FROM b_feat
), cf AS (
  SELECT l_suppkey AS cand_key, bucket, lower(name) AS name, round(max(1 - l_discount), 4) AS conf, count(*) AS n FROM b_feat GROUP BY l_suppkey, bucket, b_feat.name HAVING count(*) >= 2
), cq AS (
  SELECT cand_key, bucket, name, conf * CAST(CASE WHEN bucket = 'languages' THEN CASE WHEN n >= 12 THEN 1.0 WHEN n >= 6 THEN 0.9 WHEN n >= 3 THEN 0.75 ELSE 0.25 END
    ELSE CASE WHEN n >= 12 THEN 1.0 WHEN n >= 6 THEN 0.8 WHEN n >= 3 THEN 0.55 ELSE 0.25 END END AS DOUBLE) AS q FROM cf
), jobs AS (
  SELECT o_orderkey AS job_key, lower(n_name) AS location, CASE o_orderstatus WHEN 'F' THEN 'on-site' WHEN 'O' THEN 'hybrid' ELSE 'remote' END AS policy,
    CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS sen,
    CASE o_orderpriority WHEN '5-LOW' THEN 'junior' WHEN '3-MEDIUM' THEN 'medior' WHEN '2-HIGH' THEN 'senior' WHEN '1-URGENT' THEN 'lead' END AS sen_name,
    CAST(year(o_orderdate) % 8 AS INT) AS min_years, o_orderkey % 4 = 0 AS years_preferred,
o_orderkey % 37 = 0 AS r_cit, o_orderkey % 17 = 0 AS r_work, o_orderkey % 29 = 0 AS r_tech, CASE o_orderstatus WHEN 'F' THEN 'On-site' WHEN 'O' THEN 'Hybrid' ELSE 'Remote' END AS policy_label
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), cands AS (
  SELECT s_suppkey AS cand_key, CASE WHEN s_suppkey % 4 = 0 THEN lower(n_name) END AS wanted, s_suppkey % 7 = 3 AS bars, CASE s_suppkey % 6 WHEN 0 THEN 'junior' WHEN 1 THEN 'medior' WHEN 2 THEN 'senior' WHEN 3 THEN 'lead' WHEN 4 THEN 'principal' ELSE 'staff' END AS sen_own, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS visa,
    CASE WHEN s_suppkey % 6 = 4 THEN 5 WHEN s_suppkey % 6 = 5 THEN 6 ELSE s_suppkey % 6 + 1 END AS sen, CAST(s_suppkey % 12 AS INT) AS years,
    CASE s_suppkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS pref_w, CASE s_suppkey % 5 WHEN 0 THEN 'on-site' WHEN 1 THEN 'remote' END AS excl_w
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), ji AS (
  SELECT job_key, bucket, name, pos, coalesce(lvl, '') = 'required' AS req, CAST(CASE lvl WHEN 'required' THEN 1.0 WHEN 'preferred' THEN 0.6 ELSE 0 END AS DOUBLE) * greatest(0, least(1, conf)) AS imp FROM jf
), items AS (SELECT * FROM ji WHERE req OR imp > 0)
"""

_BUCKETS = ("skills", "languages", "protocols", "standards", "domains")
_WEIGHTS = {"skills": 0.40, "languages": 0.10, "protocols": 0.15, "standards": 0.10, "domains": 0.15, "seniority": 0.05, "years": 0.05}
_D = "DECIMAL(28,12)"


def _per_bucket(template: str) -> str:
    return ", ".join(template.format(b=b) for b in _BUCKETS)


#: The gates' reasons for one pair; r1 to r6 of the candidate's gate, s2 to s6 of the vacancy's, in the order in which they are listed.
_GATES = """CASE WHEN wanted IS NOT NULL AND NOT (contains(location, wanted) OR contains(wanted, location)) THEN 'preferred_location_not_matched' END AS r1,
    CASE WHEN bars AND location IN ('france', 'germany') THEN 'excluded_location_matched' END AS r2,
    CASE WHEN policy <> pref_w THEN 'preferred_workplace_type_not_matched' END AS r3, CASE WHEN policy = excl_w THEN 'excluded_workplace_type_matched' END AS r4,
    CASE WHEN visa AND r_cit THEN 'candidate_requires_visa_sponsorship' END AS r5, CASE WHEN visa AND r_work THEN 'candidate_requires_visa_sponsorship' END AS r6,
    CASE WHEN jobs.sen IS NOT NULL AND cands.sen < jobs.sen THEN 'seniority_not_satisfied' END AS s2,
    CASE WHEN NOT years_preferred AND years < min_years THEN 'years_experience_not_satisfied' END AS s3,
    CASE WHEN r_cit THEN 'citizenship_eligibility_unknown' END AS s4,
    CASE WHEN r_work THEN CASE WHEN visa IS NULL THEN 'work_authorization_unknown' WHEN visa THEN 'work_authorization_not_satisfied' END END AS s5,
    CASE WHEN r_tech THEN 'legal_eligibility_unknown' END AS s6"""

_EVALUATED = f"""
{_BINDING}, tot AS (
  SELECT job_key, count(DISTINCT bucket || '|' || name) FILTER (req) AS need, {_per_bucket("sum(CASE WHEN bucket = '{b}' THEN CAST(imp AS DECIMAL(28,12)) END) AS {b}_all")} FROM items GROUP BY job_key
), hit AS (
  SELECT cand_key, job_key, count(DISTINCT bucket || '|' || name) FILTER (req) AS have, {_per_bucket("sum(CASE WHEN bucket = '{b}' THEN CAST(imp * q AS DECIMAL(28,12)) END) AS {b}_sum")}
  FROM items JOIN cq USING (bucket, name) GROUP BY cand_key, job_key
), p0 AS (
  SELECT cands.cand_key, jobs.job_key, jobs.*, cands.*, {_per_bucket("coalesce(CAST({b}_sum AS DOUBLE) / nullif(CAST({b}_all AS DOUBLE), 0), 0) AS {b}_raw")},
    {_GATES},
    coalesce(need, 0) - coalesce(have, 0) AS lacking,
    CASE WHEN jobs.sen IS NULL THEN 0 WHEN cands.sen >= jobs.sen THEN 1 WHEN cands.sen = jobs.sen - 1 THEN 0.5 ELSE 0 END::DOUBLE * 0.9::DOUBLE * 0.9::DOUBLE AS seniority_raw,
    CASE WHEN min_years <= 0 THEN 0 ELSE least(1, years / min_years) END::DOUBLE * 0.9::DOUBLE * 0.9::DOUBLE AS years_raw
  FROM jobs CROSS JOIN cands LEFT JOIN tot ON tot.job_key = jobs.job_key LEFT JOIN hit ON hit.cand_key = cands.cand_key AND hit.job_key = jobs.job_key
), p1 AS (
  SELECT cand_key, job_key, [x for x in [r1, r2, r3, r4, r5, r6] if x is not null] AS a, list_concat([x for x in [CASE WHEN i <= lacking THEN 'required_feature_missing' END for i in range(1, 20)] if x is not null], [x for x in [s2, s3, s4, s5, s6] if x is not null]) AS b, {", ".join(f"round({b}_raw + 1e-10::DOUBLE, 6) AS {b}_r" for b in _WEIGHTS)} FROM p0
), p2 AS (
  SELECT *, CASE WHEN len(a) > 0 THEN 'candidate_must_have' WHEN len(b) > 0 THEN 'job_must_have' ELSE 'ranking' END AS stage FROM p1
), p3 AS (
  SELECT cand_key, job_key, a, b, stage, {", ".join(f"CASE WHEN stage = 'ranking' THEN {b}_r ELSE 0 END AS {b}_score" for b in _WEIGHTS)} FROM p2
), p4 AS (
  SELECT *, CAST(round({" + ".join(f"CAST({w} AS DECIMAL(3,2)) * CAST({b}_score AS DECIMAL(8,6))" for b, w in _WEIGHTS.items())}, 6) AS DOUBLE) AS score FROM p3
), ev AS (
  SELECT *, CASE WHEN stage = 'ranking' AND score >= 0.6::DOUBLE THEN 'match' ELSE 'mismatch' END AS status,
    CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN stage = 'ranking' AND score >= 0.6::DOUBLE THEN [] ELSE ['score_below_threshold'] END AS reasons FROM p4
)
"""

_RANKED = f"WITH {_EVALUATED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cand_key ORDER BY status, CASE WHEN status = 'match' THEN -score ELSE 0 END, job_key) AS place FROM ev)"
_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_ITEMS = """
fi AS (
  SELECT l_orderkey AS job_key, CASE WHEN l_linenumber IN (1,2) THEN 'skills' WHEN l_linenumber = 3 THEN 'protocols' WHEN l_linenumber = 4 THEN 'standards' WHEN l_linenumber = 5 THEN 'domains' ELSE 'languages' END AS bucket,
    lower(CASE WHEN l_linenumber IN (1,2) THEN p_name WHEN l_linenumber = 3 THEN p_type WHEN l_linenumber = 4 THEN p_brand WHEN l_linenumber = 5 THEN split_part(p_name,' ',2) ELSE 'lang_' || (p_size % 6) END) AS name,
    l_linenumber * 1000000 + l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS req, round(1 - l_discount, 4) AS confidence, l_returnflag, CAST(l_quantity AS INT) % 4 AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""
_CONSTRAINTS = f"""
{_BINDING}, cons AS (
  SELECT DISTINCT job_key, 'feature' AS kind, bucket, name AS value, CAST(NULL AS INT) AS min_years FROM jf WHERE lvl = 'required'
  UNION ALL SELECT job_key, 'seniority', 'seniority', sen_name, NULL FROM jobs WHERE sen IS NOT NULL
  UNION ALL SELECT job_key, 'years_experience', 'years_experience', NULL, min_years FROM jobs WHERE NOT years_preferred
  UNION ALL SELECT job_key, 'restriction', 'restrictions', unnest([x for x in [CASE WHEN r_cit THEN 'citizenship' END, CASE WHEN r_work THEN 'work_authorization' END, CASE WHEN r_tech THEN 'controlled_technology' END] if x is not null]), NULL FROM jobs
)
"""
_LINKS = "links AS (SELECT event_type AS facet, 'https://jobs.example.com/' || user_id AS url, user_id, event_id, ts FROM events)"
_SENTENCE = """
s AS (
  SELECT o_orderkey, o_orderkey % 9 + 1 AS a, o_orderkey % 9 + 4 AS b, o_orderkey % 5 AS m, o_orderkey % 3 AS h FROM orders
)
"""
_SNAPSHOTS = """
o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS o_totalprice, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 5 <> 0)
"""


_PAGES = r"""
pg AS (SELECT page_id AS m, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, 'vacancy_' || page_id || '__' || substr(sha1(url), 1, 10) AS job_id FROM pages)
"""
_CONSTRAINED = f"""
{_PAGES}, dc AS (SELECT job_id, m, lower(coalesce(source, 'none')) AS source, lower(coalesce(lang, 'none')) AS lang FROM pg JOIN documents ON doc_id = m), cs AS (
  SELECT *, CASE WHEN m % 2 = 1 THEN 'feature:' || source END AS c1, CASE WHEN m % 3 = 0 THEN 'feature:' || lang END AS c2, CASE WHEN m % 4 = 0 THEN 'seniority:senior' END AS c3,
    CASE WHEN m % 2 = 0 THEN 'years_experience:' || (m % 9 + 1) END AS c4, CASE WHEN m % 5 = 0 THEN 'restriction:citizenship' END AS c5 FROM dc)
"""


def _hits(words: list[str], text: str) -> str:
    return "[x for x in [" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), '(^|[^\\pL\\pM\\pN_]){w}([^\\pL\\pM\\pN_]|$)') THEN '{w}' END" for w in words) + "] if x is not null]"


_SQL = {
    "match_scores": f"WITH {_EVALUATED} SELECT cand_key, job_key, stage, status, score, {', '.join(f'{b}_score' for b in _WEIGHTS)}, coalesce(reasons[1], 'none') AS first_reason FROM ev",
    "match_reasons": f"WITH {_EVALUATED}, r AS (SELECT cand_key, job_key, unnest(reasons) AS reason, generate_subscripts(reasons, 1) - 1 AS seq FROM ev) SELECT cand_key, CAST(seq AS INT) AS seq, reason, count(*) AS jobs FROM r GROUP BY ALL",
    "match_details": f"""WITH {_EVALUATED}, s AS (SELECT p0.*, stage FROM p0 JOIN ev USING (cand_key, job_key)), d AS (
      SELECT cand_key, stage, 'location' AS bucket, r1 AS reason, wanted AS expected, location AS actual FROM s WHERE r1 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'location', r2, location, location FROM s WHERE r2 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'workplace_type', r3, pref_w, policy_label FROM s WHERE r3 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'workplace_type', r4, policy_label, policy_label FROM s WHERE r4 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'restrictions', r5, 'citizenship', 'candidate requires visa sponsorship' FROM s WHERE r5 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'restrictions', r6, 'work_authorization', 'candidate requires visa sponsorship' FROM s WHERE r6 IS NOT NULL
      UNION ALL SELECT s.cand_key, stage, n.bucket, 'required_feature_missing', n.name, NULL FROM s JOIN (SELECT DISTINCT job_key, bucket, name FROM items WHERE req) n ON n.job_key = s.job_key
        LEFT JOIN cq ON cq.cand_key = s.cand_key AND cq.bucket = n.bucket AND cq.name = n.name WHERE stage = 'job_must_have' AND cq.cand_key IS NULL
      UNION ALL SELECT cand_key, stage, 'seniority', s2, sen_name, sen_own FROM s WHERE stage = 'job_must_have' AND s2 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'years_experience', s3, CAST(min_years AS VARCHAR), CAST(years AS VARCHAR) FROM s WHERE stage = 'job_must_have' AND s3 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'restrictions', s4, 'citizenship', NULL FROM s WHERE stage = 'job_must_have' AND s4 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'restrictions', s5, 'work_authorization', CASE WHEN visa THEN 'candidate requires visa sponsorship' END FROM s WHERE stage = 'job_must_have' AND s5 IS NOT NULL
      UNION ALL SELECT cand_key, stage, 'restrictions', s6, 'controlled_technology', NULL FROM s WHERE stage = 'job_must_have' AND s6 IS NOT NULL)
      SELECT stage, bucket, reason, coalesce(expected, '-') AS expected, coalesce(actual, '-') AS actual, count(*) AS pairs, min(cand_key) AS first_candidate FROM d GROUP BY ALL""",
    "only_matches": f"WITH {_EVALUATED} SELECT cand_key, job_key, score, {', '.join(f'{b}_score' for b in _WEIGHTS)} FROM ev WHERE status = 'match'",
    "rank_jobs": f"{_RANKED} SELECT cand_key, job_key, stage, status, score, CAST(place AS INT) AS place FROM ranked",
    "topk_matches": f"{_RANKED} SELECT cand_key, CAST(place AS INT) AS place, job_key, score FROM ranked WHERE status = 'match' AND place <= 3",
    "rank_summary": f"WITH {_EVALUATED} SELECT stage, status, count(*) AS pairs, count(DISTINCT cand_key) AS candidates, count(DISTINCT job_key) AS jobs, max(score) AS best FROM ev GROUP BY ALL",
    "match_explain": f"WITH {_EVALUATED} SELECT ev.cand_key, ev.job_key, i.bucket, i.pos, i.name, round(i.imp, 6) AS importance, round(q, 6) AS quality, q IS NOT NULL AS matched FROM ev JOIN items i ON i.job_key = ev.job_key AND imp > 0 LEFT JOIN cq ON cq.cand_key = ev.cand_key AND cq.bucket = i.bucket AND cq.name = i.name WHERE status = 'match'",
    "match_levels": f"""WITH {_EVALUATED}, s AS (SELECT p0.* FROM p0 JOIN ev USING (cand_key, job_key) WHERE status = 'match')
      SELECT cand_key, job_key, 'seniority' AS bucket, sen_name AS job_value, CASE WHEN seniority_raw > 0 THEN sen_own END AS candidate_value, CASE WHEN seniority_raw > 0 THEN round(seniority_raw + 1e-10::DOUBLE, 6) END AS score, seniority_raw > 0 AS matched
      FROM s WHERE sen IS NOT NULL
      UNION ALL SELECT cand_key, job_key, 'years_experience', min_years::VARCHAR, years::VARCHAR, round(years_raw + 1e-10::DOUBLE, 6), true FROM s WHERE min_years > 0""",
    "stored_constraint_reasons": f"""WITH {_EVALUATED.replace("[s2, s3,", "[CASE WHEN policy <> 'on-site' THEN s2 END, s3,")}, r AS (SELECT cand_key, job_key, unnest(reasons) AS reason, generate_subscripts(reasons, 1) - 1 AS seq FROM ev)
      SELECT cand_key, CAST(seq AS INT) AS seq, reason, count(*) AS jobs FROM r GROUP BY ALL""",
    "ranking_upsert": f"WITH {_EVALUATED} SELECT cand_key, CASE WHEN stage = 'ranking' AND score >= CASE WHEN policy = 'hybrid' THEN 0.7 ELSE 0.6 END::DOUBLE THEN 'match' ELSE 'mismatch' END AS status, count(*) AS jobs FROM ev JOIN jobs USING (job_key) GROUP BY ALL",
    "keyed_rankings": """SELECT o_orderpriority AS company_slug, o_custkey::VARCHAR AS candidate_id, o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 200000 THEN 'match' ELSE 'mismatch' END AS status,
      o_totalprice::DOUBLE AS price, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END::INTEGER AS again FROM orders WHERE o_orderstatus <> 'P'""",
    "job_constraints": f"WITH {_CONSTRAINTS} SELECT job_key, kind, bucket, count(*) AS n, min(value) AS least, min(min_years) AS min_years FROM cons GROUP BY job_key, kind, bucket",
    "derived_constraints": f"WITH {_CONSTRAINTS} SELECT kind, count(*) AS n, count(DISTINCT job_key) AS jobs FROM cons WHERE kind <> 'restriction' AND coalesce(min_years, 1) > 0 GROUP BY kind",
    "location_gate": f"WITH {_BINDING}, g AS (SELECT cand_key, {_GATES} FROM jobs, cands), u AS (SELECT cand_key, unnest(CASE WHEN len(l) = 0 THEN ['pass'] ELSE l END) AS reason FROM (SELECT cand_key, [x for x in [r1, r2] if x is not null] AS l FROM g)) SELECT cand_key, reason, count(*) AS jobs FROM u GROUP BY ALL",
    "workplace_gate": f"WITH {_BINDING}, g AS (SELECT cand_key, {_GATES} FROM jobs, cands), u AS (SELECT cand_key, unnest(CASE WHEN len(l) = 0 THEN ['pass'] ELSE l END) AS reason FROM (SELECT cand_key, [x for x in [r3, r4] if x is not null] AS l FROM g)) SELECT cand_key, reason, count(*) AS jobs FROM u GROUP BY ALL",
    "restriction_gate": f"WITH {_BINDING}, g AS (SELECT cand_key, {_GATES} FROM jobs, cands), u AS (SELECT cand_key, unnest(CASE WHEN len(l) = 0 THEN ['pass'] ELSE l END) AS reason FROM (SELECT cand_key, [x for x in [s4, s5, s6] if x is not null] AS l FROM g)) SELECT cand_key, reason, count(*) AS jobs FROM u GROUP BY ALL",
    "seniority_years_gate": f"WITH {_BINDING}, g AS (SELECT cand_key, {_GATES} FROM jobs, cands), u AS (SELECT cand_key, unnest(CASE WHEN len(l) = 0 THEN ['pass'] ELSE l END) AS reason FROM (SELECT cand_key, [x for x in [s2, s3] if x is not null] AS l FROM g)) SELECT cand_key, reason, count(*) AS jobs FROM u GROUP BY ALL",
    "required_gate": f"WITH {_BINDING}, need AS (SELECT DISTINCT job_key, bucket, name FROM items WHERE req), n AS (SELECT job_key, count(*) AS n FROM need GROUP BY 1), h AS (SELECT cand_key, job_key, count(*) AS m FROM need JOIN cq USING (bucket, name) GROUP BY ALL), ok AS (SELECT cand_key, count(*) AS k FROM h JOIN n USING (job_key) WHERE m = n GROUP BY 1), t AS (SELECT count(*) AS jobs, (SELECT count(*) FROM n) AS asking FROM jobs) SELECT cand_key, coalesce(k, 0) + jobs - asking AS covered, asking - coalesce(k, 0) AS not_covered FROM cands CROSS JOIN t LEFT JOIN ok USING (cand_key)",
    "normalize_texts": f"SELECT conv_id, turn, {_NORM.format('text')} AS text, lower({_NORM.format('role')}) AS role FROM conversations",
    "normalize_dedupe": "SELECT p_partkey, array_to_string([x for x in [p_name, CASE WHEN lower(p_type) <> lower(p_name) THEN p_type END, CASE WHEN lower(p_brand) NOT IN (lower(p_name), lower(p_type)) THEN p_brand END] if x is not null], '|') AS names FROM part",
    "job_identity": r"SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'job') || '__' || substr(sha1(url), 1, 10) AS job_id FROM pages",
    "content_hash_reuse": "WITH t AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, 'candidate_' || substr(h, 1, 12) AS candidate_id, h AS source_text_hash, CASE WHEN h IN (SELECT h FROM t WHERE doc_id % 2 = 0) THEN 'reused' ELSE 'pending' END AS state FROM t WHERE doc_id % 2 = 1",
    "confidence_cleaning": "WITH k AS (SELECT event_id, value, try_cast('0.' || regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events) SELECT event_id, CASE WHEN k BETWEEN 0 AND 1 THEN round(k, 4) END AS parsed, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(value / 50, 0))) AS clamped FROM k",
    "workplace_policy": """WITH r AS (SELECT p_partkey, (['Hybrid working', 'home office', 'fully REMOTE', 'On-site', 'Head office', 'Abroad'])[p_size % 6 + 1] AS l, CASE p_partkey % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'On-site' END AS d, p_size % 6 AS m FROM part)
      SELECT p_partkey, CASE m WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Remote' WHEN 3 THEN 'On-site' WHEN 4 THEN 'On-site' ELSE l END AS workplace,
        coalesce(CASE WHEN p_partkey % 2 = 0 THEN CASE m WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'On-site' WHEN 2 THEN 'Remote' WHEN 3 THEN 'On-site' WHEN 4 THEN 'On-site' END END, d, 'none') AS policy FROM r""",
    "page_fields": rf"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a, regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|\z)', 1) AS b FROM pages)
      SELECT page_id, nullif({_NORM.format("regexp_replace(h, '(?s)<[^>]*>', ' ', 'g')")}, '') AS title,
        greatest(length({_NORM.format("regexp_replace(regexp_replace(a, '(?is)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")}), length({_NORM.format("regexp_replace(regexp_replace(b, '(?is)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")})) > 200 AS has_description FROM t""",
    "experience_hours": f"WITH {_SENTENCE} SELECT o_orderkey, CAST(CASE WHEN m < 4 THEN a END AS INT) AS years_low, CAST(CASE m WHEN 0 THEN b WHEN 3 THEN a END AS INT) AS years_high, CAST(CASE h WHEN 0 THEN 32 WHEN 1 THEN 40 END AS INT) AS hours_low, CAST(CASE h WHEN 0 THEN o_orderkey % 9 + 33 WHEN 1 THEN 40 END AS INT) AS hours_high FROM s",
    "degrees_domains": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Master|Bachelor' WHEN 1 THEN 'PhD|Secondary vocational education' ELSE 'Bachelor' END AS degrees,
      CASE WHEN p_size % 3 = 0 THEN 'Medical' || CASE WHEN p_partkey % 4 < 3 THEN '|' ELSE '' END ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN 'High-tech|Semiconductor' WHEN 1 THEN 'Analytical|Defense' WHEN 2 THEN 'Energy|Aerospace' ELSE '' END AS domains FROM part""",
    "recruiter_contact": rf"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS s FROM documents), e AS (SELECT doc_id, s, nullif(regexp_extract(s, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b'), '') AS email FROM t),
      w AS (SELECT *, instr(s, email) AS p FROM e WHERE email IS NOT NULL)
      SELECT doc_id, email, nullif(regexp_extract(trim(substr(s, greatest(1, p - 240), p + length(email) - greatest(1, p - 240))), '\+\d[\d ()-]{{6,}}\d'), '') AS phone FROM w""",
    "restriction_class": "SELECT o_orderkey, (['citizenship', 'controlled_technology', 'controlled_technology', 'work_authorization', 'restriction', 'restriction'])[o_orderkey % 6 + 1] AS restriction, (['required', 'required', 'required', 'preferred', 'required', 'unknown'])[o_orderkey % 6 + 1] AS level FROM orders",
    "link_harvest": """WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages), u AS (SELECT DISTINCT CASE WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h WHEN h LIKE '/%' THEN 'https://jobs.example.com' || h ELSE 'https://jobs.example.com/' || h END AS url FROM l)
      SELECT url FROM u WHERE regexp_matches(url, '^https://jobs\\.example\\.com/[A-Za-z]+$')""",
    "discipline_map": f"WITH {_LINKS} SELECT url, string_agg(DISTINCT facet, '|' ORDER BY facet) AS disciplines FROM links GROUP BY url",
    "facet_completeness": f"WITH {_LINKS} SELECT facet, count(DISTINCT CASE WHEN user_id % 7 <> 0 THEN url END) AS collected, count(DISTINCT url) AS expected, count(DISTINCT CASE WHEN user_id % 7 <> 0 THEN url END) >= count(DISTINCT url) AS complete FROM links GROUP BY facet",
    "collection_limit": f"""WITH RECURSIVE {_LINKS}, f AS (SELECT facet, dense_rank() OVER (ORDER BY facet) AS no, url, min(event_id) AS p FROM links GROUP BY facet, url),
      l AS (SELECT no, facet, list(url ORDER BY p, url) AS urls FROM f GROUP BY no, facet),
      fold AS (SELECT CAST(0 AS BIGINT) AS no, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS taken, '' AS facet
        UNION ALL SELECT l.no, list_distinct(list_concat(kept, urls[1:greatest(0, 40 - len(kept))])), urls[1:greatest(0, 40 - len(kept))], l.facet FROM fold JOIN l ON l.no = fold.no + 1),
      t AS (SELECT facet, unnest(taken) AS url FROM fold)
      SELECT url, string_agg(DISTINCT facet, '|' ORDER BY facet) AS disciplines FROM t GROUP BY url""",
    "collection_validation": f"""WITH {_LINKS}, a AS (SELECT DISTINCT url FROM links WHERE event_id % 2 = 0 AND user_id % 11 <> 0), b AS (SELECT DISTINCT url FROM links WHERE event_id % 2 = 1 AND user_id % 13 <> 0), x AS (SELECT url FROM a EXCEPT SELECT url FROM b), y AS (SELECT url FROM b EXCEPT SELECT url FROM a)
      SELECT (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count, (SELECT count(*) FROM x) AS only_left_count, (SELECT count(*) FROM y) AS only_right_count,
        coalesce((SELECT string_agg(url, ',' ORDER BY url) FROM x), '') AS only_left, coalesce((SELECT string_agg(url, ',' ORDER BY url) FROM y), '') AS only_right, NOT EXISTS (FROM x) AND NOT EXISTS (FROM y) AS equal""",
    "page_new_links": f"""WITH {_LINKS}, p AS (SELECT facet AS context, dayofyear(ts) AS page, url FROM links), f AS (SELECT context, url, min(page) AS page FROM p GROUP BY ALL), d AS (SELECT DISTINCT context, page FROM p),
      c AS (SELECT d.context, d.page, count(f.url) AS new_links FROM d LEFT JOIN f ON f.context = d.context AND f.page = d.page GROUP BY ALL)
      SELECT context, CAST(page AS INT) AS page, new_links, CAST(sum(new_links) OVER (PARTITION BY context ORDER BY page) AS BIGINT) AS total_links FROM c""",
    "merge_job_features": f"WITH {_ITEMS} SELECT job_key, bucket, name, CASE WHEN max(req) = 1 THEN 'required' ELSE 'preferred' END AS requirement, max(confidence) AS confidence, min(pos) AS pos, CAST(count(DISTINCT l_returnflag) AS INT) AS n_evidence FROM fi GROUP BY job_key, bucket, name",
    "merge_candidate_features": f"WITH {_ITEMS} SELECT bucket, name, (['exposure', 'secondary', 'strong', 'core'])[max(q) + 1] AS strength, max(confidence) AS confidence FROM fi GROUP BY bucket, name",
    "merge_restrictions": f"WITH {_ITEMS} SELECT job_key, 'limit ' || q AS value, max(confidence) AS confidence, min(pos) AS pos FROM fi GROUP BY job_key, q",
    "merge_languages": f"""WITH RECURSIVE {_ITEMS}, i AS (SELECT job_key, name, (['basic', 'fluent', 'native'])[q] AS level, confidence, pos * 100 + q AS pos, row_number() OVER (PARTITION BY job_key, name ORDER BY pos * 100 + q, (['basic', 'fluent', 'native'])[q] NULLS FIRST, confidence) AS k FROM fi WHERE bucket = 'languages'),
      fold AS (SELECT job_key, name, level, confidence, pos, k FROM i WHERE k = 1 UNION ALL
        SELECT f.job_key, f.name, CASE WHEN i.confidence > f.confidence THEN coalesce(i.level, f.level) ELSE coalesce(f.level, i.level) END, greatest(f.confidence, i.confidence), f.pos, i.k FROM fold f JOIN i ON i.job_key = f.job_key AND i.name = f.name AND i.k = f.k + 1)
      SELECT job_key, name, arg_max(coalesce(level, ''), k) AS level, arg_max(confidence, k) AS confidence, min(pos) AS pos FROM fold GROUP BY job_key, name""",
    "validate_payloads": """WITH t AS (
      SELECT event_id AS k, '{"skills":[{"name":' || CASE WHEN event_id % 19 = 0 THEN user_id::VARCHAR ELSE '"x' || user_id || '"' END || ',"requirement_level":"' || CASE WHEN event_id % 7 = 0 THEN 'maybe' ELSE 'required' END
        || '","confidence":"' || CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE '0.5' END || '","evidence":["e"' || CASE WHEN event_id % 23 = 0 THEN ',1' ELSE '' END
        || ']}],"languages":[],"protocols":[],"standards":[],"domains":[],"restrictions":[]' || CASE WHEN event_id % 11 = 0 THEN '}' WHEN event_id % 13 = 0 THEN ',"seniority":{"value":null,"confidence":0,"evidence":[]},"extra":1}'
        WHEN event_id % 17 = 0 THEN ',"seniority":' ELSE ',"seniority":{"value":null,"confidence":0,"evidence":[]}}' END || CASE WHEN event_id % 29 = 0 THEN ' {}' ELSE '' END AS p FROM events),
      q AS (SELECT k, CASE WHEN k % 31 = 0 THEN replace(p, '"', chr(39)) ELSE p END AS p FROM t), j AS (SELECT k, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM q),
      f AS (SELECT k, j, list_sort(json_keys(j)) AS own, list_sort(['skills', 'languages', 'protocols', 'standards', 'domains', 'restrictions', 'seniority']) AS asked, j->'$.skills[0]' AS x FROM j),
      e AS (SELECT k AS event_id, CASE WHEN j IS NULL THEN 'bad_json' WHEN len(list_filter(asked, lambda a: NOT list_contains(own, a))) > 0 THEN 'missing_fields' WHEN own <> asked THEN 'unknown_fields'
        WHEN json_type(x, '$.name') <> 'VARCHAR' OR x->>'$.requirement_level' NOT IN ('required', 'preferred') OR (x->>'$.confidence')::DOUBLE NOT BETWEEN 0 AND 1
          OR len(list_filter(json_extract(x, '$.evidence[*]'), lambda v: json_type(v) <> 'VARCHAR')) > 0 THEN 'invalid_item' ELSE 'valid' END AS error FROM f)
      SELECT error, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY error""",
    "snapshot_diff": f"WITH {_SNAPSHOTS} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'shared' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey",
    "new_fields": f"WITH {_SNAPSHOTS} SELECT 'o_custkey' AS field, count(o_custkey) AS filled FROM n",
    "field_change_freq": f"""WITH {_SNAPSHOTS}, b AS (SELECT count(*) AS t, count(*) FILTER (o.o_orderstatus IS DISTINCT FROM n.o_orderstatus) AS c1, count(*) FILTER (o.o_totalprice IS DISTINCT FROM n.o_totalprice) AS c2, count(*) FILTER (o.o_orderpriority IS DISTINCT FROM n.o_orderpriority) AS c3 FROM o JOIN n ON o.o_orderkey = n.o_orderkey)
      SELECT 'o_orderstatus' AS field, c1 AS changed, t AS total FROM b UNION ALL SELECT 'o_totalprice', c2, t FROM b UNION ALL SELECT 'o_orderpriority', c3, t FROM b""",
    "keyword_filter": f"""WITH h AS (SELECT doc_id, {_hits(['license', 'stupid'], 'text')} AS skip, {_hits(['src3', 'src7'], 'source')} AS t, {_hits(['the', 'der', 'apache', 'est'], 'text')} AS d FROM documents),
      r AS (SELECT *, CASE WHEN len(skip) > 0 THEN 'hard_filter' WHEN len(t) > 0 THEN 'title_keep_match' WHEN len(d) >= 2 THEN 'description_keep_match' ELSE 'insufficient_keep_signal' END AS reason FROM h)
      SELECT doc_id, CASE WHEN reason IN ('title_keep_match', 'description_keep_match') THEN 'keep' ELSE 'skip' END AS decision, reason, CASE WHEN reason = 'insufficient_keep_signal' THEN '' ELSE array_to_string(t, '|') END AS title_hits,
        CASE WHEN reason = 'insufficient_keep_signal' THEN '' ELSE array_to_string(d, '|') END AS description_hits, array_to_string(skip, '|') AS skip_hits FROM r""",
    "hard_filters": """WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS s FROM customer),
      f AS (SELECT *, CASE WHEN k % 7 = 0 OR k % 17 = 0 THEN 'exclude_job_type' WHEN k % 10 = 0 THEN 'required_language' WHEN k % 11 > 7 THEN 'min_years_experience' WHEN k % 13 = 0 THEN 'export_control_clearance' END AS h FROM c)
      SELECT k AS c_custkey, CASE WHEN h IS NULL THEN 'keep' ELSE 'skip' END AS decision, CASE WHEN h IS NOT NULL THEN 'hard_filter_' || h WHEN s IN ('machinery', 'building') THEN 'title_keep_match' ELSE 'description_keep_match' END AS reason,
        CASE WHEN h IS NULL AND s IN ('machinery', 'building') THEN s ELSE '' END AS title_hits,
        CASE h WHEN 'exclude_job_type' THEN 'job_type:' || CASE WHEN k % 7 = 0 THEN 'internship' ELSE 'graduation' END WHEN 'required_language' THEN 'required_language:dutch' WHEN 'min_years_experience' THEN 'min_years_experience:' || (k % 11)
          WHEN 'export_control_clearance' THEN 'restriction:export_control_or_security_clearance' ELSE '' END AS skip_hits FROM f""",
    "page_metadata": f"""WITH {_PAGES} SELECT m AS page_id, CASE WHEN m % 3 <> 0 THEN host WHEN m % 7 > 1 THEN 'Site ' || (m % 13) END AS location, CASE WHEN m % 7 > 1 THEN 'NL' END AS country,
      CASE WHEN m % 4 = 0 THEN 'Master' END AS educational_background, CASE WHEN m % 5 = 0 THEN 'Full time' WHEN m % 7 > 1 THEN 'FULL_TIME' END AS fulltime_parttime FROM pg""",
    "page_records": f"""WITH {_PAGES} SELECT job_id, url, 'Vacancy ' || m AS title, 'ai|software' AS disciplines, CASE WHEN m % 3 <> 0 THEN host WHEN m % 7 > 1 THEN 'Site ' || (m % 13) END AS location,
      CASE WHEN m % 12 = 1 THEN 'Team ' || host END AS team, CASE WHEN m % 2 = 0 THEN (m % 9 + 1) || ' - ' || (m % 9 + 3) || ' years' END AS work_experience, CASE WHEN m % 2 = 0 THEN CAST(m % 9 + 1 AS INT) END AS min_years_experience,
      CASE WHEN m % 2 = 0 THEN CAST(m % 9 + 3 AS INT) END AS max_years_experience, CASE WHEN m % 4 = 0 THEN 'Master|Bachelor' ELSE 'Bachelor' END AS degrees, 'Semiconductor|Medical' AS domains, CAST(m % 9 + 24 AS INT) AS min_hours_per_week,
      40 AS max_hours_per_week, 'Hybrid' AS remote_policy, 'From our office and at our clients'' sites' AS work_locations_text, true AS client_site_required, 'North region' AS travel_region FROM pg""",
    "assembled_jobs": f"""WITH {_CONSTRAINED} SELECT job_id, 1 AS skills, source AS skill, CASE WHEN m % 2 = 1 THEN 'required' ELSE 'preferred' END AS level, lang AS evidence, 'llm' AS source_kind,
      CASE WHEN m % 4 = 0 THEN 'llm' END AS seniority_source, CASE WHEN m % 2 = 0 THEN 0.9 ELSE 0 END::DOUBLE AS years_confidence, array_to_string([x for x in [c1, c2, c3, c4, c5] if x is not null], '|') AS constraints FROM cs""",
    "constraint_source": f"WITH {_CONSTRAINED} SELECT job_id, array_to_string([x for x in [c1, c2, c3, c4, CASE WHEN regexp_matches(job_id, '[0-9]$') THEN c5 END] if x is not null], '|') AS constraints FROM cs",
    "requirement_lines": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|You have ' || p_type || '|You are fluent in Dutch and English' ELSE p_name || ' skills' END AS required_lines,
      CASE WHEN p_partkey % 3 = 0 THEN 'Knowledge of German is a plus' ELSE p_type || ' would be nice|Fluent English, preferably French and English' END AS preferred_lines,
      CASE WHEN p_partkey % 3 = 0 THEN 'Dutch|English' ELSE '' END AS required_languages, CASE WHEN p_partkey % 3 = 0 THEN 'German' ELSE 'English|French' END AS preferred_languages FROM part""",
    "validate_profiles": """SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'bad_json' WHEN c_custkey % 19 = 0 THEN 'unknown_fields' WHEN c_custkey % 23 = 0 THEN 'item_fields'
      WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 2 = 1) THEN 'invalid_item' ELSE 'valid' END AS error FROM customer""",
    "retrieved_links": f"WITH {_LINKS} SELECT url, coalesce(string_agg(DISTINCT CASE WHEN user_id % 7 <> 0 THEN facet END, '|' ORDER BY CASE WHEN user_id % 7 <> 0 THEN facet END), '') AS disciplines FROM links WHERE user_id % 7 <> 0 OR user_id % 5 <> 0 GROUP BY url",
    "skip_explanations": f"WITH {_EVALUATED}, s AS (SELECT cand_key, CASE WHEN stage = 'ranking' THEN 'score < 0.600' ELSE 'stage=' || stage || ' | reason=' || coalesce(reasons[1], 'unknown') END AS line FROM ev WHERE status <> 'match') SELECT cand_key, line, count(*) AS jobs FROM s GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
