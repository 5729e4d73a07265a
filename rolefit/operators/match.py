"""Match of candidates and vacancies: hard gates with reasons, seven-bucket score, decision and ranking.

Tables: candidates (cand_key, candidate_id, preferred_locations, excluded_locations, preferred_workplaces, excluded_workplaces, requires_visa_sponsorship,
avoid_export_control_roles, seniority, seniority_confidence, years, years_confidence), candidate features (cand_key, bucket, name, strength or level,
confidence), jobs (job_key, job_id, location, remote_policy, workplace_type, seniority, seniority_confidence, min_years, years_level, years_confidence,
restrictions) and job features (job_key, bucket, name, pos, requirement_level, confidence). A list may also be a single value in a column of the
singular name (preferred_location, restriction, ...), or missing. Wide columns never enter the pairs: a pair is two keys, small attributes and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rolefit.functions import weights as W
from rolefit.functions.text import clamped_confidence, contains_match, label_or_null, name_or_empty

#: Candidates up to which they are broadcast to the vacancies; beyond, all pairs are a plain product, and single attributes meet by merge joins.
BROADCAST_CANDIDATES = 200_000


def candidate_index(features: DataFrame) -> DataFrame:
    """(cand_key, bucket, name, quality): the best item of each name, by weight, confidence, then place; blank names are dropped."""
    spoken = F.col("level") if "level" in features.columns else F.element_at(F.create_map(*(F.lit(x) for pair in W.LANGUAGE_OF_STRENGTH.items() for x in pair)), F.lower(F.trim("strength")))
    level = F.when(F.col("bucket") == "languages", W.lookup(W.LANGUAGE_LEVEL, spoken)).otherwise(W.lookup(W.STRENGTH, F.col("strength")))
    named = features.select("cand_key", "bucket", name_or_empty(F.col("name")).alias("name"), level.alias("weight"), clamped_confidence(F.col("confidence")).alias("confidence")).where("name <> ''")
    best = named.groupBy("cand_key", "bucket", "name").agg(F.max(F.struct("weight", "confidence")).alias("best"))
    return best.select("cand_key", "bucket", "name", (F.col("best.weight") * F.col("best.confidence")).alias("quality"))


def job_items(features: DataFrame) -> DataFrame:
    """(job_key, bucket, name, pos, required, importance); items of no importance count only if required."""
    importance = W.lookup(W.REQUIREMENT, F.col("requirement_level")) * clamped_confidence(F.col("confidence"))
    items = features.select("job_key", "bucket", name_or_empty(F.col("name")).alias("name"), "pos", (F.coalesce(F.col("requirement_level"), F.lit("")) == "required").alias("required"), importance.alias("importance"))
    return items.where("name <> '' and (required or importance > 0)")


def job_constraints(jobs: DataFrame, features: DataFrame, stored: bool = True) -> DataFrame:
    """(job_key, pos, kind, bucket, value, min_years): hard constraints in order, each once.

    `stored`: as kept with a vacancy (restrictions too, 0 years kept); else as derived where a vacancy has none (no restrictions, years over 0 only).
    """
    order = F.element_at(F.create_map(*[x for k, b in enumerate(W.FEATURE_BUCKETS) for x in (F.lit(b), F.lit(k))]), F.col("bucket"))
    nothing, no_years = F.lit(None).cast("string"), F.lit(None).cast("int")
    named = features.where("requirement_level = 'required'").select("job_key", order.alias("part"), F.col("pos").cast("int").alias("pos"), F.lit("feature").alias("kind"), "bucket", name_or_empty(F.col("name")).alias("value"), no_years.alias("min_years")).where("value <> ''")
    senior = jobs.where("seniority is not null").select("job_key", F.lit(5).alias("part"), F.lit(0).alias("pos"), F.lit("seniority").alias("kind"), F.lit("seniority").alias("bucket"), "seniority", no_years)
    years = jobs.where("min_years is not null and coalesce(years_level, '') <> 'preferred'" + ("" if stored else " and min_years > 0")).select("job_key", F.lit(6), F.lit(0), F.lit("years_experience"), F.lit("years_experience"), nothing, "min_years")
    rows = named.union(senior).union(years)
    if stored:
        restrictions = jobs.select("job_key", F.posexplode(_listed(jobs, "restrictions", "restriction")).alias("pos", "value"))
        rows = rows.union(restrictions.select("job_key", F.lit(7), "pos", F.lit("restriction"), F.lit("restrictions"), "value", no_years))
    first = rows.groupBy("job_key", "kind", "bucket", "value", "min_years").agg(F.min(F.struct("part", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("job_key").orderBy("at", "value")).alias("pos")
    return first.select("job_key", place, "kind", "bucket", "value", "min_years")


def _listed(df: DataFrame, many: str, one: str) -> Column:
    """Normalised names of a list column, or of a single value; an empty list where there is neither."""
    none = F.array().cast("array<string>")
    values = F.col(many) if many in df.columns else F.array(F.col(one).cast("string")) if one in df.columns else none
    return F.coalesce(F.filter(F.transform(values, name_or_empty), lambda x: x != ""), none)


def candidate_attributes(candidates: DataFrame) -> DataFrame:
    """The columns of candidates that gates and scores read, with the prefix c_, lists as lists."""
    lists = {"preferred_locations": "preferred_location", "excluded_locations": "excluded_location", "preferred_workplaces": "preferred_workplace", "excluded_workplaces": "excluded_workplace"}
    plain = ("requires_visa_sponsorship", "avoid_export_control_roles", "seniority", "seniority_confidence", "years", "years_confidence")
    return candidates.select("cand_key", *(_listed(candidates, m, o).alias("c_" + m) for m, o in lists.items()), *(F.col(x).alias("c_" + x) for x in plain))


def job_attributes(jobs: DataFrame, *more: Column) -> DataFrame:
    """The columns of vacancies that gates and scores read, with the prefix j_, and `more`; the workplace is the policy, or the type where that is blank."""
    places = [label_or_null(F.col(x)) for x in ("remote_policy", "workplace_type") if x in jobs.columns]
    plain = ("location", "seniority", "seniority_confidence", "min_years", "years_level", "years_confidence")
    return jobs.select("job_key", F.coalesce(*places, F.lit(None).cast("string")).alias("j_workplace"), _listed(jobs, "restrictions", "restriction").alias("j_restrictions"), *(F.col(x).alias("j_" + x) for x in plain), *more)


def pairs(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every candidate with every vacancy, on small columns; columns of both sides carry the prefix c_ or j_ but for the keys."""
    c, j = candidate_attributes(candidates), job_attributes(jobs)
    return j.crossJoin(F.broadcast(c) if candidates.count() <= BROADCAST_CANDIDATES else c)


def gated_pairs(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """`pairs` with the reasons of the first gate in `first`. The gate is asked once for each candidate and kind of vacancy: it reads three of its columns."""
    c, j, kind = candidate_attributes(candidates), job_attributes(jobs), ["j_location", "j_workplace", "j_restrictions"]
    kinds = j.select(kind).distinct()
    asked = kinds.crossJoin(F.broadcast(c) if candidates.count() <= BROADCAST_CANDIDATES else c).withColumn("first", candidate_gate())
    asked = asked.select(*(F.col(x).alias("k" + x) for x in kind), "first", *c.columns)
    same = F.lit(True)
    for x in kind:
        same = same & j[x].eqNullSafe(asked["k" + x])
    return j.join(asked.hint("merge"), same).drop(*("k" + x for x in kind))


def _reason(condition: Column, bucket: str | Column, reason: str | Column, expected: Column, actual: Column | None = None) -> Column:
    """struct(bucket, reason, expected, actual) where the condition holds, else null."""
    text = lambda x: (F.lit(x) if isinstance(x, str) else F.lit(None) if x is None else x).cast("string")
    return F.when(condition, F.struct(text(bucket).alias("bucket"), text(reason).alias("reason"), text(expected).alias("expected"), text(actual).alias("actual")))


def _meets(place: Column, names: Column) -> Column:
    return F.exists(names, lambda x: contains_match(place, x))


def location_reasons() -> list[Column]:
    wanted, barred, there, label = F.col("c_preferred_locations"), F.col("c_excluded_locations"), name_or_empty(F.col("j_location")), label_or_null(F.col("j_location"))
    asked = F.array_join(wanted, ", ")
    return [
        _reason((F.size(wanted) > 0) & (there == ""), "location", "preferred_location_unknown", asked),
        _reason((F.size(wanted) > 0) & (there != "") & ~_meets(there, wanted), "location", "preferred_location_not_matched", asked, label),
        _reason((there != "") & _meets(there, barred), "location", "excluded_location_matched", label, label),
    ]


def workplace_reasons() -> list[Column]:
    """Preferred and excluded workplaces, compared as equal labels."""
    wanted, barred, label = F.col("c_preferred_workplaces"), F.col("c_excluded_workplaces"), F.col("j_workplace")
    there, asked = name_or_empty(label), F.array_join(wanted, ", ")
    return [
        _reason((F.size(wanted) > 0) & (there == ""), "workplace_type", "preferred_workplace_type_unknown", asked),
        _reason((F.size(wanted) > 0) & (there != "") & ~F.array_contains(wanted, there), "workplace_type", "preferred_workplace_type_not_matched", asked, label),
        _reason((there != "") & F.array_contains(barred, there), "workplace_type", "excluded_workplace_type_matched", label, label),
    ]


def stance_reasons() -> Column:
    """A candidate's stance on visas and export control, for every restriction in order; only an exact true rejects."""
    needs, avoids = F.col("c_requires_visa_sponsorship").eqNullSafe(F.lit(True)), F.col("c_avoid_export_control_roles").eqNullSafe(F.lit(True))

    def of(r: Column) -> Column:
        return F.coalesce(
            _reason(needs & r.isin("work_authorization", "citizenship"), "restrictions", "candidate_requires_visa_sponsorship", r, F.lit("candidate requires visa sponsorship")),
            _reason(avoids & (r == "controlled_technology"), "restrictions", "candidate_avoids_export_control_roles", r, F.lit("candidate avoids export-control roles")),
        )

    return F.array_compact(F.transform("j_restrictions", of))


def candidate_gate() -> Column:
    """All reasons of the first gate, in order: locations, workplaces, stances."""
    return F.concat(F.array_compact(F.array(*location_reasons(), *workplace_reasons())), stance_reasons())


def restriction_reasons() -> Column:
    """For every restriction of the vacancy in order, why the candidate does not meet it: work authorization passes on an exact false alone, citizenship and controlled technology never."""
    visa, avoids = F.col("c_requires_visa_sponsorship"), F.col("c_avoid_export_control_roles").eqNullSafe(F.lit(True))

    def of(r: Column) -> Column:
        name = (
            F.when(r == "work_authorization", F.when(visa.isNull(), "work_authorization_unknown").when(visa, "work_authorization_not_satisfied"))
            .when(r == "citizenship", "citizenship_eligibility_unknown")
            .when(r == "controlled_technology", F.when(avoids, "export_control_not_satisfied").otherwise("legal_eligibility_unknown"))
            .otherwise("restriction_eligibility_unknown")
        )
        actual = F.when((r == "work_authorization") & visa, "candidate requires visa sponsorship").when((r == "controlled_technology") & avoids, "candidate avoids export-control roles")
        return _reason(name.isNotNull(), "restrictions", name, r, actual)

    return F.array_compact(F.transform("j_restrictions", of))


def seniority_reason() -> Column:
    """An unknown vacancy value passes, an unknown candidate value does not."""
    job, own = W.lookup(W.SENIORITY, F.col("j_seniority"), None), W.lookup(W.SENIORITY, F.col("c_seniority"), None)
    return _reason(job.isNotNull() & (own.isNull() | (own < job)), "seniority", "seniority_not_satisfied", name_or_empty(F.col("j_seniority")), label_or_null(F.col("c_seniority")))


def years_reason() -> Column:
    asked = F.col("j_min_years").isNotNull() & (F.coalesce(F.col("j_years_level"), F.lit("")) != "preferred")
    return _reason(asked & (F.col("c_years").isNull() | (F.col("c_years") < F.col("j_min_years"))), "years_experience", "years_experience_not_satisfied", F.col("j_min_years"), F.col("c_years"))


def seniority_score() -> Column:
    job, own = W.lookup(W.SENIORITY, F.col("j_seniority"), None), W.lookup(W.SENIORITY, F.col("c_seniority"), None)
    fit = F.when(job.isNull() | own.isNull(), 0.0).when(own >= job, 1.0).when(own == job - 1, 0.5).otherwise(0.0)
    return fit * clamped_confidence(F.col("c_seniority_confidence")) * clamped_confidence(F.col("j_seniority_confidence"))


def years_score() -> Column:
    job, own = F.col("j_min_years"), F.col("c_years")
    fit = F.when(job.isNull() | (job <= 0) | own.isNull() | (own < 0), 0.0).otherwise(F.least(F.lit(1.0), own / F.greatest(job, F.lit(1))))
    return fit * clamped_confidence(F.col("c_years_confidence")) * clamped_confidence(F.col("j_years_confidence"))


_EXACT = "decimal(28,12)"  # products of weights and confidences have at most 12 places, so sums are exact in any order

_HALF = 1e-10  # so that a ratio that ends in a half at the seventh place is rounded up whatever its binary form


#: Rows of the candidates' index up to which each candidate's features are broadcast as a set; beyond, they meet by a merge join.
BROADCAST_FEATURES = 1_000_000
#: Words of 64 bits in a signature.
SIGNATURE_WORDS = 4
_WORDS = [f"w{k}" for k in range(SIGNATURE_WORDS)]


def _placed(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """`rows` with the bit of their feature: its number where features are few enough to have one each, else from its hash."""
    if numbers is not None:
        return rows.join(F.broadcast(numbers), "feature", "left")
    return rows.withColumn("bit", F.pmod(F.xxhash64("feature"), F.lit(64 * SIGNATURE_WORDS)).cast("int"))


def _words() -> list[Column]:
    """The signature of a group of features: words in which each sets its bit, so that a set can hold another only if it has all its bits."""
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    return [F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, own).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(_WORDS)]


def covered_sets(index: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cand_key, set, jobs), (job_key, set)): which candidate has all of which set of required features, and the set of every vacancy that has any.

    Vacancies that ask for the same set are one row. A set starts from its feature that fewest candidates have, so it never meets candidates without
    it; for the others a signature tells. Where the candidates have no more features than a signature has bits, each feature has its own, and signatures are the sets; else
    those that pass are compared name by name.
    """
    feature = F.concat_ws("\0", "bucket", "name").alias("feature")
    held = index.select("cand_key", feature)
    names = [r["feature"] for r in held.select("feature").distinct().limit(64 * SIGNATURE_WORDS + 1).collect()]
    exact = len(names) <= 64 * SIGNATURE_WORDS
    numbers = index.sparkSession.createDataFrame(list(zip(sorted(names), range(len(names)), strict=True)), "feature string, bit int") if exact else None
    known = held.select("feature").distinct().withColumn("known", F.lit(1))
    asked = items.where("required").select("job_key", feature).distinct().join(known.hint("merge") if not exact else F.broadcast(known), "feature", "left")
    lists = [] if exact else [F.sort_array(F.collect_set("feature")).alias("need")]
    of_job = _placed(asked, numbers).groupBy("job_key").agg(F.count_if(F.col("known").isNull()).alias("unheld"), *_words(), *lists).where("unheld = 0").drop("unheld")
    key = _WORDS if exact else [*_WORDS, "need"]
    sets = of_job.groupBy(*key).agg(F.count("*").alias("jobs"), F.min("job_key").alias("one"))
    holders = held.groupBy("feature").agg(F.count("*").alias("holders"))
    rarest = asked.join(sets.select(F.col("one").alias("job_key")), "job_key", "left_semi").join(holders, "feature").groupBy("job_key").agg(F.min_by("feature", "holders").alias("feature"))
    begun = sets.join(rarest.withColumnRenamed("job_key", "one"), "one").join(held, "feature").drop("feature", "one")
    own = _placed(held, numbers).groupBy("cand_key").agg(*(w.alias(f"h{k}") for k, w in enumerate(_words())), *([] if exact else [F.collect_set("feature").alias("have")]))
    rows = begun.join(F.broadcast(own) if index.count() <= BROADCAST_FEATURES else own.hint("merge"), "cand_key")
    for k, w in enumerate(_WORDS):
        rows = rows.where(F.col(w).bitwiseAND(F.bitwise_not(f"h{k}")) == 0)
    if not exact:
        rows = rows.where(F.size(F.array_except("need", "have")) == 0)
    told = F.struct(*key).alias("set")
    return rows.select("cand_key", told, "jobs"), of_job.select("job_key", told)


def covered_pairs(index: DataFrame, items: DataFrame) -> DataFrame:
    """(cand_key, job_key) where the candidate has all required features of a vacancy that has any: relational division."""
    found, of_job = covered_sets(index, items)
    return found.join(of_job, "set").select("cand_key", "job_key")


def job_totals(items: DataFrame) -> DataFrame:
    """(job_key, <bucket>_all): the importance of all items of each bucket."""
    return items.groupBy("job_key").agg(*(F.sum(F.when(F.col("bucket") == b, F.col("importance").cast(_EXACT))).alias(f"{b}_all") for b in W.FEATURE_BUCKETS))


def pair_features(keys: DataFrame, index: DataFrame, items: DataFrame, listed: bool = True) -> DataFrame:
    """(cand_key, job_key, n_missing, missing, <bucket>_sum) for the pairs in `keys` whose vacancy has items: what the candidate's features cover.

    `missing` holds struct(part, pos, bucket, name) of required features without a counterpart, in the order of constraints; it is left out unless
    `listed`, so that numbers alone are aggregated. The pairs are joined with their vacancies' items and then with the candidate's features by
    (cand_key, bucket, name): no key is shared by many candidates.
    """
    part = F.element_at(F.create_map(*[x for k, b in enumerate(W.FEATURE_BUCKETS) for x in (F.lit(b), F.lit(k))]), F.col("bucket"))
    met = keys.join(items, "job_key").join(index, ["cand_key", "bucket", "name"], "left")
    worth, lacks = (F.col("importance") * F.col("quality")).cast(_EXACT), F.col("required") & F.col("quality").isNull()
    sums = [F.count_if(lacks).alias("n_missing"), *(F.sum(F.when(F.col("bucket") == b, worth)).alias(f"{b}_sum") for b in W.FEATURE_BUCKETS)]
    lists = [F.sort_array(F.collect_list(F.when(lacks, F.struct(part.alias("part"), F.col("pos").cast("int").alias("pos"), "bucket", "name")))).alias("missing")]
    return met.groupBy("cand_key", "job_key").agg(*sums, *(lists if listed else []))


def _missing_reasons() -> Column:
    names = F.transform(F.coalesce("missing", F.array().cast("array<struct<part:int,pos:int,bucket:string,name:string>>")), lambda x: F.struct(x["bucket"].alias("bucket"), x["name"].alias("name")))
    return F.transform(F.array_distinct(names), lambda x: F.struct(x["bucket"].alias("bucket"), F.lit("required_feature_missing").alias("reason"), x["name"].alias("expected"), F.lit(None).cast("string").alias("actual")))


_NUMBERS = ("cand_key", "job_key", "stage", "status", "score", *(f"{b}_score" for b in W.BUCKET))
_REASONS = "array<struct<bucket:string,reason:string,expected:string,actual:string>>"


def stored_reasons(passed: DataFrame, index: DataFrame, stored: DataFrame) -> DataFrame:
    """(cand_key, job_key, stored) for the pairs whose vacancy has rows in `stored` (job_key, pos, kind, bucket, value, min_years): the second gate's reasons by these constraints alone, in their order.

    Kinds are feature, seniority, years_experience and restriction, all normalised here; others, blank values and years that are null ask nothing. Years of 0 ask that the candidate's are known.
    Features meet the candidate's by (cand_key, bucket, name), a key that no two candidates share.
    """
    kind = name_or_empty(F.col("kind"))
    asked = stored.select("job_key", "pos", kind.alias("s_kind"), name_or_empty(F.col("bucket")).alias("s_bucket"), F.nullif(name_or_empty(F.col("value")), F.lit("")).alias("s_value"), F.col("min_years").cast("int").alias("s_years"))
    held = index.select("cand_key", F.col("bucket").alias("s_bucket"), F.col("name").alias("s_value"), F.lit(True).alias("s_held"))
    rows = passed.join(asked, "job_key").join(held, ["cand_key", "s_bucket", "s_value"], "left")
    is_kind = lambda k: F.when(F.col("s_kind") == k, F.col("s_years" if k == "years_experience" else "s_value"))
    one = F.array_compact(F.array(is_kind("restriction")))
    rows = rows.withColumns({"j_seniority": is_kind("seniority"), "j_min_years": is_kind("years_experience"), "j_years_level": F.lit(None).cast("string"), "j_restrictions": one})
    missing = _reason((F.col("s_kind") == "feature") & F.col("s_value").isNotNull() & F.col("s_held").isNull(), F.col("s_bucket"), "required_feature_missing", F.col("s_value"))
    why = F.coalesce(missing, seniority_reason(), years_reason(), F.get(restriction_reasons(), F.lit(0)))
    every = rows.groupBy("cand_key", "job_key").agg(F.sort_array(F.collect_list(F.struct("pos", why.alias("why")))).alias("every"))
    return every.select("cand_key", "job_key", F.array_compact(F.transform("every", lambda x: x["why"])).alias("stored"))


def _second_stage(passed: DataFrame, features: DataFrame, totals: DataFrame, threshold: float, listed: bool, stored: DataFrame | None = None) -> DataFrame:
    """The result of pairs that the first gate lets pass: second gate, score, decision. `stored` (of `stored_reasons`) stands for the gate where it has a pair."""
    rows = passed.join(features, ["cand_key", "job_key"], "left").join(totals, "job_key", "left")
    passes = (F.coalesce("n_missing", F.lit(0)) == 0) & seniority_reason().isNull() & years_reason().isNull()
    passes = passes & ((F.size("j_restrictions") == 0) | (F.size(restriction_reasons()) == 0))
    if stored is not None:
        rows = rows.join(stored, ["cand_key", "job_key"], "left")
        passes = F.when(F.col("stored").isNull(), passes).otherwise(F.size("stored") == 0)
    rows = rows.withColumn("ranked", passes)
    ranked = F.col("ranked")
    score = {b: F.round(F.coalesce(F.try_divide(F.coalesce(F.col(f"{b}_sum"), F.lit(0)).cast("double"), F.coalesce(F.col(f"{b}_all"), F.lit(0)).cast("double")), F.lit(0.0)) + _HALF, 6) for b in W.FEATURE_BUCKETS}
    score |= {"seniority": F.round(seniority_score(), 6), "years": F.round(years_score(), 6)}
    rows = rows.withColumns({f"{b}_score": F.when(ranked, s).otherwise(0.0) for b, s in score.items()})
    total = F.lit(0).cast("decimal(12,8)")
    for b, w in W.BUCKET.items():  # in decimals, so that halves round alike whatever the order
        total = total + F.lit(str(w)).cast("decimal(3,2)") * F.col(f"{b}_score").cast("decimal(8,6)")
    rows = rows.withColumn("score", F.round(total, 6).cast("double"))
    match = ranked & (F.col("score") >= threshold)
    rows = rows.withColumns({"stage": F.when(ranked, "ranking").otherwise("job_must_have"), "status": F.when(match, "match").otherwise("mismatch")})
    if not listed:
        return rows.select(*_NUMBERS)
    second = F.concat(_missing_reasons(), F.array_compact(F.array(seniority_reason(), years_reason())), restriction_reasons())
    if stored is not None:
        second = F.coalesce("stored", second)
    rows = rows.withColumn("details", F.when(ranked, F.array().cast(_REASONS)).otherwise(second))
    reasons = F.transform("details", lambda x: x["reason"])
    return rows.select(*_NUMBERS, F.when(ranked & ~match, F.array(F.lit("score_below_threshold"))).otherwise(reasons).alias("reasons"), "details")


def evaluate(candidates: DataFrame, cand_features: DataFrame, jobs: DataFrame, job_features: DataFrame, threshold: float = W.MATCH_THRESHOLD, listed: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """One row for each pair: stage, status, score, the seven bucket scores, the gates' reasons and their details (bucket, reason, expected, actual).

    Stages: candidate_must_have, job_must_have, ranking. A pair that a gate stops has score 0, zero buckets and all reasons of that
    gate; one in the last stage below the threshold has `score_below_threshold`. An empty bucket scores 0 and weights are not renormalised.
    All pairs are a product by definition; `matches` gives the matches alone without one. The first gate reads attributes only, and only pairs
    that pass it meet the features. Without `listed` reasons and details are left out. Vacancies with rows in `stored` (job_key, pos, kind, bucket, value,
    min_years) have these as the second gate, in their order; the others have what their own columns and items ask.
    """
    items, index = job_items(job_features), candidate_index(cand_features)
    rows = gated_pairs(candidates, jobs)
    stopped = rows.where(F.size("first") > 0).select(
        "cand_key", "job_key", F.lit("candidate_must_have").alias("stage"), F.lit("mismatch").alias("status"), F.lit(0.0).alias("score"), *(F.lit(0.0).alias(f"{b}_score") for b in W.BUCKET),
        *([F.transform("first", lambda x: x["reason"]).alias("reasons"), F.col("first").alias("details")] if listed else []),
    )
    passed = rows.where(F.size("first") == 0).drop("first")
    features, kept = pair_features(passed.select("cand_key", "job_key"), index, items, listed), stored_reasons(passed, index, stored) if stored is not None else None
    return stopped.unionByName(_second_stage(passed, features, job_totals(items), threshold, listed, kept))


#: A bound is kept where it falls short of the threshold by no more than this: scores are rounded to six places, bucket by bucket.
_SLACK = 1e-5


def job_bounds(index: DataFrame, items: DataFrame, jobs: DataFrame, threshold: float) -> DataFrame:
    """(job_key, <bucket>_most, rest): what any candidate can score at most with a vacancy in each bucket, and in seniority and years.

    Every item counts as if the candidate with the best quality for its name held it. Vacancies that can't reach `threshold` with anyone, or that require what
    nobody has, are left out: they meet no candidate at all. The work is a lookup of names and a sum for each vacancy.
    """
    best = index.groupBy("bucket", "name").agg(F.max("quality").alias("most"))
    rows = items.join(best, ["bucket", "name"], "left")
    sums = [F.try_divide(F.sum(F.when(F.col("bucket") == b, F.col("importance") * F.coalesce("most", F.lit(0.0)))), F.sum(F.when(F.col("bucket") == b, F.col("importance")))) for b in W.FEATURE_BUCKETS]
    bounds = rows.groupBy("job_key").agg(F.count_if(F.col("required") & F.col("most").isNull()).alias("unheld"), *(F.coalesce(x, F.lit(0.0)).alias(f"{b}_most") for b, x in zip(W.FEATURE_BUCKETS, sums, strict=True)))
    rest = [W.BUCKET[b] * F.when(known, clamped_confidence(F.col(c))).otherwise(0.0) for b, known, c in (
        ("seniority", W.lookup(W.SENIORITY, F.col("seniority"), None).isNotNull(), "seniority_confidence"), ("years", F.col("min_years") > 0, "years_confidence"))]
    able = jobs.select("job_key", sum(rest).alias("rest")).join(bounds, "job_key", "left").fillna(0, [f"{b}_most" for b in W.FEATURE_BUCKETS])
    return able.where((F.coalesce("unheld", F.lit(0)) == 0) & (F.col("rest") + _weighted(lambda b: F.col(f"{b}_most")) >= threshold - _SLACK)).drop("unheld")


def candidate_bounds(index: DataFrame) -> DataFrame:
    """(cand_key, <bucket>_best): a candidate's best quality in each bucket; the score of a bucket is an average of qualities, so never above it."""
    return index.groupBy("cand_key").agg(*(F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("quality"))), F.lit(0.0)).alias(f"{b}_best") for b in W.FEATURE_BUCKETS))


def _weighted(score) -> Column:
    total = F.lit(0.0)
    for b in W.FEATURE_BUCKETS:
        total = total + W.BUCKET[b] * score(b)
    return total


def open_kinds(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(c_kind, j_kind): the kinds of candidate and of vacancy that all gates on attributes let meet.

    A kind is a distinct row of the columns that the gates read, known by two 64-bit hashes; so gates are asked once for each pair of kinds, whatever the
    number of candidates and vacancies. Kinds meet by an equal place in seniority, which a vacancy lists from its own up (all where it has none), and an equal workplace:
    a candidate lists those preferred, or stands under `*` without a preference, as every vacancy does beside its own.
    """
    c, j = candidate_attributes(candidates).select(*_C_GATE).distinct(), job_attributes(jobs).select(*_J_GATE).distinct()
    ranks, wanted = list(range(max(W.SENIORITY.values()) + 1)), F.array_distinct("c_preferred_workplaces")
    asked = W.lookup(W.SENIORITY, F.col("j_seniority"), None)
    own = c.withColumn("rank", W.lookup(W.SENIORITY, F.col("c_seniority"), 0)).withColumn("place", F.explode(F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("*")))))
    there = j.withColumn("rank", F.explode(F.filter(F.array(*map(F.lit, ranks)), lambda r: asked.isNull() | (r >= asked)))).withColumn("place", F.explode(F.array_distinct(F.array(name_or_empty(F.col("j_workplace")), F.lit("*")))))
    plain = seniority_reason().isNull() & years_reason().isNull()
    lists = ((F.size("j_restrictions") == 0) | (F.size(restriction_reasons()) == 0)) & (F.size(candidate_gate()) == 0)
    met = there.join(F.broadcast(own) if c.count() <= BROADCAST_CANDIDATES else own.hint("merge"), ["rank", "place"])
    return met.where(plain).where(lists).select(*_kind("c", _C_GATE), *_kind("j", _J_GATE)).distinct()


def _kind(side: str, columns: tuple[str, ...]) -> list[Column]:
    return [F.xxhash64(F.lit(k), *columns).alias(f"{side}_kind{k}") for k in (1, 2)]


_C_GATE = (
    "c_preferred_locations", "c_excluded_locations", "c_preferred_workplaces", "c_excluded_workplaces", "c_requires_visa_sponsorship", "c_avoid_export_control_roles", "c_seniority", "c_years",
)
_J_GATE = ("j_location", "j_workplace", "j_restrictions", "j_seniority", "j_min_years", "j_years_level")


def _held(df: DataFrame) -> DataFrame:
    """`df` worked out once: checkpointed where the context was started with a shared folder for it, which outlives executors, else cached, and worked out anew if lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def matches(candidates: DataFrame, cand_features: DataFrame, jobs: DataFrame, job_features: DataFrame, threshold: float = W.MATCH_THRESHOLD) -> DataFrame:
    """The rows of `evaluate` with status match, less their empty reasons, without a product of candidates and vacancies.

    Vacancies whose bound is below the threshold go first; the others and the candidates meet by kinds that the gates let meet; pairs whose bucket bounds fall
    short go before any feature is joined; then required features and the score decide. No bound loses a match.
    """
    items, index = job_items(job_features), _held(candidate_index(cand_features))
    bounds = _held(job_bounds(index, items, jobs, threshold))
    able = jobs.join(bounds.select("job_key"), "job_key", "left_semi")
    j = job_attributes(able).select("*", *_kind("j", _J_GATE)).join(bounds, "job_key")
    c = candidate_attributes(candidates).select("*", *_kind("c", _C_GATE)).join(candidate_bounds(index), "cand_key", "left").fillna(0.0, [f"{b}_best" for b in W.FEATURE_BUCKETS])
    c = F.broadcast(c) if candidates.count() <= BROADCAST_CANDIDATES else c.hint("merge")
    reach = F.col("rest") + _weighted(lambda b: F.least(F.col(f"{b}_most"), F.col(f"{b}_best"))) >= threshold - _SLACK
    met = j.join(open_kinds(candidates, able).hint("merge"), ["j_kind1", "j_kind2"]).join(c, ["c_kind1", "c_kind2"]).where(reach)
    passed = met.drop("j_kind1", "j_kind2", "c_kind1", "c_kind2", "rest", *(f"{b}_{x}" for b in W.FEATURE_BUCKETS for x in ("most", "best")))
    own = _held(items.join(bounds.select("job_key"), "job_key", "left_semi"))
    passed = _held(passed)
    return _second_stage(passed, pair_features(passed.select("cand_key", "job_key"), index, own, False), job_totals(own), threshold, False).where("status = 'match'")


def ranked_jobs(evaluated: DataFrame) -> DataFrame:
    """Adds `place`: a candidate's matches by falling score, then the others in input order (job_key), whatever their score."""
    order = [F.when(F.col("status") == "match", 0).otherwise(1), F.when(F.col("status") == "match", -F.col("score")).otherwise(0.0), F.col("job_key")]
    return evaluated.withColumn("place", F.row_number().over(Window.partitionBy("cand_key").orderBy(*order)))


def top_matches(evaluated: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("cand_key").orderBy(F.desc("score"), "job_key"))
    return evaluated.where("status = 'match'").withColumn("place", place).where(F.col("place") <= k)


def explained(evaluated: DataFrame, cand_features: DataFrame, job_features: DataFrame) -> DataFrame:
    """(cand_key, job_key, bucket, pos, name, importance, quality, matched) for every counted item of pairs that reached the last stage."""
    items = job_items(job_features).where("importance > 0")
    reached = evaluated.where("stage = 'ranking'").select("cand_key", "job_key")
    index = candidate_index(cand_features)
    found = reached.join(items, "job_key").join(index, ["cand_key", "bucket", "name"], "left")
    return found.select("cand_key", "job_key", "bucket", "pos", "name", F.round("importance", 6).alias("importance"), F.round("quality", 6).alias("quality"), F.col("quality").isNotNull().alias("matched"))


def explained_levels(evaluated: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """(cand_key, job_key, bucket, job_value, candidate_value, score, matched): what seniority and years add to pairs that reached the last stage.

    Vacancies without a known seniority, or with no years above 0, have no such row. A gap has neither the candidate's value nor a score: a seniority of score 0, years that are unknown or below 0.
    """
    own = candidates.select("cand_key", *(F.col(x).alias("c_" + x) for x in ("seniority", "seniority_confidence", "years", "years_confidence")))
    asked = jobs.select("job_key", *(F.col(x).alias("j_" + x) for x in ("seniority", "seniority_confidence", "min_years", "years_confidence")))
    rows = evaluated.where("stage = 'ranking'").select("cand_key", "job_key").join(asked, "job_key").join(F.broadcast(own) if own.count() <= BROADCAST_CANDIDATES else own.hint("merge"), "cand_key")
    return level_entries(rows)


def level_entries(rows: DataFrame) -> DataFrame:
    """The entries of `explained_levels` for pairs that have the columns of both sides, with the prefixes c_ and j_."""

    def entry(bucket: str, asks: Column, asked: Column, given: Column, score: Column, matched: Column) -> Column:
        parts = [F.lit(bucket).alias("bucket"), asked.cast("string").alias("job_value"), F.when(matched, given.cast("string")).alias("candidate_value"), F.when(matched, F.round(score + _HALF, 6)).alias("score"), matched.alias("matched")]
        return F.when(asks, F.struct(*parts))

    senior, years = F.coalesce(seniority_score(), F.lit(0.0)), F.coalesce(years_score(), F.lit(0.0))
    known = F.coalesce(F.col("c_years") >= 0, F.lit(False))
    entries = F.array_compact(F.array(
        entry("seniority", W.lookup(W.SENIORITY, F.col("j_seniority"), None).isNotNull(), name_or_empty(F.col("j_seniority")), name_or_empty(F.col("c_seniority")), senior, senior > 0),
        entry("years_experience", F.coalesce(F.col("j_min_years") > 0, F.lit(False)), F.col("j_min_years"), F.col("c_years"), years, known),
    ))
    return rows.select("cand_key", "job_key", F.explode(entries).alias("e")).select("cand_key", "job_key", "e.*")


def summary_lines(ranked: DataFrame) -> DataFrame:
    """One line of text for each row: stage, status, score and first reason."""
    line = F.format_string("#%d job %d: %s at %s, score %.3f, %s", "place", "job_key", "status", "stage", "score", F.coalesce(F.get("reasons", F.lit(0)), F.lit("none")))
    return ranked.select("cand_key", "place", "job_key", line.alias("line"))


def skip_explanations(evaluated: DataFrame, threshold: float = W.MATCH_THRESHOLD) -> DataFrame:
    """(cand_key, job_key, line) for every pair of `evaluated` that is no match: its score below the threshold, or the stage and the first reason."""
    return evaluated.where("status <> 'match'").select("cand_key", "job_key", skip_line(F.format_string("score=%.3f < %.3f", F.coalesce("score", F.lit(0.0)), F.lit(threshold))).alias("line"))


def skip_line(below: Column) -> Column:
    """`below` for pairs of the last stage, else the stage and the first reason."""
    gated = F.concat(F.lit("stage="), "stage", F.lit(" | reason="), F.coalesce(F.get("reasons", F.lit(0)), F.lit("unknown")))
    return F.when(F.col("stage") == "ranking", below).otherwise(gated)


def first_jobs(jobs: DataFrame, limit: int | None, key: str = "job_key") -> DataFrame:
    """The first `limit` vacancies by key, all without a limit; a limit under 1 is an error. The order is by key, so the choice does not depend on partitions."""
    if limit is None:
        return jobs
    if limit < 1:
        raise ValueError("the limit of vacancies must be 1 or more")
    return jobs.orderBy(key).limit(limit)


def counted(evaluated: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """(`evaluated` unchanged, its counters): pairs, matches, pairs of each stage and the best score, gathered while another action runs over it.

    The counters are there after the first action, which alone reads the pairs; asking for them earlier waits for it.
    """
    seen, stage = Observation(name), F.col("stage")
    stages = {"stopped_by_candidate": "candidate_must_have", "stopped_by_job": "job_must_have", "ranked": "ranking"}
    counters = [F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("status") == "match").alias("matches"), *(F.count_if(stage == s).alias(k) for k, s in stages.items()), F.max("score").alias("best")]
    return evaluated.observe(seen, *counters), seen
