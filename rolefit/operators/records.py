"""Vacancy records: fields of a page, joined with what was extracted from its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import extract as X
from rolefit.functions import pages as P
from rolefit.functions import weights as W
from rolefit.functions.text import clamped_confidence, deduped_texts, job_id, name_or_empty, normalized, parsed_confidence, taxonomy_name

_FEATURE = "array<struct<name:string,requirement_level:string,confidence:string,evidence:array<string>>>"
_RESTRICTION = "array<struct<value:string,confidence:string,evidence:array<string>>>"
_SENIORITY = "struct<value:string,confidence:string,evidence:array<string>>"
PAYLOAD_SCHEMA = ", ".join(f"{b} {_FEATURE}" for b in W.FEATURE_BUCKETS) + f", restrictions {_RESTRICTION}, seniority {_SENIORITY}"
CONSTRAINT = "struct<kind:string,bucket:string,value:string,min_years:int,confidence:double,evidence:array<string>,source_kind:string>"
#: A regular expression found the years, with this confidence.
YEARS_CONFIDENCE = 0.9


def page_records(pages: DataFrame) -> DataFrame:
    """One record for each row of `pages` (url, html, title, disciplines): every field that rules find, and `job_id`. Other columns are left out.

    A null html gives null fields, an empty description and empty lists; null disciplines give an empty list. A blank title takes the page's heading.
    """
    html = F.coalesce("html", F.lit(""))
    read = pages.select(
        "url", F.coalesce(F.nullif(normalized(F.col("title")), F.lit("")), X.page_title(html)).alias("title"), F.sort_array(F.coalesce("disciplines", F.array().cast("array<string>"))).alias("disciplines"),
        P.read_page(html, LABELS).alias("page"), P.job_posting(html).alias("posting"), X.page_description(html).alias("description_text"),
    )
    read = read.select("*", P.job_metadata(F.col("page.tags"), F.col("posting")).alias("meta"), *(F.col(f"page.{name}").alias(name) for name in LABELS))
    told = read.select(
        "*", X.experience_fields(F.col("work_experience"), F.col("description_text")).alias("years"), F.coalesce("meta.educational_background", "education").alias("educational_background"),
        X.hours_per_week(F.col("description_text")).alias("hours"), X.work_location(F.col("description_text")).alias("place"), X.recruiter_contact(F.col("description_text")).alias("recruiter"),
    )
    return told.select(
        job_id(F.col("title"), F.col("url")).alias("job_id"), "title", "url", "disciplines", F.col("meta.location").alias("location"), F.col("meta.country").alias("country"), "team", "work_experience",
        F.col("years.low").alias("min_years_experience"), F.col("years.high").alias("max_years_experience"), F.col("years.text").alias("experience_text"), "educational_background",
        X.required_degrees(F.col("educational_background"), F.col("description_text")).alias("required_degrees"), X.industry_domains(F.col("description_text")).alias("industry_domains"), "workplace_type",
        F.coalesce("meta.fulltime_parttime", "hours_label").alias("fulltime_parttime"), F.col("hours.low").alias("min_hours_per_week"), F.col("hours.high").alias("max_hours_per_week"),
        X.remote_policy(F.col("workplace_type"), F.col("description_text")).alias("remote_policy"), F.col("place.place").alias("work_locations_text"), F.col("place.client_site").alias("client_site_required"),
        F.col("place.travel_region").alias("travel_region"), F.col("recruiter.name").alias("recruiter_name"), F.col("recruiter.role").alias("recruiter_role"), F.col("recruiter.email").alias("recruiter_email"),
        F.col("recruiter.phone").alias("recruiter_phone"), "description_text",
    )


#: Column and visible label of the labelled values.
LABELS = {"work_experience": "Work experience", "education": "Educational background", "workplace_type": "Workplace type", "team": "Team", "hours_label": "Fulltime/parttime"}


def years_requirement(low: Column, high: Column, text: Column, labelled: Column) -> Column:
    """struct(min_years, max_years, requirement_level, confidence, evidence, source_kind); all null with confidence 0 where no years were found."""
    found, told = low.isNotNull() | high.isNotNull(), F.coalesce(F.nullif(text, F.lit("")), F.nullif(labelled, F.lit("")))
    none = F.array().cast("array<string>")
    return F.struct(
        low.alias("min_years"), high.alias("max_years"), F.when(found, X.requirement_level(told)).alias("requirement_level"), F.when(found, YEARS_CONFIDENCE).otherwise(0.0).alias("confidence"),
        F.when(found & told.isNotNull(), F.array(told)).otherwise(none).alias("evidence"), F.when(found, "regex_text").alias("source_kind"),
    )


def _merged(items: Column, key: str, extra: list[tuple[str, object]]) -> Column:
    """One item for each normalised key in order: the highest confidence, all evidence, stamped as extracted."""
    clean = F.filter(F.coalesce(items, F.array()), lambda x: name_or_empty(x[key]) != "")
    names = F.array_distinct(F.transform(clean, lambda x: taxonomy_name(x[key])))

    def one(name: Column) -> Column:
        same = F.filter(clean, lambda x: taxonomy_name(x[key]) == name)
        confidence = F.array_max(F.transform(same, lambda x: clamped_confidence(parsed_confidence(x.confidence))))
        evidence = deduped_texts(F.flatten(F.transform(same, lambda x: F.coalesce(x.evidence, F.array().cast("array<string>")))))
        return F.struct(name.alias(key), *(value(same).alias(field) for field, value in extra), confidence.alias("confidence"), evidence.alias("evidence"), F.lit("llm").alias("source_kind"))

    return F.transform(names, one)


def feature_items(items: Column) -> Column:
    """Extracted features merged by name, required before preferred, with `source_kind`."""
    return _merged(items, "name", [("requirement_level", lambda same: F.when(F.exists(same, lambda x: F.lower(F.trim(x.requirement_level)) == "required"), "required").otherwise("preferred"))])


def restriction_items(items: Column) -> Column:
    return _merged(items, "value", [])


def seniority_item(item: Column) -> Column:
    """The extracted seniority; `source_kind` is null where it has no value."""
    value = F.nullif(taxonomy_name(item.value), F.lit(""))
    evidence = F.coalesce(deduped_texts(item.evidence), F.array().cast("array<string>"))
    return F.struct(value.alias("value"), clamped_confidence(parsed_confidence(item.confidence)).alias("confidence"), evidence.alias("evidence"), F.when(value.isNotNull(), "llm").alias("source_kind"))


def _constraint(kind: str, bucket: str, value: Column, years: Column, item: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(bucket).alias("bucket"), value.alias("value"), years.alias("min_years"), item.confidence.alias("confidence"), item.evidence.alias("evidence"), item.source_kind.alias("source_kind"))


def constraint_list(buckets: dict[str, Column], seniority: Column, years: Column, restrictions: Column) -> Column:
    """Hard constraints in order, the first of each (kind, bucket, value, min_years): required features by bucket, a seniority, the least years
    (0 too) unless preferred, restrictions by their class.
    """
    no_years, none = F.lit(None).cast("int"), F.array().cast(f"array<{CONSTRAINT}>")

    def required(bucket: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x.requirement_level == "required"), lambda x: _constraint("feature", bucket, x["name"], no_years, x))

    asks_years = years.min_years.isNotNull() & (F.coalesce(years.requirement_level, F.lit("")) != "preferred")
    parts = [required(b, items) for b, items in buckets.items()]
    parts.append(F.when(seniority.value.isNotNull(), F.array(_constraint("seniority", "seniority", seniority.value, no_years, seniority))).otherwise(none))
    parts.append(F.when(asks_years, F.array(_constraint("years_experience", "years_experience", F.lit(None).cast("string"), years.min_years, years))).otherwise(none))
    parts.append(F.transform(restrictions, lambda x: _constraint("restriction", "restrictions", X.restriction_class(x["value"]), no_years, x)))
    every = F.concat(*(p.cast(f"array<{CONSTRAINT}>") for p in parts))
    keys = F.transform(every, _key)
    return F.filter(every, lambda c, i: F.array_position(keys, _key(c)) == i + 1)


def _key(c: Column) -> Column:
    return F.to_json(F.struct(c.kind, c.bucket, c.value, c.min_years))


def constraints_in_use(stored: Column, derived: Column) -> Column:
    """struct(kind, bucket, value, min_years, confidence) list of a vacancy: the stored constraints, normalised and not deduplicated, where there are any;
    else the derived ones, without restrictions and years of 0. A blank value is null.
    """

    def plain(c: Column) -> Column:
        return F.struct(name_or_empty(c.kind).alias("kind"), name_or_empty(c.bucket).alias("bucket"), F.nullif(name_or_empty(c.value), F.lit("")).alias("value"), c.min_years.alias("min_years"), clamped_confidence(c.confidence).alias("confidence"))

    own = F.filter(derived, lambda c: (c.kind != "restriction") & (F.coalesce(c.min_years, F.lit(1)) > 0))
    return F.transform(F.when(F.size(stored) > 0, stored).otherwise(own), plain)


def assembled_jobs(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Vacancies: `records` (of `page_records`) joined with valid `payloads` (job_id, payload) by job_id. Records without a payload and payloads
    without a record are left out. Lists are merged by name, stamped with their source, and the hard constraints built from them.

    An inner equi-join on the id, left to the optimizer; the payload is parsed before it, so the join carries columns and no JSON.
    """
    parsed = payloads.select("job_id", F.from_json("payload", PAYLOAD_SCHEMA).alias("p")).select(
        "job_id", *(feature_items(F.col(f"p.{b}")).alias(b) for b in W.FEATURE_BUCKETS), restriction_items(F.col("p.restrictions")).alias("restrictions"), seniority_item(F.col("p.seniority")).alias("seniority")
    )
    years = years_requirement(F.col("min_years_experience"), F.col("max_years_experience"), F.col("experience_text"), F.col("work_experience"))
    joined = records.join(parsed, "job_id").withColumn("years_experience_requirement", years)
    constraints = constraint_list({b: F.col(b) for b in W.FEATURE_BUCKETS}, F.col("seniority"), F.col("years_experience_requirement"), F.col("restrictions"))
    return joined.withColumn("job_constraints", constraints).drop("min_years_experience", "max_years_experience", "experience_text", "country")
