"""Keyed upserts, content-hash reuse, snapshot comparison and keyword decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions.text import has_any


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key: a new match takes away an old mismatch and the other way."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def split_by_reuse(texts: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending, reused) rows of `texts` (candidate_id, source_text_hash): those whose text is not yet, or already, in `profiles`."""
    key = ["candidate_id", "source_text_hash"]
    known = profiles.select(*key).distinct()
    return texts.join(known, key, "left_anti"), texts.join(known, key, "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) with change added, removed or shared."""
    a, b = old.select(key).distinct().withColumn("_a", F.lit(1)), new.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("shared").alias("change"))


def new_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, filled): fields that only `new` has, with the number of rows where they are not null."""
    names = [c for c in new.columns if c not in old.columns]
    if not names:
        return new.sparkSession.createDataFrame([], "field string, filled long")
    counts = new.agg(*(F.count(c).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names))).alias("x")).select("x.*")


def field_change_frequency(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(field, changed, total): for shared fields over shared keys, how many values differ, nulls compared as values."""
    names = [c for c in old.columns if c in new.columns and c != key]
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    counts = both.agg(F.count("*").alias("total"), *(F.count_if(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(c) for c in names))
    return counts.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("changed")) for c in names))).alias("x")).select("x.field", "x.changed", "total")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Keywords found as whole words, in list order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(r"(?U)(?<!\w)" + _quoted(k) + r"(?!\w)"), F.lit(k)) for k in keywords)))


def _quoted(k: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in k.lower())


# They must be these for right decisions.
JOB_TYPES = ("internship", "working student", "graduation")
RESTRICTED = ("export control", "controlled technology", "security clearance", "clearance")


def required_names(items: Column) -> Column:
    """Names of the required ones of structured items (name, requirement_level)."""
    return F.transform(F.filter(items, lambda x: x.requirement_level == "required"), lambda x: x["name"])


def item_values(items: Column) -> Column:
    """Values of structured items (value)."""
    return F.transform(items, lambda x: x["value"])


def hard_filters(title: Column, languages: Column, min_years: Column, restrictions: Column, excluded_languages: tuple[str, ...] = ("dutch",), most_years: int = 7) -> Column:
    """struct(reason, skip_hits) of the first hard filter met, else a null reason and no hits: a job type in the title, an excluded language that is
    required, more than `most_years` years, then export control or clearance. `languages` and `restrictions` are lists of texts (of structured
    items: `required_names`, `item_values`). Nulls meet no filter.
    """
    types = F.transform(keyword_hits(title, list(JOB_TYPES)), lambda t: F.concat(F.lit("job_type:"), t))
    asked = F.transform(F.coalesce(languages, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    spoken = F.transform(F.array_intersect(F.array(*(F.lit(x) for x in excluded_languages)), asked), lambda x: F.concat(F.lit("required_language:"), x))
    barred = F.exists(restrictions, lambda x: has_any(F.lower(x), RESTRICTED))

    def met(name: str, hits: Column) -> Column:
        return F.struct(F.lit(f"hard_filter_{name}").alias("reason"), hits.alias("skip_hits"))

    return (
        F.when(F.size(types) > 0, met("exclude_job_type", types))
        .when(F.size(spoken) > 0, met("required_language", spoken))
        .when(min_years > most_years, met("min_years_experience", F.array(F.concat(F.lit("min_years_experience:"), min_years.cast("string")))))
        .when(barred, met("export_control_clearance", F.array(F.lit("restriction:export_control_or_security_clearance"))))
        .otherwise(F.struct(F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("skip_hits")))
    )


def filtered_decision(filters: Column, keywords: Column) -> Column:
    """The struct of `keyword_decision` where no hard filter of `hard_filters` is met; else a skip with that filter's reason and hits alone."""
    none = F.array().cast("array<string>")
    skip = F.struct(F.lit("skip").alias("decision"), filters.reason.alias("reason"), none.alias("title_hits"), none.alias("description_hits"), filters.skip_hits.alias("skip_hits"))
    return F.when(filters.reason.isNotNull(), skip).otherwise(keywords)


def kept(decided: DataFrame) -> DataFrame:
    """The kept subset of rows with a `decision`."""
    return decided.where("decision = 'keep'")


def keyword_decision(title: Column, description: Column, skip: list[str], title_words: list[str], strong_words: list[str], least: int = 2) -> Column:
    """struct(decision, reason, title_hits, description_hits, skip_hits): hard filters first, then the title, then enough strong words in the description."""
    skipped, title_hits, strong = keyword_hits(description, skip), keyword_hits(title, title_words), keyword_hits(description, strong_words)
    none = F.array().cast("array<string>")
    reason = F.when(F.size(skipped) > 0, "hard_filter").when(F.size(title_hits) > 0, "title_keep_match").when(F.size(strong) >= least, "description_keep_match").otherwise("insufficient_keep_signal")
    weak = reason == "insufficient_keep_signal"
    return F.struct(
        F.when(reason.isin("title_keep_match", "description_keep_match"), "keep").otherwise("skip").alias("decision"), reason.alias("reason"), F.when(weak, none).otherwise(title_hits).alias("title_hits"),
        F.when(weak, none).otherwise(strong).alias("description_hits"), skipped.alias("skip_hits"),
    )
