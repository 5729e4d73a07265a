"""Text, id and number normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(s: Column) -> Column:
    """Runs of any Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def folded(s: Column) -> Column:
    """Lower case with sharp s as ss, close to full case folding."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def taxonomy_name(s: Column) -> Column:
    return F.lower(normalized(s))


def name_or_empty(s: Column) -> Column:
    return F.coalesce(taxonomy_name(s), F.lit(""))


def label_or_null(s: Column) -> Column:
    return F.nullif(normalized(s), F.lit(""))


def deduped_texts(items: Column) -> Column:
    """Normalised, blanks dropped, one of each spelling whatever its case: the first, in order."""
    clean = F.filter(F.transform(items, normalized), lambda x: x != "")
    keys = F.transform(clean, folded)
    return F.filter(clean, lambda x, i: F.array_position(keys, folded(x)) == i + 1)


def string_list(items: Column) -> Column:
    """Normalised, blanks dropped, distinct with case, in order; null gives an empty list."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(items, normalized), lambda x: x != "")), F.array().cast("array<string>"))


def title_slug(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(folded(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("job"))


def job_id(title: Column, url: Column) -> Column:
    """Slug of the title and ten hex digits of the url's SHA-1; the slug alone without a url."""
    return F.when(F.coalesce(url, F.lit("")) == "", title_slug(title)).otherwise(F.concat(title_slug(title), F.lit("__"), F.substring(F.sha1(url), 1, 10)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def candidate_id(text: Column, explicit: Column) -> Column:
    """The explicit id, normalised, a blank one being an error; without one, twelve hex digits of the text's hash."""
    own = normalized(explicit)
    return F.when(own == "", F.raise_error(F.lit("candidate_id must not be blank"))).otherwise(F.coalesce(own, F.concat(F.lit("candidate_"), F.substring(content_hash(text), 1, 12))))


def file_key(s: Column, default: str | None = None) -> Column:
    """Characters other than letters, digits, dot, dash and underscore become underscores; null or the default if nothing stays."""
    key = F.nullif(F.regexp_replace(F.regexp_replace(F.trim(s), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), F.lit(""))
    return F.coalesce(key, F.lit(default)) if default else key


def ranking_key(candidate: Column, job: Column) -> Column:
    """`candidate_job`; a blank or missing id is an error."""
    c, j = F.nullif(F.trim(candidate), F.lit("")), F.nullif(F.trim(job), F.lit(""))
    return F.when(c.isNotNull() & j.isNotNull(), F.concat_ws("_", c, j)).otherwise(F.raise_error(F.lit("candidate_id and job_id must not be blank")))


def parsed_confidence(text: Column) -> Column:
    """A number in [0, 1], rounded to four places; null if the text is no such number."""
    value = normalized(text).try_cast("double")
    return F.when((value >= 0) & (value <= 1), F.round(value, 4))


def clamped_confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def contains_match(left: Column, right: Column) -> Column:
    """Either contains the other; false if one is empty."""
    return F.coalesce((left != "") & (right != "") & (F.contains(left, right) | F.contains(right, left)), F.lit(False))


def has_any(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def workplace_type(s: Column) -> Column:
    """A profile's workplace label; `home office` is remote here, as it also contains `office`."""
    low = taxonomy_name(s)
    return (
        F.when(has_any(low, ["hybrid"]), "Hybrid")
        .when(has_any(low, ["remote", "work from home", "home office"]), "Remote")
        .when(has_any(low, ["on-site", "onsite", "on site", "office"]), "On-site")
        .otherwise(normalized(s))
    )


def absolute_url(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("http://")) | F.startswith(href, F.lit("https://")), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(base + "/"), href))
