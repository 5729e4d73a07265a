"""Fields of vacancy pages: tags, JSON-LD, labelled values, requirement lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.extract import first_mentions, requirement_level
from rolefit.functions.markup import attribute, let, structure, text_of, tokens
from rolefit.functions.strict import json_kind, strict_json
from rolefit.functions.text import normalized, taxonomy_name

# Class names, labels, headings and line starts that must be these for right results.
_LD_BLOCK = r"(?is)<script[^>]*\stype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
TAG_CLASSES = ("job-tags-wrapper", "job-tag", "job-tag-value")
SECTION_START = "What do you bring to the table?"
SECTION_END = "What can you expect in return"
_LINE_STARTS = r"\s+(?=(?:You (?:have|are|understand|know|can)|Knowledge of|Experience with)\b)"
LANGUAGES = ("Dutch", "English", "German", "French", "Spanish", "Italian", "Portuguese", "Polish", "Chinese", "Japanese")


def _filled(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def read_page(html: Column, labels: dict[str, str] | None = None) -> Column:
    """struct(tags map<string,string>, and a string for each name in `labels`), by one pass over the page's markup.

    Tags are the elements of the tag class inside a wrapper: the key is the normalised `data-type`, else `title`, the value the text of the first
    element of the value class inside; tags without either are left out, the last of a key wins. A labelled value is what follows the label in the parent of the
    first element whose whole text is the label, without colons and white space around it; null where that parent's text starts otherwise. Pages without a label and without
    the wrapper are not parsed.
    """
    labels = labels or {}
    wrapper, _, _ = TAG_CLASSES
    worth = F.contains(html, F.lit(wrapper))
    for label in labels.values():
        worth = worth | html.rlike(r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in w) for w in label.split()))

    def read(stream: Column, s: Column) -> Column:
        entries = F.transform(s.tags, lambda t: F.struct(_tag_key(F.get(stream, t.at - 1).tag).alias("key"), F.coalesce(text_of(stream, t.first, t.last), F.lit("")).alias("value")))
        filled = F.filter(entries, lambda e: (e.key != "") & (e.value != ""))
        tags = let(filled, lambda own: F.map_from_entries(F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda later: later.key == e.key))))
        places = [F.get(s.labels, F.lit(k)) for k in range(len(labels))]
        values = [_after_label(text_of(stream, x.first, x.last), label).alias(name) for x, (name, label) in zip(places, labels.items(), strict=True)]
        return F.struct(tags.alias("tags"), *values)

    parsed = let(tokens(html), lambda stream: let(structure(stream, *TAG_CLASSES, list(labels.values())), lambda s: read(stream, s)))
    none = F.struct(F.create_map().cast("map<string,string>").alias("tags"), *(F.lit(None).cast("string").alias(x) for x in labels))
    return F.when(worth, parsed).otherwise(none)


def _after_label(block: Column, label: str) -> Column:
    return F.when(F.startswith(F.lower(block), F.lit(label.lower())), _filled(F.btrim(F.substring(block, len(label) + 1, 1 << 30), F.lit(" :\n\t"))))


def job_tags(html: Column) -> Column:
    """The tags of `read_page`."""
    return read_page(html)["tags"]


def labelled_value(html: Column, label: str) -> Column:
    """One labelled value of `read_page`."""
    return read_page(html, {"value": label})["value"]


def _tag_key(tag: Column) -> Column:
    return F.coalesce(taxonomy_name(F.coalesce(attribute(tag, "data-type"), attribute(tag, "title"))), F.lit(""))


def _as_text(v: Column) -> Column:
    """A JSON value as the text that the reference's language gives it: null is None, truth values have capitals, lists of texts keep their quotes."""
    kind, none = json_kind(v), F.lit("None")
    texts = F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    plain = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull(), "").when(kind == "null", none).when(kind == "boolean", F.initcap(plain)).when(kind == "array", texts).otherwise(plain)


def job_posting(html: Column) -> Column:
    """struct(location, country, employment_type) of the first JSON-LD node of type JobPosting, whatever its case; lists are expanded, blocks that
    are not JSON from end to end skipped; a missing or blank value is null, a JSON null the text None, as is all of a page without such a node null.
    """
    blocks = F.transform(F.regexp_extract_all(html, F.lit(_LD_BLOCK), F.lit(1)), strict_json)
    lists = F.transform(blocks, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    objects = F.transform(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    node = F.get(F.filter(objects, lambda m: m.isNotNull() & (F.coalesce(taxonomy_name(_as_text(F.try_element_at(m, F.lit("@type")))), F.lit("")) == "jobposting")), F.lit(0))

    def fields(m: Column) -> Column:
        address = F.try_variant_get(F.try_element_at(F.try_variant_get(F.try_element_at(m, F.lit("jobLocation")), "$", "map<string,variant>"), F.lit("address")), "$", "map<string,variant>")
        values = {"location": F.try_element_at(address, F.lit("addressLocality")), "country": F.try_element_at(address, F.lit("addressCountry")), "employment_type": F.try_element_at(m, F.lit("employmentType"))}
        return F.struct(*(_filled(normalized(_as_text(v))).alias(name) for name, v in values.items()))

    return let(node, fields)


def job_metadata(tags: Column, posting: Column) -> Column:
    """struct(location, country, educational_background, fulltime_parttime) from `job_tags` and `job_posting`: tags come before JSON-LD;
    the education comes from tags alone, the country from JSON-LD alone.
    """
    return F.struct(
        F.coalesce(F.try_element_at(tags, F.lit("location")), posting.location).alias("location"), posting.country.alias("country"),
        F.try_element_at(tags, F.lit("education level")).alias("educational_background"),
        F.coalesce(F.try_element_at(tags, F.lit("employment")), posting.employment_type).alias("fulltime_parttime"),
    )


def requirement_lines(text: Column) -> Column:
    """struct(required, preferred): lines of the requirement section (all of the text after its heading where no next heading follows). A section
    in one line is split before the starts of sentences that tell requirements. Without a section both lists are empty.
    """
    # [\s\S] in place of a dot: sections span lines
    section = F.regexp_extract(text, rf"(?i){SECTION_START.replace('?', '[?]')}([\s\S]*?)(?:{SECTION_END}|\z)", 1)
    lines = F.filter(F.transform(F.split(section, r"\r\n|\r|\n"), normalized), lambda x: x != "")
    flat = let(lines, lambda x: F.when(F.size(x) == 1, F.split(F.get(x, F.lit(0)), _LINE_STARTS)).otherwise(x))
    found = F.transform(F.coalesce(flat, F.array().cast("array<string>")), lambda x: F.struct(x.alias("line"), requirement_level(x).alias("level")))
    of = lambda told, level: F.transform(F.filter(told, lambda x: x.level == level), lambda x: x.line).alias(level)
    return let(found, lambda told: F.struct(of(told, "required"), of(told, "preferred")))


def spoken_languages(required: Column, preferred: Column) -> Column:
    """struct(required, preferred): languages named in the lines, in order of first mention; one that is required is not preferred too."""
    names = {n: rf"(?i)\b{n}\b" for n in LANGUAGES}
    other = first_mentions([F.array_join(preferred, " ")], names)
    return let(first_mentions([F.array_join(required, " ")], names), lambda asked: F.struct(asked.alias("required"), F.array_except(other, asked).alias("preferred")))
