"""Validation and merge of extracted items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import weights as W
from rolefit.functions.markup import let
from rolefit.functions.strict import json_kind, json_text, json_texts, strict_json
from rolefit.functions.text import deduped_texts, name_or_empty, parsed_confidence, workplace_type

_RANKS = {"requirement": {"preferred": 0, "required": 1}, "strength": {"exposure": 0, "secondary": 1, "strong": 2, "core": 3}}


def merged_features(items: DataFrame, keys: list[str], level: str) -> DataFrame:
    """One row for each key and normalised name: the highest level by rank, the highest confidence, the first place, all evidence in order.

    `items`: keys, name, pos, `level` (requirement or strength), confidence, evidence (array).
    """
    rank = W.lookup(_RANKS[level], F.col(level), -1)
    named = items.withColumn("name", name_or_empty(F.col("name"))).where("name <> ''")
    merged = named.groupBy(*keys, "name").agg(F.max_by(F.lower(F.trim(level)), rank).alias(level), F.max("confidence").alias("confidence"), F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "evidence"))).alias("e"))
    return merged.select(*keys, "name", level, "confidence", "pos", deduped_texts(F.flatten(F.transform("e", lambda x: x.evidence))).alias("evidence"))


def merged_restrictions(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and normalised value: the highest confidence and the first place, and all evidence in order where `items` has it."""
    named = items.withColumn("value", name_or_empty(F.col("value"))).where("value <> ''")
    merged = named.groupBy(*keys, "value").agg(F.max("confidence").alias("confidence"), F.min("pos").alias("pos"), *_evidence(items))
    return merged.select(*keys, "value", "confidence", "pos", *_united(items))


def _evidence(items: DataFrame) -> list[Column]:
    """The evidence of a group with its places; nothing where the items have none."""
    return [F.sort_array(F.collect_list(F.struct("pos", "evidence"))).alias("_e")] if "evidence" in items.columns else []


def _united(items: DataFrame) -> list[Column]:
    """The texts of `_evidence`, each once, in order."""
    if "evidence" not in items.columns:
        return []
    return [deduped_texts(F.flatten(F.transform("_e", lambda x: F.coalesce(x.evidence, F.array().cast("array<string>"))))).alias("evidence")]


def merged_languages(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and name by a fold in order: a strictly more confident item replaces the level if it has one; a missing level is filled
    by the next; the confidence is the highest so far. The order matters, so the items of a name are folded in their places. Evidence, where
    `items` has it, is united.
    """
    named = items.withColumn("name", name_or_empty(F.col("name"))).where("name <> ''")
    lists = named.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "confidence"))).alias("all"), *_evidence(items))

    def step(state, x):
        level = F.when(x.confidence > state.confidence, F.coalesce(x.level, state.level)).otherwise(F.coalesce(state.level, x.level))
        return F.struct(level.alias("level"), F.greatest(state.confidence, x.confidence).alias("confidence"))

    start = F.struct(F.get("all", F.lit(0)).level.alias("level"), F.get("all", F.lit(0)).confidence.alias("confidence"))
    folded = F.aggregate(F.slice("all", F.lit(2), F.size("all")), start, step)
    return lists.select(*keys, "name", folded.level.alias("level"), folded.confidence.alias("confidence"), F.get("all", F.lit(0)).pos.alias("pos"), *_united(items))


def _backed(item: Column) -> Column:
    """A confidence in [0, 1] and some evidence."""
    return parsed_confidence(item.confidence).isNotNull() & (F.coalesce(F.size(deduped_texts(item.evidence)), F.lit(0)) > 0)


def valid_item(item: Column, levels: dict[str, object], level_field: str) -> Column:
    """A name, a known level, a confidence in [0, 1] and some evidence."""
    return F.coalesce((name_or_empty(item["name"]) != "") & F.lower(F.trim(item[level_field])).isin(*levels) & _backed(item), F.lit(False))


def valid_restriction(item: Column) -> Column:
    """A value that is not blank, a confidence in [0, 1] and some evidence."""
    return F.coalesce((name_or_empty(item.value) != "") & _backed(item), F.lit(False))


def valid_language(item: Column) -> Column:
    """A name, a known level or none, a confidence in [0, 1] and some evidence."""
    level = name_or_empty(item.level)
    return F.coalesce((name_or_empty(item["name"]) != "") & ((level == "") | level.isin(*W.LANGUAGE_LEVEL)) & _backed(item), F.lit(False))


def valid_seniority(item: Column) -> Column:
    """A known value with evidence, or none; a confidence in [0, 1] either way. No item at all is not valid."""
    value = name_or_empty(item.value)
    return F.coalesce(item.isNotNull() & parsed_confidence(item.confidence).isNotNull() & ((value == "") | (value.isin(*W.SENIORITY) & _backed(item))), F.lit(False))


def valid_years(item: Column) -> Column:
    """A whole number of 0 or more with evidence, or none; a confidence in [0, 1] either way. No item at all is not valid."""
    number = item.value.try_cast("int")
    return F.coalesce(item.isNotNull() & parsed_confidence(item.confidence).isNotNull() & (item.value.isNull() | ((number >= 0) & _backed(item))), F.lit(False))


def cleaned_constraints(item: Column) -> Column:
    """A candidate's constraints with normalised lists, each text once whatever its case, and workplace labels by their kind."""
    none = F.array().cast("array<string>")

    def texts(values: Column) -> Column:
        return deduped_texts(F.coalesce(values, none))

    def workplaces(values: Column) -> Column:
        return texts(F.filter(F.transform(F.coalesce(values, none), workplace_type), lambda x: F.coalesce(x, F.lit("")) != ""))

    return F.struct(
        texts(item.preferred_locations).alias("preferred_locations"), texts(item.excluded_locations).alias("excluded_locations"),
        workplaces(item.preferred_workplace_types).alias("preferred_workplace_types"), workplaces(item.excluded_workplace_types).alias("excluded_workplace_types"),
        item.requires_visa_sponsorship.alias("requires_visa_sponsorship"), item.avoid_export_control_roles.alias("avoid_export_control_roles"), texts(item.notes).alias("notes"),
        item.confidence.alias("confidence"), texts(item.evidence).alias("evidence"),
    )


def valid_constraints(item: Column) -> Column:
    """A confidence in [0, 1], and evidence where any constraint is set. `item` is what `cleaned_constraints` returns; no item at all is not valid."""
    lists = ("preferred_locations", "excluded_locations", "preferred_workplace_types", "excluded_workplace_types", "notes")
    stated = item.requires_visa_sponsorship.isNotNull() | item.avoid_export_control_roles.isNotNull()
    for name in lists:
        stated = stated | (F.size(item[name]) > 0)
    return F.coalesce(parsed_confidence(item.confidence).isNotNull() & (~stated | (F.size(item.evidence) > 0)), F.lit(False))


PAYLOAD_FIELDS = (*W.FEATURE_BUCKETS, "restrictions", "seniority")
PROFILE_FIELDS = (*W.FEATURE_BUCKETS, "seniority", "years_experience_total", "candidate_constraints")
_VALUE_FIELDS = ("value", "confidence", "evidence")
_CONSTRAINT_FIELDS = (
    "preferred_locations", "excluded_locations", "preferred_workplace_types", "excluded_workplace_types", "requires_visa_sponsorship", "avoid_export_control_roles", "notes", "confidence", "evidence",
)


#: What a field's value may be, and how it is read; fields that are not named are texts.
_FALSE, _TRUE = ("0", "off", "f", "false", "n", "no"), ("1", "on", "t", "true", "y", "yes")


def _whole_number(v: Column) -> Column:
    """A whole number, also as a text or as a fraction of nothing, or a truth value as 0 or 1."""
    plain = F.try_variant_get(v, "$", "double")
    number = F.when(json_kind(v) == "string", F.regexp_extract(F.trim(json_text(v)), r"^([+-]?[0-9]+)$", 1).try_cast("int")).when(json_kind(v) == "boolean", plain.cast("int"))
    return number.when(json_kind(v) == "number", F.when(plain == F.floor(plain), plain.try_cast("int")))


def _truth(v: Column) -> Column:
    """A truth value, also as one of the usual words or as 0 or 1."""
    word = F.when(json_kind(v) == "string", F.lower(json_text(v))).otherwise(F.try_variant_get(v, "$", "string"))
    return F.when(json_kind(v) == "boolean", F.try_variant_get(v, "$", "boolean")).when(json_kind(v).isin("string", "number"), F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False))


def _field(name: str, nullable: tuple[str, ...], numbers: tuple[str, ...]) -> Callable[[Column], Column]:
    """struct(value, whether its type is allowed) of a field's variant."""

    def read(v: Column) -> Column:
        kind = json_kind(v)
        if name in ("evidence", "notes", *_CONSTRAINT_FIELDS[:4]):
            value = json_texts(v)
        elif name in _CONSTRAINT_FIELDS[4:6]:
            value = _truth(v)
        elif name in numbers:
            value = _whole_number(v)
        elif name == "confidence":
            value = F.when(kind == "boolean", F.try_variant_get(v, "$", "int").cast("string")).when(kind.isin("string", "number"), F.try_variant_get(v, "$", "string"))
        else:
            value = json_text(v)
        empty = (kind == "null") if name in (*nullable, *numbers, *_CONSTRAINT_FIELDS[4:6]) else F.lit(False)
        return F.struct(value.alias("value"), F.coalesce(value.isNotNull() | empty, F.lit(False)).alias("fits"))

    return read


def _read_item(item: Column, fields: tuple[str, ...], rule: Callable[[Column], Column], nullable: tuple[str, ...], numbers: tuple[str, ...] = ()) -> Column:
    """Whether an item, a map of variants, has fields of the right types and meets `rule`."""

    def judged(read: Column) -> Column:
        typed = F.lit(True)
        for name in fields:
            typed = typed & read[name].fits
        return typed & rule(F.struct(*(read[name].value.alias(name) for name in fields)))

    return let(F.struct(*(let(F.try_element_at(item, F.lit(name)), _field(name, nullable, numbers)).alias(name) for name in fields)), judged)


def _same_keys(keys: Column, fields: tuple[str, ...]) -> Column:
    expected = F.array(*(F.lit(f) for f in fields))
    return (F.size(F.array_except(keys, expected)) == 0) & (F.size(F.array_except(expected, keys)) == 0)


def _closed_to(fields: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda m: F.coalesce(_same_keys(F.map_keys(m), fields), F.lit(False))


def _reading(fields: tuple[str, ...], rule: Callable[[Column], Column], nullable: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda m: _read_item(m, fields, rule, nullable)


_Rule = tuple[tuple[str, ...], Callable[[Column], Column]]


def _checked(payloads: DataFrame, lists: dict[str, _Rule], items: dict[str, _Rule], nullable: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Adds `error`; `lists` and `items` give the fields and the rule of each list of items and each single item.

    A payload is JSON from end to end, and types count: a number is no name. `nullable` fields of lists and `value` of items may be null.
    """
    names = (*lists, *items)
    parsed = payloads.withColumn("_m", F.try_variant_get(strict_json(F.col("payload")), "$", "map<string,variant>"))
    keys, expected = F.map_keys("_m"), F.array(*(F.lit(k) for k in names))
    one = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    own = {f"_m_{k}": F.transform(F.try_variant_get(F.try_element_at("_m", F.lit(k)), "$", "array<variant>"), one) for k in lists} | {f"_m_{k}": one(F.try_element_at("_m", F.lit(k))) for k in items}
    parsed = parsed.withColumns(own)
    closed, valid = F.lit(True), F.lit(True)
    for k, (of, rule) in lists.items():
        closed = closed & F.coalesce(F.forall(f"_m_{k}", _closed_to(of)), F.lit(False))
        valid = valid & F.coalesce(F.forall(f"_m_{k}", _reading(of, rule, nullable)), F.lit(False))
    for k, (of, rule) in items.items():
        closed = closed & F.coalesce(_same_keys(F.map_keys(f"_m_{k}"), of), F.lit(False))
        valid = valid & F.coalesce(_read_item(F.col(f"_m_{k}"), of, rule, ("value",), ("value",) if k in numbers else ()), F.lit(False))
    error = (
        F.when(keys.isNull(), "bad_json").when(F.size(F.array_except(expected, keys)) > 0, "missing_fields").when(F.size(F.array_except(keys, expected)) > 0, "unknown_fields")
        .when(~closed, "item_fields").when(~valid, "invalid_item")
    )
    return parsed.withColumn("error", error).drop("_m", *own)


_FEATURE_FIELDS = ("name", "requirement_level", "confidence", "evidence")


def checked_payloads(payloads: DataFrame) -> DataFrame:
    """Adds `error` to `payloads` (job_id, payload): null, or bad_json, missing_fields, unknown_fields, item_fields, invalid_item.

    A payload is one JSON object from end to end; text after it, single quotes or a name that is no string are errors. The schema is closed, that of
    the items too: keys are compared with the expected ones both ways. Bad records are marked, never raised, so
    others go on. A list or item that is null is of wrong fields.
    """
    features = (_FEATURE_FIELDS, lambda x: valid_item(x, W.REQUIREMENT, "requirement_level"))
    return _checked(payloads, dict.fromkeys(W.FEATURE_BUCKETS, features) | {"restrictions": (_VALUE_FIELDS, valid_restriction)}, {"seniority": (_VALUE_FIELDS, valid_seniority)})


def checked_profiles(profiles: DataFrame) -> DataFrame:
    """Adds `error` to `profiles` (candidate_id, payload), with the errors of `checked_payloads`."""
    features = (("name", "strength", "confidence", "evidence"), lambda x: valid_item(x, W.STRENGTH, "strength"))
    lists = dict.fromkeys(W.FEATURE_BUCKETS, features) | {"languages": (("name", "level", "confidence", "evidence"), valid_language)}
    items = {
        "seniority": (_VALUE_FIELDS, valid_seniority), "years_experience_total": (_VALUE_FIELDS, valid_years),
        "candidate_constraints": (_CONSTRAINT_FIELDS, lambda x: valid_constraints(cleaned_constraints(x))),
    }
    return _checked(profiles, lists, items, ("level",), ("years_experience_total",))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def valid_document(candidate: Column, text_hash: Column, version: Column) -> Column:
    """A candidate document's id and version are not blank and its hash has 64 characters."""
    return F.coalesce((name_or_empty(candidate) != "") & (F.length(F.trim(text_hash)) == 64) & (name_or_empty(version) != ""), F.lit(False))
