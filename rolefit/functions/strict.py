"""JSON taken strictly: whole texts only, and types kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value from end to end; null for all others, those with text after the value among them.

    Spark's parser stops after the first value, so the text is parsed inside a list and inside an object: what breaks out of one breaks the other.
    Repeated keys and numbers that JSON lacks (NaN) are refused.
    """
    in_list, in_object = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def json_kind(v: Column) -> Column:
    """string, number, boolean, null, array or object; null for no value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(kind.isNotNull(), "number")
    )


def json_text(v: Column) -> Column:
    """A JSON string's text; null for all other values."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_texts(v: Column) -> Column:
    """The texts of a JSON list of strings; null for all other values, a list with anything else in it among them."""
    values = F.try_variant_get(v, "$", "array<variant>")
    return F.when(F.forall(values, lambda x: F.schema_of_variant(x) == "STRING"), F.transform(values, lambda x: F.try_variant_get(x, "$", "string")))
