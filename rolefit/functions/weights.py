"""Fixed weight tables of the match score, as plain values and as lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be these for right scores.
STRENGTH = {"core": 1.00, "strong": 0.80, "secondary": 0.55, "exposure": 0.25}
REQUIREMENT = {"required": 1.00, "preferred": 0.60}
LANGUAGE_LEVEL = {"native": 1.0, "fluent": 0.9, "professional": 0.75, "conversational": 0.5, "basic": 0.25, "none": 0.0}
#: What a strength says of a spoken language where a table states no level.
LANGUAGE_OF_STRENGTH = {"core": "native", "strong": "fluent", "secondary": "professional", "exposure": "basic"}
SENIORITY = {"junior": 1, "medior": 2, "senior": 3, "lead": 4, "principal": 5, "staff": 6}
BUCKET = {"skills": 0.40, "languages": 0.10, "protocols": 0.15, "standards": 0.10, "domains": 0.15, "seniority": 0.05, "years": 0.05}
FEATURE_BUCKETS = ("skills", "languages", "protocols", "standards", "domains")
MATCH_THRESHOLD = 0.6


def lookup(table: dict[str, float], label: Column, unknown: float | None = 0.0) -> Column:
    """The label's weight after trimming and lower-casing; `unknown` for other labels and nulls."""
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(entries, F.coalesce(F.lower(F.trim(label)), F.lit(""))), F.lit(unknown))
