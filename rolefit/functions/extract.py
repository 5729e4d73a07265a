"""Rule-based extraction from texts and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.markup import let
from rolefit.functions.text import has_any, normalized, taxonomy_name

# Patterns, names and phrases that must be these for right results.
_RANGE = r"(?i)\b(\d+)\s*(?:-|–|—|to)\s*(\d+)\s*years?\b"
_AT_LEAST = r"(?i)\b(?:at least|minimum of|min\.?)\s*(\d+)\s*years?\b"
_PLUS = r"(?i)\b(\d+)\+\s*years?\b"
_SINGLE = r"(?i)\b(\d+)\s*years?\b"
_HOURS_RANGE = r"(?i)\b(\d+)\s*(?:-|–|—|to)\s*(\d+)\s*(?:hours?|hrs?)\s*(?:per week|working week)\b"
_HOURS_SINGLE = r"(?i)\b(\d+)\s*(?:hours?|hrs?)\s*(?:per week|working week)\b"
DEGREES = {
    "Secondary vocational education": r"(?i)\b(?:secondary vocational education|secondary vocational|mbo(?:-\d+)?)\b",
    "Associate": r"(?i)\bassociate(?:'s|’s)?\b",
    "Bachelor": r"(?i)\bbachelor(?:'s|’s)?\b",
    "Master": r"(?i)\bmaster(?:'s|’s)?\b",
    "PhD": r"(?i)\b(?:phd|ph\.d\.|doctorate|doctoral)\b",
}
DOMAINS = {
    "Semiconductor": r"(?i)\bsemiconductor\b",
    "Analytical": r"(?i)\banalytical\b|\banalytics\b",
    "Medical": r"(?i)\bmedical\b|\bmedtech\b",
    "Energy": r"(?i)\benergy\b",
    "Aerospace": r"(?i)\baerospace\b",
    "Automotive": r"(?i)\bautomotive\b",
    "Defense": r"(?i)\bdefen[cs]e\b",
    "Industrial": r"(?i)\bindustrial\b",
    "High-tech": r"(?i)\bhigh[- ]tech\b",
}
EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
GDPR_MARKER = "gdpr regulations."
PHONE = r"\+\d[\d ()-]{6,}\d"
ROLE_TOKENS = ("senior", "talent", "recruitment", "recruiter", "manager", "acquisition", "advisor", "specialist", "partner", "lead")
PREFERRED_PHRASES = ("is a plus", "are a plus", "nice to have", "preferred", "preferably", "would be nice")
CITIZEN_PHRASES = ("citizen", "citizenship", "nationality")
CONTROLLED_PHRASES = ("security clearance", "clearance", "controlled technology", "export administration regulations", "export control", "ear")
AUTHORIZATION_PHRASES = ("work authorization", "work authorisation", "legally authorized", "legally authorised", "visa", "sponsorship")
CLIENT_SITE_PHRASES = ("clients' sites", "clients’ sites", "clients' premises", "clients’ premises", "client sites", "client site", "customer sites", "customer site")
_WORK_LOCATION = r"(?i)(From our .*?)(?:,?\s+you\s+(?:will\s+)?work\b|,?\s+you\s+like\s+to\s+keep\s+yourself\s+busy\s+with\b|$)"
_TRAVEL = (
    r"\bmainly in the ([A-Z][A-Za-z0-9' -]+? area)\b",
    r"\bwithin the ([A-Z][A-Za-z0-9' -]+? region(?: and beyond)?)\b",
    r"\bin the ([A-Z][A-Za-z0-9' -]+? region)\b",
    r"\bin (Southern Germany, Austria and Switzerland)\b",
)


def _number(s: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("int")


def _found(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def _bounds(low: Column, high: Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"))


def experience_years(text: Column) -> Column:
    """struct(low, high): a range, else at least, else n+, else a single number (both bounds); nulls if nothing is found."""
    s, none = normalized(text), F.lit(None).cast("int")
    return (
        F.when(s.rlike(_RANGE), _bounds(_number(s, _RANGE, 1), _number(s, _RANGE, 2)))
        .when(s.rlike(_AT_LEAST), _bounds(_number(s, _AT_LEAST, 1), none))
        .when(s.rlike(_PLUS), _bounds(_number(s, _PLUS, 1), none))
        .otherwise(_bounds(_number(s, _SINGLE, 1), _number(s, _SINGLE, 1)))
    )


def sentences(text: Column) -> Column:
    return F.split(normalized(text), r"(?<=[.!?])\s+")


def experience_fields(labelled: Column, description: Column) -> Column:
    """struct(low, high, text): the first of the labelled value and the sentences on experience that has years; else the first text."""
    told = F.filter(sentences(F.coalesce(description, F.lit(""))), lambda x: F.contains(F.lower(x), F.lit("experience")))
    texts = F.concat(F.when(F.coalesce(labelled, F.lit("")) != "", F.array(labelled)).otherwise(F.array().cast("array<string>")), told)
    parsed = F.transform(texts, lambda x: F.struct(experience_years(x).alias("years"), normalized(x).alias("text")))
    hit = F.get(F.filter(parsed, lambda p: p.years.low.isNotNull() | p.years.high.isNotNull()), F.lit(0))
    return F.struct(hit.years.low.alias("low"), hit.years.high.alias("high"), F.coalesce(hit.text, F.nullif(normalized(F.get(texts, F.lit(0))), F.lit(""))).alias("text"))


def hours_per_week(text: Column) -> Column:
    s = normalized(text)
    return F.when(s.rlike(_HOURS_RANGE), _bounds(_number(s, _HOURS_RANGE, 1), _number(s, _HOURS_RANGE, 2))).otherwise(_bounds(_number(s, _HOURS_SINGLE, 1), _number(s, _HOURS_SINGLE, 1)))


def first_mentions(texts: list[Column], names: dict[str, str]) -> Column:
    """Names in order of (text, first place, name), each once."""
    places = [let(normalized(F.coalesce(t, F.lit(""))), lambda s, k=k: F.array(*(F.struct(F.lit(k).alias("k"), F.regexp_instr(s, F.lit(p)).alias("at"), F.lit(n).alias("name")) for n, p in names.items()))) for k, t in enumerate(texts)]
    return F.array_distinct(F.transform(F.array_sort(F.filter(F.concat(*places), lambda x: x.at > 0)), lambda x: x["name"]))


def required_degrees(background: Column, description: Column) -> Column:
    return first_mentions([background, description], DEGREES)


def industry_domains(text: Column) -> Column:
    return first_mentions([text], DOMAINS)


def remote_policy(label: Column, description: Column) -> Column:
    """From the label, else from the description; a label of `home office` is on-site, a description with it is hybrid."""
    l, d = F.coalesce(taxonomy_name(label), F.lit("")), F.coalesce(taxonomy_name(description), F.lit(""))
    return (
        F.when(has_any(l, ["hybrid"]), "Hybrid")
        .when(has_any(l, ["remote"]), "Remote")
        .when(has_any(l, ["on-site", "onsite", "on site", "office"]), "On-site")
        .when(has_any(d, ["fully remote", "100% remote", "remote-first"]), "Remote")
        .when(has_any(d, ["work from home", "working from home", "home office"]), "Hybrid")
        .when(has_any(d, ["on-site", "onsite", "on site"]), "On-site")
    )


def _stripped(s: Column) -> Column:
    return F.btrim(s, F.lit(" ,.:;"))


def work_location(description: Column) -> Column:
    """struct(place, client_site, travel_region); client_site is null where no phrase tells."""
    s = normalized(F.coalesce(description, F.lit("")))
    place = _stripped(_found(s, _WORK_LOCATION))
    at_client = has_any(F.lower(F.coalesce(place, s)), CLIENT_SITE_PHRASES)
    return F.struct(place.alias("place"), F.when(at_client, True).when(place.isNotNull(), False).alias("client_site"), _stripped(F.coalesce(*(_found(s, p) for p in _TRAVEL))).alias("travel_region"))


def recruiter_contact(description: Column) -> Column:
    """struct(name, role, email, phone) around the first e-mail address, from the 240 characters before it."""
    s = normalized(F.coalesce(description, F.lit("")))
    email = _found(s, EMAIL, 0)
    at = F.regexp_instr(s, F.lit(EMAIL))
    start = F.greatest(F.lit(1), at - 240)
    window = F.trim(F.substring(s, start, at + F.length(email) - start))
    phone = _found(window, PHONE, 0)
    before = F.substring(window, F.lit(1), F.instr(window, F.coalesce(phone, email)) - 1)
    identity = _stripped(before)
    tail = F.element_at(F.split(F.lower(identity), GDPR_MARKER.replace(".", r"\.")), -1)
    identity = normalized(F.when(F.contains(F.lower(identity), F.lit(GDPR_MARKER)), _stripped(F.right(identity, F.length(tail)))).otherwise(identity))
    words = F.filter(F.split(identity, " "), lambda x: x != "")
    roles = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,:;")).isin(*ROLE_TOKENS))
    cut = F.array_position(roles, True)
    name = F.when(cut == 0, identity).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(cut - 1, F.lit(0))), " "))
    role = F.when(cut > 0, F.array_join(F.slice(words, F.greatest(cut, F.lit(1)), F.size(words)), " "))
    hit = email.isNotNull()
    return F.struct(F.when(hit, F.nullif(name, F.lit(""))).alias("name"), F.when(hit, F.nullif(role, F.lit(""))).alias("role"), email.alias("email"), F.when(hit, normalized(phone)).alias("phone"))


def requirement_level(text: Column) -> Column:
    s = F.nullif(taxonomy_name(F.coalesce(text, F.lit(""))), F.lit(""))
    return let(s, lambda s: F.when(s.isNull(), None).when(has_any(s, PREFERRED_PHRASES), "preferred").otherwise("required"))


def restriction_class(text: Column) -> Column:
    """Citizenship, then controlled technology (any text with `ear` in it), then work authorization, else restriction."""
    s = taxonomy_name(F.coalesce(text, F.lit("")))
    return F.when(has_any(s, CITIZEN_PHRASES), "citizenship").when(has_any(s, CONTROLLED_PHRASES), "controlled_technology").when(has_any(s, AUTHORIZATION_PHRASES), "work_authorization").otherwise("restriction")


def page_text(markup: Column) -> Column:
    """Text of a piece of markup: scripts, styles and comments go, tags become spaces."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return normalized(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def page_title(html: Column) -> Column:
    return F.nullif(page_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def page_description(html: Column, least: int = 200) -> Column:
    """Text of the first of main, article and body with more than `least` characters; else empty."""
    parts = [page_text(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)(?:</{t}>|\z)", 1)) for t in ("main", "article", "body")]
    return F.coalesce(*(F.when(F.length(p) > least, p) for p in parts), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
