"""Markup read as a stream of tokens that is folded with a stack of open elements: scopes, nesting and first matches, in column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.text import normalized

# The names of elements as markup defines them.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "svg", "time", "tt", "u", "var", "wbr",
)
#: Elements that an open tag ends if they are innermost, beside a paragraph, which any block ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
RAW = ("script", "style", "noscript", "template", "textarea", "iframe")

#: A token: a comment or declaration, an element whose content is no markup, a tag, or text. A quoted value may hold what ends a tag; where a quote
#: is never closed the tag ends at the next `>`, a tag without one takes the rest of the page, and an unclosed raw element is a tag. Possessive, so the time grows with the length.
_TOKEN = (
    rf"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*+>?|<({'|'.join(RAW)})\b[^>]*+>(?:(?!<(?:/\1|\1)\b)[\s\S])*+</\1\s*+>|"
    r"</?[a-z][^\s/>]*+(?:[^\"'>]++|\"[^\"<]{0,5000}+\"|'[^'<]{0,5000}+')*+>|</?[a-z][^>]*+(?:>|\z)|<|[^<]++"
)
#: Elements deeper than this are taken as siblings, as browsers take them.
MOST_DEPTH = 512
_NAME = r"^</?([a-zA-Z][^\s/>]*)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _map_of(pairs: dict[str, str]) -> Column:
    """A constant map; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character of a code point, U+FFFD where there is none; 128 to 159 are those of Windows-1252, as browsers read them."""
    cp1252 = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(number.between(128, 159), F.try_element_at(_map_of(cp1252), number.cast("string"))).otherwise(plain)


def _reference(piece: Column) -> Column:
    """A piece of text that starts with `&`, its character reference decoded."""
    decimal, hexadecimal = F.regexp_extract(piece, r"^&#([0-9]{1,8});?", 1), F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,7});?", 1)
    name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*;?)", 1)
    numbered = F.when(decimal != "", decimal.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
    named = F.try_element_at(_map_of(html5), name)
    rest = F.regexp_replace(piece, r"^&(?:#[xX][0-9a-fA-F]{1,7}|#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]*);?", "")
    return F.when(numbered.isNotNull(), F.concat(_code_point(numbered), rest)).when(named.isNotNull(), F.concat(named, rest)).otherwise(piece)


def decoded(text: Column) -> Column:
    """`text` with all numeric and named character references decoded, those of old names without a semicolon too; unknown ones stay."""
    pieces = F.split(text, "(?=&)")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")), _reference(p)).otherwise(p)), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's attribute, with quotes of either kind or none; null without it or where it is empty."""
    found = rf"(?is)^<[a-z][^\s/>]*+(?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*?[\s\"'/]{name}\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))"
    value = F.concat(*(F.regexp_extract(tag, found, k) for k in (1, 2, 3)))
    return F.nullif(decoded(value), F.lit(""))


def has_class(tag: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(tag, "class"), r"\s+"), name), F.lit(False))


def tokens(html: Column) -> Column:
    """array<struct<kind, name, tag, text, size>> in the order of the page. Kinds: open, close, text, break (the mark of a block's edge in the text).

    Raw elements, comments and declarations are left out. `text` is decoded; `size` counts what is no white space. A void element is a break or nothing.
    """

    def token(raw: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, _NAME, 1))
        markup = name != ""
        kind = (
            F.when(~markup, F.when(F.startswith(raw, F.lit("<!")) | F.startswith(raw, F.lit("<?")), "none").otherwise("text"))
            .when(~F.endswith(raw, F.lit(">")), "none").when(F.startswith(raw, F.lit("</")), "close").when((name.isin(*RAW) & F.contains(raw, F.lit("</"))) | (name.isin(*VOID) & name.isin(*INLINE)), "none").when(name.isin(*VOID), "break").otherwise("open")
        )
        text = F.when(markup, F.when(name.isin(*INLINE), "").otherwise("\n")).otherwise(decoded(raw))
        size = F.when(markup, 0).otherwise(F.length(F.regexp_replace(text, r"(?U)\s+", "")))
        return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "open", raw).alias("tag"), text.alias("text"), size.alias("size"))

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), token), lambda t: t.kind != "none")


def text_of(stream: Column, first: Column, last: Column) -> Column:
    """The normalised text of tokens first .. last, counted from 1."""
    return normalized(F.array_join(F.transform(F.slice(stream, first, F.greatest(last - first + 1, F.lit(0))), lambda t: t.text), ""))


_TAG = "struct<at:int,depth:int,inner:int,first:int,last:int>"
_LABEL = "struct<depth:int,first:int,last:int>"


def structure(stream: Column, wrapper: str, item: str, value: str, labels: list[str]) -> Column:
    """struct(tags array<struct<at, first, last>>, labels array<struct<first, last>>), in places of `stream` from 1 on, by one fold over it.

    `tags`: every element of class `item` inside an element of class `wrapper`: its tag's place, and the places of what its first element of class
    `value` holds (null if it has none). `labels`: for each label, the parent of the first element whose whole text is the label and that has no child
    for which that holds too; null places if there is none. Elements that are never closed end with the page or with the element around them. The state
    holds the open elements and what was found, not the stream, as Spark copies it at every step.
    """
    bits = [1 << k for k in range(len(labels))]
    sizes = [len("".join(x.split())) for x in labels]
    root = F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).alias("hits")))
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(0).alias("wrap"), root.alias("open"), F.array().cast(f"array<{_TAG}>").alias("tags"),
        F.array(*(F.lit(None).cast(_LABEL) for _ in labels)).cast(f"array<{_LABEL}>").alias("labels"),
    )

    def having(s: Column, **new: Column) -> Column:
        return F.struct(*(new.get(f, s[f]).alias(f) for f in ("i", "size", "wrap", "open", "tags", "labels")))

    def closed(s: Column, depth: Column) -> Column:
        """The state with only the `depth` outermost elements open; the others end before token i + 1, innermost first."""

        def one(state: Column, own: Column) -> Column:
            """`state`: hits of the child before, depth of `own`, labels."""
            hits = own.hits.bitwiseOR(state.hits)
            fits = [(s.size - own.size == n) & (text_of(stream, own.at + 1, s.i) == x) for n, x in zip(sizes, labels, strict=True)]
            parent = F.get(s.open, state.depth - 2)
            found = [
                F.when(F.get(state.labels, F.lit(k)).isNull() & fit & (hits.bitwiseAND(F.lit(b)) == 0) & parent.isNotNull(), F.struct((state.depth - 1).alias("depth"), (parent.at + 1).alias("first"), F.lit(None).cast("int").alias("last")))
                .when(F.get(state.labels, F.lit(k)).depth.eqNullSafe(state.depth) & F.get(state.labels, F.lit(k)).last.isNull(), F.struct(F.get(state.labels, F.lit(k)).depth.alias("depth"), F.get(state.labels, F.lit(k)).first.alias("first"), s.i.alias("last")))
                .otherwise(F.get(state.labels, F.lit(k)))
                for k, (b, fit) in enumerate(zip(bits, fits, strict=True))
            ]
            told = sum((F.when(fit, b).otherwise(0) for b, fit in zip(bits, fits, strict=True)), F.lit(0))
            return F.struct(told.cast("int").alias("hits"), (state.depth - 1).alias("depth"), F.array(*found).cast(f"array<{_LABEL}>").alias("labels"))

        ending = F.reverse(F.slice(s.open, depth + 1, F.size(s.open)))
        begun = F.struct(F.lit(0).alias("hits"), F.size(s.open).alias("depth"), s.labels.alias("labels"))

        def left(done: Column) -> Column:
            kept = F.transform(F.slice(s.open, F.lit(1), depth), lambda o, k: F.when(k == depth - 1, F.struct(o["name"].alias("name"), o.at.alias("at"), o.size.alias("size"), o.hits.bitwiseOR(done.hits).alias("hits"))).otherwise(o))
            ended = F.transform(s.tags, lambda t: F.struct(
                t.at.alias("at"), F.when(t.depth > depth, 0).otherwise(t.depth).alias("depth"), t.inner.alias("inner"), t.first.alias("first"), F.when((t.inner > depth) & t.last.isNull(), s.i).otherwise(t.last).alias("last")))
            return having(s, open=kept, wrap=F.when(s.wrap > depth, 0).otherwise(s.wrap), tags=ended, labels=done.labels)

        return let(F.aggregate(ending, begun, one), left)

    def opened(s: Column, t: Column) -> Column:
        top = F.get(s.open, F.size(s.open) - 1)["name"]
        ends = ((top == "p") & ~t["name"].isin(*INLINE)) | (F.size(s.open) > MOST_DEPTH)
        for name, others in ENDS.items():
            ends = ends | ((t["name"] == name) & top.isin(*others))
        return let(F.when(F.coalesce(ends, F.lit(False)), closed(s, F.size(s.open) - 1)).otherwise(s), lambda x: pushed(x, t))

    def pushed(s: Column, t: Column) -> Column:
        here, depth = s.i + 1, F.size(s.open) + 1
        classed = F.contains(t.tag, F.lit(item)) | F.contains(t.tag, F.lit(value)) | F.contains(t.tag, F.lit(wrapper))
        is_value = classed & has_class(t.tag, value)
        valued = F.transform(s.tags, lambda x: F.when(is_value & (x.depth > 0) & x.first.isNull(), F.struct(
            x.at.alias("at"), x.depth.alias("depth"), depth.alias("inner"), (here + 1).alias("first"), F.lit(None).cast("int").alias("last"))).otherwise(x))
        own = F.struct(here.alias("at"), depth.alias("depth"), F.lit(0).alias("inner"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        tags = F.when(classed, F.when((s.wrap > 0) & has_class(t.tag, item), F.concat(valued, F.array(own))).otherwise(valued)).otherwise(s.tags)
        wrap = F.when((s.wrap == 0) & classed & has_class(t.tag, wrapper), depth).otherwise(s.wrap)
        new = F.struct(t["name"].alias("name"), here.alias("at"), s.size.alias("size"), F.lit(0).alias("hits"))
        return having(s, i=here, wrap=wrap, open=F.concat(s.open, F.array(new)), tags=tags)

    def shut(s: Column, t: Column) -> Column:
        names = F.reverse(F.transform(s.open, lambda o: o["name"]))
        place = F.array_position(names, t["name"]).cast("int")
        return let(F.when(place > 0, closed(s, F.size(s.open) - place)).otherwise(s), lambda x: having(x, i=x.i + 1))

    def step(s: Column, t: Column) -> Column:
        return F.when(t.kind == "open", opened(s, t)).when(t.kind == "close", shut(s, t)).otherwise(having(s, i=s.i + 1, size=s.size + t.size))

    last = F.aggregate(stream, start, step, lambda s: closed(s, F.lit(0)))
    places = lambda xs: F.transform(xs, lambda x: F.struct(x.first.alias("first"), x.last.alias("last")))
    return let(last, lambda s: F.struct(F.transform(s.tags, lambda t: F.struct(t.at.alias("at"), t.first.alias("first"), t.last.alias("last"))).alias("tags"), places(s.labels).alias("labels")))
