"""Operator 8: line deduplication by a segment-partition edit join, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm._work import staged

#: Candidate lines up to which their keys are broadcast to the scan that fetches their texts; beyond, a merge join.
BROADCAST_LINES = 200_000
#: Lines that share a segment up to which their pairs are listed; beyond, the texts are joined by segment, in shares of so many lines, and only true links come out.
LISTED_LINES = 32
#: Characters that are counted in every candidate line: one edit changes two counts by one at most. Any set gives the same links; a frequent one rules out more.
COUNTED = "etaoinshrdlucmfgpwbvkyjxzq"
#: Characters of a block: equal blocks at the start and the end of two lines need no check of their edits.
BLOCK = 32


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of an even partition; the last segments take the rest."""
    base, rest = F.floor(length / parts).cast("int"), length % parts
    return 1 + (i - 1) * base + F.greatest(F.lit(0), (i - 1) - (parts - rest)), base + F.when(rest > parts - i, 1).otherwise(0)


def segment_keys(line: Column, length: Column, max_edits: int, min_chars: int) -> tuple[Column, Column]:
    """Arrays of a line's own segment hashes, and of those substrings that a line `0..max_edits` shorter could have as a segment.

    Two lines within `max_edits` edits share one of `max_edits` + 1 segments of the shorter; its place in the longer may shift
    by what the edits on either side allow, which bounds the substrings to probe for each length.
    """
    parts, own, probes = max_edits + 1, [], []
    for less in range(max_edits + 1):
        target = length - less
        for i in range(1, parts + 1):
            start, size = _segment(target, i, parts)
            for shift in range(max(-(i - 1), less - (parts - i)), min(i - 1, less + (parts - i)) + 1):
                key = F.when(target >= min_chars, F.xxhash64(target, F.lit(i), F.substring(line, start + shift, size)))
                (own if less == 0 and shift == 0 else probes).append(key)
    return F.array(*own), F.array(*probes)


def letter_counts(line: Column) -> list[Column]:
    """How often each of `COUNTED` is in a line, as columns n_0, n_1, ..."""
    return [(F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))).alias(f"n_{k}") for k, c in enumerate(COUNTED)]


def counts_allow(max_edits: int) -> Column:
    """On counts a_0, ... and b_0, ...: false only if the counts alone show more than `max_edits` edits."""
    apart = F.lit(0)
    for k in range(len(COUNTED)):
        apart = apart + F.abs(F.col(f"a_{k}") - F.col(f"b_{k}"))
    return apart <= 2 * max_edits


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def banded_distance(x: Column, y: Column, max_edits: int) -> Column:
    """The edit distance of two strings whose lengths differ by `max_edits` at most, exact up to `max_edits` and larger beyond.

    Bit-parallel in a band: bit r of a word stands for the cell of the current column that lies r - `max_edits` rows off the main diagonal, so that the band moves
    down by a shift. Two words hold the vertical differences of +1 and -1; each character of the shorter string takes one step, in which the
    band's matches, as one word, give the diagonal and horizontal differences. The distance is read along the diagonal that ends in the last cell.
    """
    k, width = max_edits, 2 * max_edits + 1
    band = (1 << width) - 1
    first = F.char_length(x) >= F.char_length(y)
    edge = F.array_repeat(F.lit(""), k)
    rows = F.concat(edge, F.split(F.when(first, x).otherwise(y), ""), edge)
    columns = F.split(F.when(first, y).otherwise(x), "")
    more = F.abs(F.char_length(x) - F.char_length(y))

    def matches(cells: Column, c: Column, j: Column) -> Column:
        word = F.lit(0)
        for r in range(width):
            word = word.bitwiseOR(F.when(F.get(cells, j + r) == c, 1 << r).otherwise(0))
        return word

    def step(state: Column, match: Column) -> Column:
        plus, minus = state.plus, state.minus
        diagonal = F.struct(((match.bitwiseAND(plus) + plus).bitwiseXOR(plus)).bitwiseOR(match).bitwiseOR(minus).bitwiseAND(F.lit(band)).alias("d"), plus.alias("p"), minus.alias("m"), state.distance.alias("n"))

        def after(s: Column) -> Column:
            across_plus = s.m.bitwiseOR(F.bitwise_not(s.d.bitwiseOR(s.p))).bitwiseAND(F.lit(band))
            across_minus, down = s.d.bitwiseAND(s.p), F.shiftright(s.d, 1)
            return F.struct(
                across_minus.bitwiseOR(F.bitwise_not(down.bitwiseOR(across_plus)).bitwiseAND(F.lit(band))).alias("plus"), down.bitwiseAND(across_plus).alias("minus"),
                (s.n + 1 - F.getbit(s.d, k + more)).alias("distance"),
            )

        return _once(diagonal, after)

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("plus"), F.lit(0).alias("minus"), more.alias("distance"))
    words = _once(F.struct(rows.alias("rows"), columns.alias("columns")), lambda s: F.transform(s["columns"], lambda c, j: matches(s["rows"], c, j)))
    return F.when(F.least(F.char_length(x), F.char_length(y)) == 0, more).otherwise(F.aggregate(words, start, step, lambda s: s.distance))


def line_blocks(line: Column, length: Column) -> tuple[Column, Column]:
    """Hashes of a line's whole blocks of `BLOCK` characters, counted from its start and from its end."""
    full = F.floor(length / BLOCK).cast("int")
    numbers = F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.xxhash64(F.substring(line, i * BLOCK + 1, BLOCK))), F.transform(numbers, lambda i: F.xxhash64(F.substring(line, length - (i + 1) * BLOCK + 1, BLOCK)))


def _equal_first(x: Column, y: Column) -> Column:
    """How many entries two arrays have in common before the first that differs."""
    differs = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.size(x))


def line_distance(a: str, b: str, max_edits: int) -> Column:
    """`banded_distance` of the columns <a>_line and <b>_line, less the blocks (<a>_head, <a>_tail and those of b) that they begin and end with alike."""

    def rest(p: Column) -> Column:
        shorter = F.least(F.col(f"{a}_n"), F.col(f"{b}_n"))
        cut = p + BLOCK * F.least(_equal_first(F.col(f"{a}_tail"), F.col(f"{b}_tail")), F.floor((shorter - p) / BLOCK).cast("int"))
        return F.struct(*(F.substring(F.col(f"{s}_line"), p + 1, F.col(f"{s}_n") - cut).alias(n) for s, n in ((a, "x"), (b, "y"))))

    rests = F.transform(F.array(BLOCK * _equal_first(F.col(f"{a}_head"), F.col(f"{b}_head"))), rest)
    return _once(F.get(rests, F.lit(0)), lambda r: banded_distance(r["x"], r["y"], max_edits))


def document_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, line_no, line, n, k1, k2): every line of `min_chars` characters or more, trimmed; k1 and k2 are its 128-bit key."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = base.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    return lines.withColumn("n", F.char_length("line")).withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line"))


def line_duplicates(docs: DataFrame, max_edits: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """(doc_id, line_no, n_chars, first_doc_id, first_line_no, n_links, kept, line_hash) for every line of every document; line_hash: of the trimmed line.

    Lines end at newlines; spaces, tabs and carriage returns around them do not count. Equal lines are one class, named by its first occurrence (smallest
    doc_id, then line number). n_links: other classes within `max_edits` edits (characters inserted, deleted or replaced). A line is
    kept if it is its class's first occurrence and no linked class occurs before it. Lines of fewer than `min_chars` characters have 0 links; with
    `short_copies` those that are not empty have classes too, and only their first occurrences are kept, else they are always kept. So are empty lines and
    the lines of null ids. Null texts are one empty line; rows that share an id count as one document; an empty table gives no rows.

    Candidates come from an equi-join on segment hashes, where copies of a line count once; texts are only fetched for candidates. A pair
    whose lengths and letter counts allow it is checked with `banded_distance`. Where more than `LISTED_LINES` lines share a segment, lengths and counts
    are compared inside the join on it, one side of which is dealt out in shares of `LISTED_LINES` lines, so that only pairs they allow come out.
    """
    lines = document_lines(docs, id_col, text_col, min_chars)
    long = lines.where((F.col("n") >= min_chars) & F.col("doc_id").isNotNull())
    own, probes = segment_keys(F.col("line"), F.col("n"), max_edits, min_chars)
    tagged = F.concat(F.transform(own, lambda k: F.struct(k.alias("seg"), F.lit(True).alias("own"))), F.transform(probes, lambda k: F.struct(k.alias("seg"), F.lit(False).alias("own"))))
    keys = long.select("k1", F.explode(tagged).alias("s")).select("s.seg", "k1", "s.own").where("seg is not null").repartition("seg")
    shared = keys.groupBy("seg").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("own").alias("any")).where("low <> high and any").select("seg")
    met = staged(keys.join(shared.hint("shuffle_hash"), "seg").groupBy("seg", "k1").agg(F.max("own").alias("own")), "line-segments")
    crowded = staged(met.groupBy("seg").agg(F.count("*").alias("m")).where(F.col("m") > LISTED_LINES), "line-crowded")
    listed, joined = met.join(crowded.select("seg").hint("merge"), "seg", "left_anti"), met.join(crowded.hint("merge"), "seg").withColumn("shares", F.ceil(F.col("m") / LISTED_LINES).cast("int"))
    x, y = listed.where("own").select("seg", F.col("k1").alias("a")), listed.select("seg", F.col("k1").alias("b"))
    pairs = staged(y.join(x.hint("merge"), "seg").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    wanted = staged(pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).union(joined.select("k1")).distinct(), "line-keys")
    few = wanted.count() <= BROADCAST_LINES
    texts = long.select("k1", "k2", "line", "n").join(F.broadcast(wanted) if few else wanted.hint("merge"), "k1").dropDuplicates(["k1", "k2"])
    head, tail = line_blocks(F.col("line"), F.col("n"))
    texts = staged(texts.select("*", head.alias("head"), tail.alias("tail"), *letter_counts(F.col("line"))), "line-texts")
    able = (F.abs(F.col("a_n") - F.col("b_n")) <= max_edits) & counts_allow(max_edits)
    narrow = ["n", *(f"n_{k}" for k in range(len(COUNTED)))]

    def side(s: str, columns: list[str]) -> DataFrame:
        return texts.select(F.col("k1").alias(s), F.col("k2").alias(s + "2"), *(F.col(c).alias(f"{s}_{c.removeprefix('n_')}") for c in columns))

    x = joined.where("own").select("seg", F.pmod(F.xxhash64("k1"), F.col("shares")).cast("int").alias("share"), F.col("k1").alias("a")).join(side("a", narrow).hint("merge"), "a")
    y = joined.select("seg", F.col("k1").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(side("b", narrow).hint("merge"), "b")
    allowed = x.join(y.hint("merge"), ["seg", "share"]).where((F.struct("a", "a2") != F.struct("b", "b2")) & able)
    pairs = staged(pairs.union(allowed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "line-allowed")
    wide = ["line", "head", "tail", *narrow]
    both = pairs.join(side("a", wide).hint("merge"), "a").join(side("b", wide).hint("merge"), "b").where((F.struct("a", "a2") != F.struct("b", "b2")) & able)
    links = both.where(line_distance("a", "b", max_edits) <= max_edits).select("a", "a2", "b", "b2").distinct()
    links = staged(links.union(links.select("b", "b2", "a", "a2")), "line-links")

    least = min(1, min_chars) if short_copies else min_chars
    classed = lines.where((F.col("n") >= least) & F.col("doc_id").isNotNull())
    firsts = classed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    near = links.select(F.col("a").alias("k1"), F.col("a2").alias("k2"), "b", "b2")
    other = firsts.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("first").alias("other"))
    near = near.join(other.hint("merge"), ["b", "b2"]).groupBy("k1", "k2").agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    known = firsts.join(near.hint("merge"), ["k1", "k2"], "left")
    spots = classed.select("doc_id", "line_no", "n", "k1", "k2").join(known.hint("merge"), ["k1", "k2"])
    kept = (F.struct("doc_id", "line_no") == F.col("first")) & (F.col("other").isNull() | (F.col("first") < F.col("other")))
    out = spots.select("doc_id", "line_no", F.col("n").cast("long").alias("n_chars"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), F.col("k1").alias("line_hash"))
    rest = lines.where((F.col("n") < least) | F.col("doc_id").isNull())
    return out.union(rest.select("doc_id", "line_no", F.col("n").cast("long"), F.col("doc_id"), F.col("line_no"), F.lit(0).cast("long"), F.lit(True), F.col("k1")))


def without_repeated_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20, short_copies: bool = False) -> DataFrame:
    """`docs` (doc_id, text, n_chars and any other columns) with the lines that `line_duplicates` does not keep taken out of the texts.

    A document that loses all its lines is left out. n_chars is set to the new text's length where there is such a column. Null texts and null ids stay as
    they are. Rows that share an id keep their own lines: what goes is named by id, line number and line, so that equal rows lose or keep the same lines
    and a line of one row never goes for that of another.
    """
    taken = line_duplicates(docs, max_edits, min_chars, short_copies=short_copies).where("not kept")
    gone = staged(taken.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set(F.struct("line_no", "line_hash")).alias("_gone")), "lines-gone")
    joined = docs.join(gone.hint("merge"), docs.doc_id.cast("long") == gone["_gone_id"], "left")
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", F.struct(i.alias("line_no"), F.xxhash64(F.btrim(x, F.lit(" \t\r"))).alias("line_hash"))))
    joined = joined.withColumn("_rest", F.when(F.col("_gone").isNotNull(), rest)).where("_rest is null or size(_rest) > 0")
    out = joined.withColumn("text", F.coalesce(F.array_join("_rest", "\n"), "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_rest").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
