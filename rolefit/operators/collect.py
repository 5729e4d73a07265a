"""Reconciling collected link sets: facets, pages, limits and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.functions.extract import hrefs
from rolefit.functions.text import absolute_url


def harvested_links(pages: DataFrame, base: str, pattern: str) -> DataFrame:
    """(url): distinct absolute links of the pages' html that match `pattern`."""
    links = pages.select(F.explode(hrefs(F.col("html"))).alias("href")).select(absolute_url(F.col("href"), base).alias("url"))
    return links.where(F.col("url").rlike(pattern)).distinct()


def facet_listing(pages: DataFrame, base: str) -> DataFrame:
    """(facet, url, expected) from anchors `<a href=..>name (n)</a>`; -1 where no number is given; anchors without href are skipped."""
    anchors = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'(<a [^>]*href="[^"]+"[^>]*>[^<]*</a>)'), F.lit(1))).alias("a"))
    count = F.regexp_extract("a", r"\((\d+)\)\s*</a>", 1)
    return anchors.select(F.trim(F.regexp_extract("a", r">([^<(]*)", 1)).alias("facet"), absolute_url(F.regexp_extract("a", r'href="([^"]+)"', 1), base).alias("url"), F.when(count.rlike("^[0-9]+$"), count.cast("int")).otherwise(-1).alias("expected"))


def discipline_map(links: DataFrame) -> DataFrame:
    """(url, disciplines): the sorted facets of every url of `links` (facet, url)."""
    return links.groupBy("url").agg(F.sort_array(F.collect_set("facet")).alias("disciplines"))


def with_disciplines(jobs: DataFrame, disciplines: DataFrame) -> DataFrame:
    return jobs.join(disciplines, "url", "left").withColumn("disciplines", F.coalesce("disciplines", F.array().cast("array<string>")))


def facet_completeness(links: DataFrame, expected: DataFrame) -> DataFrame:
    """(facet, collected, expected, complete) for every facet of `expected` (facet, expected); a negative expectation is unknown."""
    got = links.groupBy("facet").agg(F.count_distinct("url").alias("collected"))
    both = expected.join(got, "facet", "left").withColumn("collected", F.coalesce("collected", F.lit(0)))
    return both.select("facet", "collected", "expected", ((F.col("expected") < 0) | (F.col("collected") >= F.col("expected"))).alias("complete"))


def new_links_by_page(links: DataFrame) -> DataFrame:
    """(context, page, new_links, total_links) for every page of `links` (context, page, url): links first seen there, and so far."""
    first = links.groupBy("context", "url").agg(F.min("page").alias("page"))
    new = first.groupBy("context", "page").agg(F.count("*").alias("new_links"))
    pages = links.select("context", "page").distinct().join(new, ["context", "page"], "left").withColumn("new_links", F.coalesce("new_links", F.lit(0)))
    return pages.withColumn("total_links", F.sum("new_links").over(Window.partitionBy("context").orderBy("page")))


def limited_links(links: DataFrame, limit: int) -> DataFrame:
    """(url, disciplines) kept by a fold over facets in order: each may take `limit` less the number kept, counted over its first distinct urls, those
    kept already included; facets after the limit is reached add nothing. `links`: (facet_no, facet, page_order, url).

    Every facet is cut to its first `limit` urls before they meet, so the fold holds facets times `limit` entries at most.
    """
    first = links.groupBy("facet_no", "facet", "url").agg(F.min("page_order").alias("at"))
    cut = first.withColumn("n", F.row_number().over(Window.partitionBy("facet_no").orderBy("at", "url"))).where(F.col("n") <= limit)
    lists = cut.groupBy("facet_no", "facet").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda x: x.url).alias("urls"))
    ordered = lists.agg(F.sort_array(F.collect_list(F.struct("facet_no", "facet", "urls"))).alias("facets"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<struct<url:string,facet:string>>").alias("taken"))

    def step(state, facet):
        own = F.slice(facet.urls, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size(state.kept)))
        return F.struct(F.array_union(state.kept, own).alias("kept"), F.concat(state.taken, F.transform(own, lambda u: F.struct(u.alias("url"), facet.facet.alias("facet")))).alias("taken"))

    taken = ordered.select(F.explode(F.aggregate("facets", start, step).taken).alias("t")).select("t.url", "t.facet")
    return discipline_map(taken)


def unfiltered_links(links: DataFrame) -> DataFrame:
    """The distinct urls of an unfiltered listing in order."""
    return links.select("url").distinct().orderBy("url")


def retrieved_links(faceted: DataFrame, unfiltered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((url, disciplines) of all links of both listings, the report that compares them). Links without a facet have no disciplines."""
    every = faceted.select("url").union(unfiltered.select("url")).distinct()
    return with_disciplines(every, discipline_map(faceted)), collection_report(faceted, unfiltered)


def first_links(links: DataFrame, limit: int) -> DataFrame:
    """The other mode of a limit: simply the first `limit` distinct urls in facet and page order."""
    first = links.groupBy("url").agg(F.min(F.struct("facet_no", "page_order")).alias("at"))
    return first.orderBy("at", "url").limit(limit).select("url")


def collection_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: counts of distinct urls on either side, what each lacks (sorted), and whether they are equal."""
    a, b = left.select("url").distinct().withColumn("in_a", F.lit(True)), right.select("url").distinct().withColumn("in_b", F.lit(True))
    both = a.join(b, "url", "full_outer")
    only_a, only_b = F.col("in_b").isNull(), F.col("in_a").isNull()
    return both.agg(
        F.count("in_a").alias("left_count"), F.count("in_b").alias("right_count"), F.count_if(only_a).alias("only_left_count"), F.count_if(only_b).alias("only_right_count"),
        F.sort_array(F.collect_list(F.when(only_a, F.col("url")))).alias("only_left"), F.sort_array(F.collect_list(F.when(only_b, F.col("url")))).alias("only_right"),
    ).withColumn("equal", (F.col("only_left_count") == 0) & (F.col("only_right_count") == 0))


def report_lines(report: DataFrame) -> DataFrame:
    """(seq, line): the report as text."""
    head = [F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in ("left_count", "right_count", "only_left_count", "only_right_count", "equal")]
    lines = F.concat(F.array(*head), F.transform("only_left", lambda u: F.concat(F.lit("only left: "), u)), F.transform("only_right", lambda u: F.concat(F.lit("only right: "), u)))
    return report.select(F.posexplode(lines).alias("seq", "line"))
