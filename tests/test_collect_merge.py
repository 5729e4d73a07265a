from rolefit.operators import collect, merge, publish


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_facets_and_limit(spark):
    links = spark.createDataFrame([(0, "f", k, u) for k, u in enumerate("ab")] + [(1, "g", k, u) for k, u in enumerate("abcd")], "facet_no int, facet string, page_order int, url string")
    assert rows(collect.limited_links(links, 3)) == [("a", ["f", "g"]), ("b", ["f"])]
    assert rows(collect.first_links(links, 3)) == [("a",), ("b",), ("c",)]
    assert rows(collect.discipline_map(links))[2] == ("c", ["g"])
    report = collect.collection_report(links.where("facet = 'f'"), links.where("url <> 'a'"))
    assert rows(report) == [(2, 3, 1, 2, ["a"], ["c", "d"], False)]
    assert [r.line for r in collect.report_lines(report).orderBy("seq").collect()][-2:] == ["only right: c", "only right: d"]


def test_merges(spark):
    items = spark.createDataFrame([(1, "Go ", 2, "preferred", 0.9, ["x"]), (1, "go", 1, "required", 0.5, ["y", "X"]), (1, " ", 3, "required", 0.5, [])], "k int, name string, pos int, requirement string, confidence double, evidence array<string>")
    assert rows(merge.merged_features(items, ["k"], "requirement")) == [(1, "go", "required", 0.9, 1, ["y", "X"])]
    langs = spark.createDataFrame([(1, "nl", 1, "A", 0.5), (1, "nl", 2, None, 0.9), (1, "nl", 3, "B", 0.7)], "k int, name string, pos int, level string, confidence double")
    assert rows(merge.merged_languages(langs, ["k"])) == [(1, "nl", "A", 0.9, 1)]


def test_upsert_reuse_diff(spark):
    old = spark.createDataFrame([(1, "match"), (2, "mismatch")], "id int, status string")
    assert rows(publish.upserted(old, spark.createDataFrame([(1, "mismatch")], old.schema), ["id"])) == [(1, "mismatch"), (2, "mismatch")]
    new = spark.createDataFrame([(2, "match", 1), (3, "match", None)], "id int, status string, extra int")
    assert rows(publish.snapshot_diff(old, new, "id")) == [(1, "removed"), (2, "shared"), (3, "added")]
    assert rows(publish.new_fields(old, new)) == [("extra", 1)]
    assert rows(publish.field_change_frequency(old, new, "id")) == [("status", 1, 1)]


def test_keywords(spark):
    df = spark.createDataFrame([("ASML careers",), ("Experience with ML systems.",)], "t string")
    assert [r[0] for r in df.select(publish.keyword_hits(df.t, ["ml"])).collect()] == [[], ["ml"]]
