from rolefit.llm.near_dedup import near_duplicates


def test_a_chain_found_by_the_stars_alone_is_one_component(spark):
    # Neighbours share 81 of 99 shingles, others 72 of 108 at most; the last turn finds no new link for some of these chains.
    rows = [(100 * c + k, " ".join(f"w{c}x{i}" for i in range(9 * at, 9 * at + 94))) for c in range(30) for at, k in enumerate((1, 7, 3, 8, 2, 9, 4))]
    for c in range(0, 30, 10):
        own = [r for r in rows if c <= r[0] // 100 < c + 10]
        got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert got == {i: (i // 100 * 100 + 1, i % 100 == 1) for i, _ in own}


def test_the_last_turn_contracts_links_of_earlier_turns(spark, monkeypatch):
    # Every pair of a chain but its neighbours is dissimilar, and the bitmaps of the last join leave nothing to confirm.
    monkeypatch.setattr("rolefit.llm.near_dedup._possible", lambda percent: "false")
    rows = [(k, " ".join(f"w{i}" for i in range(9 * at, 9 * at + 94))) for at, k in enumerate((1, 7, 3, 8, 2, 9, 4))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {1}
