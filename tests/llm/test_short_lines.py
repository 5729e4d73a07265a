import corpus_pipeline
from rolefit.llm import queries
from rolefit.llm.line_dedup import line_duplicates, without_repeated_lines


def test_short_copies_are_classes(spark, tmp_path):
    long = "a line of more than twenty characters"
    texts = [f"Yes.\n\n{long}\nNo.", f" Yes. \n{long}s\n\nnew", "Yes.", None, "No.\nNo."]
    frame = spark.createDataFrame([*enumerate(texts), (None, "Yes.")], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = {(0, 0): (0, 0, 0, True), (0, 1): (0, 1, 0, True), (0, 2): (0, 2, 1, True), (0, 3): (0, 3, 0, True), (1, 0): (0, 0, 0, False), (1, 1): (1, 1, 1, False), (1, 2): (1, 2, 0, True), (1, 3): (1, 3, 0, True)}
    want |= {(2, 0): (0, 0, 0, False), (3, 0): (3, 0, 0, True), (4, 0): (0, 3, 0, False), (4, 1): (0, 3, 0, False), (None, 0): (None, 0, 0, True)}
    for frame_out in (line_duplicates(frame, short_copies=True), queries.op8_line_dedup(spark, str(tmp_path))):
        assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no, x.n_links, x.kept) for x in frame_out.collect()} == want
    rest = {x.doc_id: x.text for x in without_repeated_lines(frame, short_copies=True).collect()}
    assert rest == {0: texts[0], 1: "\nnew", 3: None, None: "Yes."}
    assert {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, frame, "").collect()} == rest
