import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rolefit.sources import files
from rolefit.streaming import intake


def test_read_candidates(spark, tmp_path):
    (tmp_path / "ann.json").write_text(json.dumps({"source_text_hash": "h", "schema_version": "1", "profile": {"skills": [{"name": "go", "strength": "core", "confidence": 1.0, "evidence": ["e"]}]}}))
    row = files.read_candidates(spark, f"file://{tmp_path}").first()
    assert row.candidate_id == "ann" and row.profile.skills[0].name == "go" and row.profile.languages is None


def test_docx_and_text(spark, tmp_path):
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r.path[-6:]: (r.text, r.error) for r in files.read_docx(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"] == ("One\ttwo\n\nThree", None) and got["b.docx"][0] is None and "BadZipFile" in got["b.docx"][1]
    (tmp_path / "c.md").write_bytes(b"\r\n a\r\nb\x0cc \n")
    assert files.read_texts(spark, f"file://{tmp_path}").first().text == "a\nb\n\nc"


def test_rankings_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("c", "j", "x", "match"), ("c", "k", "x", "mismatch")], "candidate_id string, job_id string, company_slug string, status string")
    files.write_rankings(rows, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").where("status = 'match'").count() == 1
    with pytest.raises(Exception, match="job_id is missing"):
        files.write_rankings(rows.withColumn("job_id", F.lit(" ")), f"{tmp_path}/r2")
    sources = files.Sources()
    sources.add("b", lambda df: df)
    with pytest.raises(ValueError, match="unknown source"):
        sources.get("a")


def test_stream_publishes_each_job_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "job_id string, arrived_at timestamp"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "job_id string, t string").select("job_id", F.to_timestamp("t").alias("arrived_at")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen = []
    jobs = intake.new_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    intake.publish_stream(jobs, lambda batch: batch, lambda batch, n: seen.extend(r.job_id for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]
