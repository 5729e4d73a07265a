"""Readers and writers of profiles, vacancies, texts and rankings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "array<struct<name:string,strength:string,confidence:double,evidence:array<string>>>"
CANDIDATE_SCHEMA = (
    "candidate_id string, source_text_hash string, schema_version string, profile struct<"
    + ",".join(f"{b}:{_ITEM}" for b in ("skills", "protocols", "standards", "domains"))
    + ",languages:array<struct<name:string,level:string,confidence:double,evidence:array<string>>>,seniority:struct<value:string,confidence:double,evidence:array<string>>"
    ",years_experience_total:struct<value:int,confidence:double,evidence:array<string>>,candidate_constraints:struct<preferred_locations:array<string>,excluded_locations:array<string>"
    ",preferred_workplace_types:array<string>,excluded_workplace_types:array<string>,requires_visa_sponsorship:boolean,avoid_export_control_roles:boolean,notes:string,confidence:double,evidence:array<string>>>"
)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate profiles, one JSON document a file; a missing id is taken from the file's name."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = spark.read.schema(CANDIDATE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("candidate_id", F.coalesce(F.nullif(F.trim("candidate_id"), F.lit("")), stem))


def read_jobs(spark: SparkSession, path: str, schema: str, default_company: str) -> DataFrame:
    """Vacancy profiles with `company_slug` from the folder after `job_profiles`, or the default."""
    slug = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/job_profiles/([^/]+)/", 1), F.lit(""))
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path).withColumn("company_slug", F.coalesce(slug, F.lit(default_company)))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def clean_text(s: Column) -> Column:
    """Line ends become newlines, form feeds blank lines; ends are stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), "\f", "\n\n"), r"(?U)^\s+|\s+\z", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .md and .txt files."""
    rows = spark.read.option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), clean_text(F.col("value")).alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(data: bytes) -> str:
    root = ElementTree.parse(io.BytesIO(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))).getroot()
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    texts = ("".join(x.text or "" if x.tag == _W + "t" else marks.get(x.tag, "") for x in p.iter()).strip() for p in root.iter(_W + "p"))
    return "\n\n".join(t for t in texts if t)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): paragraphs that are not empty, joined by blank lines; a file that can't be read gives a row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.path, batch.content, strict=True):
                try:
                    rows.append((p, _docx_text(data), None))
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(parse, "path string, text string, error string")


def write_rankings(rankings: DataFrame, path: str) -> None:
    """Partitioned by company and status; a row without candidate or job id is an error."""
    checked = _filled_key(_filled_key(rankings, "candidate_id"), "job_id")
    checked.write.partitionBy("company_slug", "status").mode("overwrite").parquet(path)


def _filled_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) != "", F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is missing"))))


def write_candidates(profiles: DataFrame, path: str) -> None:
    """Candidate profiles as JSON; a blank candidate_id is an error. The folder is written anew: `publish.upserted` gives old and new profiles by id."""
    _filled_key(profiles, "candidate_id").write.mode("overwrite").json(path)


def write_decisions(jobs: DataFrame, rankings: DataFrame, path: str) -> None:
    """Vacancies beside their rankings (job_id, status), in partitions match and mismatch. The whole folder is written anew, so a vacancy whose
    decision changed leaves nothing behind in the other partition.
    """
    jobs.join(rankings.select("job_id", "status"), "job_id").write.partitionBy("status").mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A validation report as JSON, one folder for each company_slug; a blank slug is an error."""
    _filled_key(report, "company_slug").write.partitionBy("company_slug").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def write_layer(jobs: DataFrame, path: str) -> None:
    """Raw, evaluated or profile layers of vacancies; only the partitions at hand are overwritten."""
    jobs.write.partitionBy("company_slug", "layer").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def kept_jobs_envelope(jobs: DataFrame, source: str, fetched_at_unix: int) -> DataFrame:
    """One row: counts, and the kept vacancies (kept, job_id, title, url) in order of their ids."""
    return jobs.agg(
        F.lit(fetched_at_unix).cast("long").alias("fetched_at_unix"), F.lit(source).alias("source"), F.count("*").alias("total_jobs"), F.count_if("kept").alias("relevant_jobs"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("job_id", "title", "url")))).alias("jobs"),
    )


class Sources:
    """Named sources: each a function from landed pages to vacancies."""

    def __init__(self) -> None:
        self._by_slug: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, slug: str, source: Callable[[DataFrame], DataFrame]) -> None:
        self._by_slug[slug] = source

    def names(self) -> list[str]:
        return sorted(self._by_slug)

    def get(self, slug: str) -> Callable[[DataFrame], DataFrame]:
        if slug not in self._by_slug:
            raise ValueError(f"unknown source {slug!r}; known: {', '.join(self.names())}")
        return self._by_slug[slug]
