"""The stages of the training-corpus pipeline: quality filter, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of `documents` and perhaps others, and works on all that the stage before it kept.
Extra columns, whatever their names, go through all stages but the last. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm._work import staged
from rolefit.llm.decontaminate import contamination
from rolefit.llm.line_dedup import without_repeated_lines
from rolefit.llm.near_dedup import near_duplicates
from rolefit.llm.packing import pack
from rolefit.llm.quality import keep_good

#: Keys up to which a list of documents to leave out is broadcast; beyond, a merge join.
BROADCAST_KEYS = 100_000


def _joined(docs: DataFrame, key, listed: DataFrame, how: str) -> DataFrame:
    """`docs` joined with the distinct keys in the one column of `listed`; no column of `docs` changes."""
    keys = staged(listed.toDF("_listed").where("_listed is not null").distinct(), "keys")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), key == keys["_listed"], how)


def _row_key(docs: DataFrame):
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by `labels`, scores 0.7 or more.

    A null or empty text has the score of a text without features. Null ids and repeated rows are judged like others, each row by its own
    text; very long texts are read whole. Without labels of both kinds all scores are alike, and all documents stay or go.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occurred before, or, of 20 characters or more, that differ from an earlier line by two edits or fewer; empty lines stay.

    A document that loses all its lines goes. Null texts and the rows of null ids stay as they are. Rows that share an id count as one document,
    whose first line of a kind stays in each of its rows; equal rows stay equal.
    """
    return without_repeated_lines(docs, short_copies=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by a similarity of 0.8 or more on five-word shingles.

    Of rows with equal id and text one stays. Rows that share an id but not the text are one document, which stays or goes whole. Null and empty
    texts and null ids are linked with nothing and stay.
    """
    twice = docs.where(docs["doc_id"].isNotNull()).groupBy(docs["doc_id"].cast("long").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    twice = staged(twice, "repeated")
    if not twice.isEmpty():
        key = docs["doc_id"].cast("long")
        again = _joined(docs, key, twice, "left_semi").dropDuplicates(["doc_id", "text"])
        docs = staged(_joined(docs, key, twice, "left_anti").union(again), "single")
    return _joined(docs, docs["doc_id"].cast("long"), near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage that holds the question and answer of an item of `benchmark`.

    Rows are told apart by a hash of id and text, so that rows of one id, or of none, are judged each by its own text; repeated rows stay or
    go together. Null and empty texts stay; items that are null or without words match nothing.
    """
    found = contamination(docs.select(_row_key(docs).alias("key"), docs["text"].alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _joined(docs, _row_key(docs), found.select("doc_id"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 4096 tokens.

    Null and empty texts are the end id alone; longer documents than a sequence are cut. Null ids and repeated rows are packed like others.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The classifier and the tokenizer are beyond SQL; the tests compare what they stand on with brute force, and two stages on fixed rows; `run` as a whole has no such test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
