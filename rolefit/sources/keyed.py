"""Keyed sinks: tables in hash buckets of their key, of which an upsert rewrites the touched ones alone; decisions, layers and a ledger of stream batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolefit.functions.text import job_id
from rolefit.operators import match

#: Columns that a sink adds: the number of buckets, the bucket, and whether the row is the mark of a removed key.
_OF, _IN, _GONE = "_buckets", "_bucket", "_gone"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below `spark.checkpoint.dir`, which all executors share; only a local session may lack that setting, and gets a folder of the machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The sink's rows as they lie there; None where there are none yet. A path that can't be read for any other reason is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sink, one for each key, without the sink's own columns."""
    rows = _stored(spark, path)
    if rows is None:
        raise ValueError(f"no keyed sink at {path}")
    return rows.where(~F.col(_GONE)).drop(_OF, _IN, _GONE)


def upsert_keyed(new: DataFrame, path: str, key: list[str], latest: Column | None = None, buckets: int = 256, gone: bool = False) -> None:
    """Puts the rows of `new` in place of those with the same key (nulls are equal), and leaves all others.

    A row lies in the bucket of its key's hash, so a hot value of any other column is spread over all buckets. Only buckets that `new` touches are read and written: first all tasks write
    to a staging folder, then the driver moves the whole partitions there (dynamic partition overwrite). Files of other buckets keep their names. An upsert that failed can be run again:
    the same rows give the same table. Of rows of `new` with one key the one with the greatest `latest` stays, ties by the greatest hash of the whole row. Columns that only one side has are null on the other.
    With `gone` the keys of `new` are removed; their marks stay until a row of that key comes. A sink made with another number of buckets is an error.
    """
    if buckets < 1:
        raise ValueError("a keyed sink has at least one bucket")
    spark = new.sparkSession
    order = [*([latest.desc_nulls_last()] if latest is not None else []), F.xxhash64(*new.columns).desc()]
    rows = new.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")
    rows = rows.withColumns({_OF: F.lit(buckets), _IN: F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"), _GONE: F.lit(gone)})
    old = _stored(spark, path)
    if old is not None:
        first = old.select(_OF).first()
        if first and first[0] != buckets:
            raise ValueError(f"the sink at {path} has {first[0]} buckets, not {buckets}")
        touched = [r[0] for r in rows.select(_IN).distinct().collect()]  # at most `buckets` numbers
        mine = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
        kept = old.where(F.col(_IN).isin(touched)).alias("o").join(rows.select(*key).alias("n"), mine, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    rows.repartition(F.col(_IN)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_OF, _IN).parquet(path)


def remove_keyed(keys: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """Removes the rows with the keys of `keys`; keys that the sink doesn't hold are no error."""
    rows = _stored(keys.sparkSession, path)
    if rows is not None:
        held = rows.where(~F.col(_GONE)).drop(_OF, _IN, _GONE)
        upsert_keyed(held.join(keys.select(*key).distinct(), key, "left_semi"), path, key, buckets=buckets, gone=True)


#: Keys of the sinks of this library.
RANKING_KEY, LAYER_KEY = ["company_slug", "candidate_id", "job_id"], ["company_slug", "layer", "job_file"]


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing"))))
    return df


def publish_rankings(rankings: DataFrame, path: str, buckets: int = 256) -> None:
    """Rankings (company_slug, candidate_id, job_id, status, ...), one for each key: a new decision takes the place of the old one, whatever its status was. Blank keys are errors."""
    upsert_keyed(_filled(rankings, *RANKING_KEY), path, RANKING_KEY, buckets=buckets)


def publish_layer(jobs: DataFrame, path: str, buckets: int = 256) -> None:
    """Vacancies (company_slug, layer, title, url, ...) of any layer; a vacancy's name in it, `job_file`, is the slug of its title with its url's hash, so one seen again takes the old one's place."""
    upsert_keyed(_filled(jobs, "company_slug", "layer").withColumn("job_file", job_id(F.col("title"), F.col("url"))), path, LAYER_KEY, buckets=buckets)


def rank_and_publish(
    candidates: DataFrame, cand_features: DataFrame, jobs: DataFrame, job_features: DataFrame, rankings_path: str, decisions_path: str | None = None, threshold: float = 0.6, buckets: int = 256
) -> None:
    """Evaluates all pairs, publishes their rankings, and removes from the sink of single decisions (layers match and mismatch) what it held for the ranked vacancies.

    `candidates` need candidate_id; `jobs` need job_id, company_slug, title and url. Each step can be run again after a failure: rankings go first, so no decision is lost between the two.
    """
    names, posts = candidates.select("cand_key", "candidate_id"), jobs.select("job_key", "job_id", "company_slug")
    scored = match.evaluate(candidates, cand_features, jobs, job_features, threshold)
    publish_rankings(scored.join(posts, "job_key").join(names, "cand_key"), rankings_path, buckets)
    if decisions_path is not None:
        layers = F.explode(F.array(F.lit("match"), F.lit("mismatch"))).alias("layer")
        remove_keyed(jobs.select("company_slug", layers, job_id(F.col("title"), F.col("url")).alias("job_file")), decisions_path, LAYER_KEY, buckets)


def _published(spark: SparkSession, ledger: str, name: str, batch: int) -> bool:
    rows = _stored(spark, ledger)
    return rows is not None and not rows.where((F.col("query") == name) & (F.col("batch") == batch)).isEmpty()


def publish_once(rows: DataFrame, publish: Callable[[DataFrame], None], ledger: str, name: str, batch: int) -> bool:
    """Publishes a batch unless the ledger says that it was, then notes it there; tells whether it published.

    After a failure between the two the batch is published again, so `publish` must be one that may be repeated, as the sinks of this module are. The ledger has one row for each batch, of
    its query, number and time.
    """
    spark = rows.sparkSession
    if _published(spark, ledger, name, batch):
        return False
    publish(rows)
    spark.range(1).select(F.lit(name).alias("query"), F.lit(batch).cast("long").alias("batch"), F.current_timestamp().alias("published_at")).write.mode("append").parquet(ledger)
    return True


def stream_rankings(
    jobs: DataFrame, candidates: DataFrame, cand_features: DataFrame, job_features: DataFrame, rankings_path: str, ledger: str, checkpoint: str, name: str = "rankings", threshold: float = 0.6, buckets: int = 256
) -> StreamingQuery:
    """Evaluates every micro-batch of vacancies against the candidates and publishes its rankings once; all that has arrived, then it stops."""

    def batch(own: DataFrame, number: int) -> None:
        publish_once(own, lambda x: rank_and_publish(candidates, cand_features, x, job_features, rankings_path, threshold=threshold, buckets=buckets), ledger, name, number)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
