"""Structured Streaming forms: incremental intake, discipline windows and a stream of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_jobs(arrivals: DataFrame, key: str = "job_id", time: str = "arrived_at", late: str = "1 hour") -> DataFrame:
    """Each vacancy of the stream once within the time that late arrivals are waited for."""
    return arrivals.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def disciplines_in_windows(links: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "seen_at") -> DataFrame:
    """(window, url, disciplines) of a stream (seen_at, url, facet); a window comes out once it is closed, so its facets are complete."""
    return links.withWatermark(time, late).groupBy(F.window(time, window), "url").agg(F.sort_array(F.collect_set("facet")).alias("disciplines"))


def publish_stream(jobs: DataFrame, evaluate: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Evaluates every micro-batch of vacancies against the static candidates and publishes it; all that has arrived, then it stops."""
    return jobs.writeStream.foreachBatch(lambda batch, n: publish(evaluate(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
