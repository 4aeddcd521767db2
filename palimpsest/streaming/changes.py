"""The commits of a repository as a stream of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..history.repository import DELTA, Repository


def change_feed(spark: SparkSession, repository: Repository) -> DataFrame:
    """A streaming DataFrame ``op, s, p, o, g, commit``; each commit's files are new input."""
    return spark.readStream.schema(f"{DELTA}, commit string").parquet(f"{repository.root}/deltas")


def sink(feed: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Gives each batch of events to ``handler`` once a batch number; runs over what is there, then ends."""
    return feed.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predicate_counts(feed: DataFrame) -> DataFrame:
    """Live triples of each predicate, kept up by the signs of events."""
    return feed.groupBy(F.col("p")["lex"].alias("predicate")).agg(F.sum("op").cast("long").alias("triples"))


def touched_subjects(feed: DataFrame) -> DataFrame:
    """Changes of each subject: inserts and deletes."""
    return feed.groupBy(F.col("s")["lex"].alias("subject")).agg(F.count_if(F.col("op") == 1).alias("inserts"), F.count_if(F.col("op") == -1).alias("deletes"))


__all__ = ["change_feed", "predicate_counts", "sink", "touched_subjects"]
