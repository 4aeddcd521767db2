"""Small helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only on one machine (a local master) a temporary folder may stand in for it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (columns ``u``, ``v`` of one orderable type).

    Labels spread along edges and then jump to their label's label, so the
    number of rounds grows with the logarithm of a component's width.  Returns
    ``node, label``; no edges give no rows.
    """
    both = cut(edges.where("u is not null and v is not null").select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels, total = cut(labels), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = cut(spread.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        moved = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
