"""Session settings and reliable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime (per-session) settings the plans in this package are written for.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when an aggregate above would have
    # reused its partitioning: one more shuffle beats one task with a third
    # of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcast by measured size only.  Static estimates do not see how far a
    # generator multiplies rows, so the choice is left to AQE, which knows the
    # shuffled bytes; hints remain for tables bounded by construction.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    # Hash instead of sort where every measured partition fits in memory.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a model's JSON answer: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a scratch folder, because there the driver and the executors
    are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="cartolake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives executor loss, and
    keeps column pruning and size statistics for the next plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
