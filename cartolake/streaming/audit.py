"""Sampling requests as a stream: decided row by row, each audited exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartolake.operators.sampling import adjudicate
from cartolake.sources.versions import MANIFESTS, PublishConflict, _Files

# Row content never enters the audit.
CONTENT = "rows"
_QUERY_ID = "sql.streaming.queryId"


def audit_stream(requests: DataFrame, tables: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the audit of a request stream.  Stateless: a stream-static join and an append sink."""
    return (
        adjudicate(requests, tables)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def audit_batches(requests: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  **trigger) -> StreamingQuery:
    """Start the audit of a request stream by ``decide``, which is called anew for every batch.

    ``decide`` makes the requests of a batch into audit records, so it may read the latest
    catalog or samples each time (``adjudicate``, ``sample_requests``).  A batch is written to a
    folder of its own and then published by one manifest named after the stream and the batch.
    What failed before that is never seen; a batch that comes again after it, because Spark
    had not noted its end, is passed over: every request is audited once, by the tables of
    the time its batch was published.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty(_QUERY_ID)
        files = _Files(spark, f"{path}/{stream}")
        if files.has(number):
            return
        folder = f"b-{uuid.uuid4().hex}"
        decide(batch).drop(CONTENT).write.mode("errorifexists").parquet(f"{files.path}/{folder}")
        try:
            files.publish(number, {"folder": f"{stream}/{folder}", "batch": number})
        except PublishConflict:
            # A run that was taken for dead was faster: its records count.
            if not files.has(number):
                raise

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of all published batches, of all streams that audit to ``path``; None where there are none."""
    try:
        manifests = spark.read.schema("folder string").json(f"{path}/*/{MANIFESTS}/*.json")
    except AnalysisException:
        return None
    # One short name per batch: the driver needs them to read the folders.
    folders = sorted(r["folder"] for r in manifests.collect())
    return spark.read.parquet(*[f"{path}/{folder}" for folder in folders]) if folders else None
