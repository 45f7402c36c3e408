"""Continuous ingestion of new files into a mapped store, exactly once in effect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators.mapping import map_documents
from tabulon.operators.sinks import Files, VersionedStore
from tabulon.plans.spec import MappingPlan


def ingest(stream: DataFrame, plan: MappingPlan, target: VersionedStore, checkpoint: str, doc: str | None = None, mode: str = "UPSERT", rejected: str | None = None, once: bool = True, name: str | None = None) -> StreamingQuery:
    """Map every micro-batch and write it as one version, marked by the query's id and the batch's number.

    A batch replayed after a crash finds its mark and is not written twice. The id is that of the checkpoint folder, so
    another stream into the same table, or the same one begun anew, has marks of its own.
    Rejected documents are appended below ``rejected``, in a folder a batch,
    which a replay overwrites. With ``once`` the query ends when it has taken in all there is.
    """
    target.ensure(plan, True, mode != "INSERT")
    label, folder = name or plan.table.name, Files(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(folder.read("metadata"))["id"]  # written before the first batch
        mapped = map_documents(batch, plan, doc).cache()
        try:
            done = target.write(mapped, mode, (f"stream:{label}:{query}", str(number)))
            if rejected:
                out = mapped.rejected.unionByName(done.rejected) if done.refused else mapped.rejected
                out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{rejected}/query={query}/batch={number}")
        finally:
            mapped.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
