"""Structured Streaming form of keyed, resumable processing: the last status of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attempts import latest


def latest_status(events: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A streaming aggregate with the batch operator's result: the value of the last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order), F.count("*").alias("n_attempts"))


def upsert_state(batch: DataFrame, state: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """For foreachBatch: state and batch merged to the last row of each key; applying a batch twice changes nothing."""
    both = batch if state is None else state.unionByName(batch)
    return latest(both, keys, order).select(*batch.columns)


def run_to_table(events: DataFrame, name: str, keys: list[str], value: str, order: str, checkpoint: str):
    """Starts the query into an in-memory table; all available input is processed, then it stops."""
    return latest_status(events, keys, value, order).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
