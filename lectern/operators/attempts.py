"""Generation events and resumable processing: latest attempts, scan counts, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str], first: str | None = None) -> DataFrame:
    """Each key's last event; of events that are equal in `order`, the one of least `first` (a number). max_by is a partial aggregate: no key is sorted or gathered."""
    rest = [c for c in events.columns if c not in keys]
    rank = [F.col(c) for c in order] + ([(-F.col(first)).alias("first")] if first else [])
    one = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("e"))
    return one.select(*keys, *[F.col("e")[c].alias(c) for c in rest])


def with_latest(failed: DataFrame, events: DataFrame, keys: list[str], order: list[str], first: str | None = None) -> DataFrame:
    """Failed samples with their last event, or none (`matched` false)."""
    return failed.join(latest(events, keys, order, first).withColumn("matched", F.lit(True)), keys, "left").fillna(False, ["matched"])


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand twice or more; nulls don't count."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scan_counts(events: DataFrame, kind: str, failed: str) -> DataFrame:
    """What a scan over events counts."""
    return events.agg(F.count("*").alias("n_events"), F.count_if(F.col(kind) == failed).alias("n_failed"), F.count_if(F.col(kind) != failed).alias("n_other"), F.count_distinct("user_id").alias("n_keys"))


def resume_plan(expected: DataFrame, checkpoints: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Each record's action: skip what succeeded, retry what failed, run what is missing, refuse what is unknown."""
    both = expected.select(key, F.lit(True).alias("_wanted")).join(checkpoints.select(key, F.col(status).alias("_status")), key, "full")
    action = F.when(F.col("_wanted").isNull(), "unknown").when(F.col("_status").isNull(), "missing").when(F.col("_status") == "success", "skip").otherwise("retry")
    return both.select(key, action.alias("action"))


def remaining(expected: DataFrame, checkpoints: DataFrame, key: str, status: str = "status") -> DataFrame:
    """SM1: records without a success."""
    return expected.join(checkpoints.where(F.col(status) == "success").select(key), key, "left_anti")


def run_state(expected: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """Counts by outcome and whether the run is complete."""
    n = resume_plan(expected, checkpoints, key).agg(F.count_if(F.col("action") == "skip").alias("n_success"), F.count_if(F.col("action") == "retry").alias("n_failed"), F.count_if(F.col("action") == "missing").alias("n_missing"))
    n = n.withColumn("n_retry", F.col("n_failed") + F.col("n_missing"))
    return n.withColumn("state", F.when((F.col("n_failed") + F.col("n_missing")) == 0, "complete").otherwise("incomplete"))


def repair_outcomes(failed: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Failed samples against the samples they claim to repair: ok, or why not. Columns fingerprint, repaired."""
    both = failed.join(targets.select(*key, F.col("fingerprint").alias("_now")), key, "left")
    return both.withColumn("outcome", F.when(F.col("_now").isNull(), "target_missing").when(F.col("_now") != F.col("fingerprint"), "fingerprint_mismatch").when(F.col("repaired").isNull(), "unrepairable").otherwise("repaired")).drop("_now")


def quarantined(checkpoints: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """SM2: (checkpoints that are JSON objects, dead letters with their error); the keys of the second are run again."""
    from ..functions.jsonx import parse_strict

    read = checkpoints.withColumn("_read", parse_strict(payload))
    bad = F.col("_read.payload").isNull()
    return read.where(~bad).drop("_read"), read.where(bad).withColumn("error", F.col("_read.error")).drop("_read")


#: The states that a run may pass to, by state.
STATES = {"created": ("running", "failed"), "running": ("validated", "complete", "incomplete", "failed"), "validated": ("running", "complete", "incomplete", "failed"), "incomplete": ("running",), "failed": ("running",), "complete": ("running",)}


def run_states(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """SM3: (key, status, resume_count, n_refused) of each run from its log: the last state, how often it went on after an end, the steps that STATES does not have."""
    from pyspark.sql import Window

    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    allowed = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    steps = log.withColumn("_before", before).withColumn("_at", F.struct(*order))
    again = (F.col(state) == "running") & F.col("_before").isin("incomplete", "failed", "complete")
    refused = F.col("_before").isNotNull() & ~F.coalesce(F.array_contains(allowed[F.col("_before")], F.col(state)), F.lit(False))
    return steps.groupBy(key).agg(F.max_by(state, "_at").alias("status"), F.count_if(again).alias("resume_count"), F.count_if(refused).alias("n_refused"))


def with_state(records: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """SM4: records with their saved result: the state table holds one row a key (dataset, record and block), the last written."""
    return records.join(state, keys, "left")


def resumed(expected: DataFrame, checkpoints: DataFrame, key: str, work, status: str = "status") -> DataFrame:
    """SM1: one row per expected record: what succeeded stays, the others go through `work` (DataFrame to DataFrame of the checkpoints' columns), once."""
    from .cuts import written

    fresh = written(work(remaining(expected, checkpoints, key, status)))
    kept = checkpoints.where(F.col(status) == "success").join(expected.select(key), key, "left_semi")
    return kept.unionByName(fresh)
