"""Exclusions, profiles, fingerprints, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A check that found rows."""


def require_none(violations: DataFrame, message: str, mode: str = "fail") -> DataFrame:
    """Runs a check. fail: raises with the first 10 rows; warn: returns them; quarantine: the same, for a dead-letter table."""
    if mode == "fail":
        some = violations.limit(10).collect()
        if some:
            raise Violation(f"{message}: {[r.asDict() for r in some]}")
    return violations


def exclude(records: DataFrame, exclusions: DataFrame, key: str = "record_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records kept, exclusions whose text is not the record's, exclusions without a record)."""
    listed = exclusions.select(key, F.col(text).alias("_text"))
    kept = records.join(listed, key, "left_anti")
    stale = records.join(listed, key).where(~F.col(text).eqNullSafe(F.col("_text"))).select(key, text, F.col("_text").alias("excluded_text"))
    return kept, stale, listed.join(records, key, "left_anti").select(key)


def exclusion_summary(records: DataFrame, exclusions: DataFrame, group: str, key: str = "record_id") -> DataFrame:
    """A4: excluded records by group, in the group's order."""
    return records.join(exclusions.select(key), key, "left_semi").groupBy(group).agg(F.count("*").alias("n_excluded"))


def first_records(records: DataFrame, order: list[str], limit: int) -> DataFrame:
    """SO1: the first `limit` surviving records in (file, line) order; 0 is none, below is an error."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return records.orderBy(*order).limit(limit)


def length_profile(rows: DataFrame, value: str, by: str) -> DataFrame:
    """A10: count, min, nearest-rank percentiles and max by group and over all (`__all__`)."""
    ranks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p}") for p in (50, 90, 95, 99)]
    sets = rows.groupingSets([[F.col(by)], []], F.col(by))
    out = sets.agg(F.grouping(by).alias("_all"), F.count(value).alias("n"), F.min(value).alias("min_value"), *ranks, F.max(value).alias("max_value"))
    return out.withColumn("grp", F.when(F.col("_all") == 1, "__all__").otherwise(F.col(by))).select("grp", "n", "min_value", "p50", "p90", "p95", "p99", "max_value")


def over_limit(rows: DataFrame, value: str, limit: int) -> DataFrame:
    """Rows above the limit; the gate requires none."""
    return rows.where(F.col(value) > limit)


def token_budget(prompt: Column, requested: int, window: int) -> Column:
    """M4: the new tokens that fit after the prompt; null if none do."""
    room = F.lit(window) - prompt
    return F.when(room > 0, F.least(F.lit(requested), room))


def fingerprint(rows: DataFrame, key: str, hashed: str) -> DataFrame:
    """One hash of all (key, hash) pairs, whatever their order.

    Pairs are hashed in 4096 buckets first, so no task gathers more than a bucket.
    """
    pair = F.concat(F.col(key).cast("string"), F.lit(":"), F.col(hashed))
    buckets = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(4096)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ","), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("b").cast("string"), 4, "0"), F.lit(":"), "h"))), ","), 256).alias("fingerprint"), F.sum("n").alias("n_records"))


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Counts by every key of the dimension, zeros kept."""
    return dimension.select(key).distinct().join(facts.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SE1, SE3: keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
