"""Preference pairs, splits, holdouts, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_sha256


def draw(*key, choices: int) -> Column:
    """A choice 0..choices-1 that depends on the key alone: the first 8 hex digits of its sha256, modulo."""
    return (F.conv(F.substr(joined_sha256(*key), F.lit(1), F.lit(8)), 16, 10).cast("long") % choices).cast("int")


def negative_pairs(categories: DataFrame, keys: list[str], category: str = "category", selector=draw) -> DataFrame:
    """J13, SP1: each (record, category) with one other category of its record.

    The others are taken in order; `selector(*key, choices=n)` picks, and both output versions use the same draw.
    A record needs no self join: the others are an array of the record.
    """
    whole = Window.partitionBy(*keys)
    every = F.array_sort(F.collect_set(category).over(whole))
    out = categories.withColumn("others", F.array_except(every, F.array(category)))
    n = F.size("others")
    index = selector(*keys, category, choices=n)
    return out.where(n > 0).withColumn("rejected", F.get("others", index)).withColumn("pair_id", joined_sha256(*keys, category)).drop("others")


def rejection_matrix(pairs: DataFrame, categories: DataFrame, category: str = "category") -> DataFrame:
    """Counts of (target, rejected), zeros kept, no diagonal. categories: the few category values."""
    cells = categories.select(F.col(category)).crossJoin(F.broadcast(categories.select(F.col(category).alias("rejected")))).where(F.col(category) != F.col("rejected"))
    return cells.join(pairs.groupBy(category, "rejected").agg(F.count("*").alias("n")), [category, "rejected"], "left").fillna(0, ["n"])


def bundle_violations(pairs: DataFrame, keys: list[str], expect: int = 4, category: str = "category", transcript: str | None = None) -> DataFrame:
    """Records without exactly `expect` rows of as many categories, or of several transcripts."""
    one = [F.count_distinct(transcript).alias("n_transcripts")] if transcript else []
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(category).alias("n_categories"), *one)
    bad = (F.col("n_rows") != expect) | (F.col("n_categories") != expect)
    return g.where(bad | (F.col("n_transcripts") != 1) if transcript else bad)


def conversation(prompt, chosen, rejected) -> Column:
    """SP2: a preference row, one message a side."""
    message = lambda role, x: F.array(F.struct(F.lit(role).alias("role"), (F.col(x) if isinstance(x, str) else x).alias("content")))
    return F.struct(message("user", prompt).alias("prompt"), message("assistant", chosen).alias("chosen"), message("assistant", rejected).alias("rejected"))


def with_system(prompt, message: str | None) -> Column:
    """PF15: the prompt with a system message in front, if there is one."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(message).alias("content"))), p) if message else p


def group_split(records: DataFrame, dataset: str, group: str, record: str, fraction: float, seed: int = 42) -> DataFrame:
    """SP3, SO5: (dataset, group, n_records, split): whole groups go to test so that its records come nearest to the fraction.

    Exact subset sums: groups in sha256 order, the first subset found for a sum stays, the
    empty and the full set don't count; equal distances are settled by a second hash. The
    state is one map of sums per dataset, so its size is the dataset's record count.
    """
    groups = records.groupBy(dataset, group).agg(F.count_distinct(record).alias("n_records"))
    h = joined_sha256(F.lit(seed), dataset, group)
    one = groups.groupBy(dataset).agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), F.col(group).cast("string").alias("g"), F.col("n_records").cast("int").alias("n")))).alias("gs"), F.sum("n_records").cast("int").alias("total"))
    start = F.create_map(F.lit(0), F.array().cast("array<string>"))

    def step(acc, x):
        new = F.map_filter(F.transform_keys(F.transform_values(acc, lambda k, v: F.concat(v, F.array(x["g"]))), lambda k, v: k + x["n"]), lambda k, v: ~F.map_contains_key(acc, k))
        return F.map_concat(acc, new)

    sums = F.map_entries(F.aggregate("gs", start, step))
    target = F.greatest(F.lit(1), F.round(F.col("total") * F.lit(fraction)).cast("int"))
    proper = F.filter(sums, lambda e: (e["key"] > 0) & (e["key"] < F.col("total")))
    rank = F.transform(proper, lambda e: F.struct(F.abs(e["key"] - target).alias("d"), joined_sha256(F.lit(seed), F.col(dataset), e["key"]).alias("h"), e["value"].alias("groups")))
    best = one.withColumn("test_groups", F.coalesce(F.get(F.array_sort(rank), F.lit(0))["groups"], F.array().cast("array<string>"))).select(dataset, "test_groups")
    return groups.join(best, dataset).withColumn("split", F.when(F.array_contains("test_groups", F.col(group).cast("string")), "test").otherwise("train")).drop("test_groups")


def holdout(rows: DataFrame, dataset: str, test_sets: list[str], line: str) -> DataFrame:
    """SP5, J14, W9: the dataset decides the split; lines are numbered within a split in source order, source lines stay.

    Rows are dealt by ranges of (split, line), and each range goes on from the counts of those before it: no task sorts a split.
    """
    from .cuts import written

    split = F.when(F.col(dataset).isin(*test_sets), "test").otherwise("train")
    dealt = written(rows.withColumn("split", split).repartitionByRange("split", line).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("split", "_part").agg(F.count("*").alias("n")).withColumn("_before", before).drop("n")
    place = F.row_number().over(Window.partitionBy("split", "_part").orderBy(line))
    return dealt.withColumn("_place", place).join(F.broadcast(counts), ["split", "_part"]).withColumn("line_number", (F.col("_before") + F.col("_place")).cast("int")).select(*rows.columns, "split", "line_number")


def disjoint_holdout(rows: DataFrame, key: str) -> None:
    """SP5: raises if a key stands in both splits."""
    both = overlap(rows.where("split = 'train'"), rows.where("split = 'test'"), key)
    if found := [r[0] for r in both.orderBy(key).limit(10).collect()]:
        raise ValueError(f"{key} in both splits: {found}")


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """SE2: keys on both sides; must be empty."""
    return train.select(key).intersect(test.select(key))


def count_differences(actual: DataFrame, expected: DataFrame, key: str, value: str = "n") -> DataFrame:
    """A15, SE6: keys whose counts differ, or that one side lacks."""
    both = actual.select(key, F.col(value).alias("actual")).join(expected.select(key, F.col(value).alias("expected")), key, "full")
    return both.where(~F.col("actual").eqNullSafe(F.col("expected")))
