"""Ranking operators: Borda aggregation, tie groups, agreement metrics, wide views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def borda(rankings: DataFrame, keys: list[str], tiebreak: int) -> DataFrame:
    """Rankings (keys, agent, pos from 0, label) to (keys, label, score, tie_pos, final_rank).

    Place i of n gives n - i points. Equal scores are ordered by the place in the ranking of
    agent `tiebreak`, then by label.
    """
    size = F.count("*").over(Window.partitionBy(*keys, "agent"))
    scored = rankings.withColumn("points", size - F.col("pos"))
    one = scored.groupBy(*keys, "label").agg(F.sum("points").alias("score"), F.min(F.when(F.col("agent") == tiebreak, F.col("pos"))).alias("tie_pos"))
    return one.withColumn("final_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("tie_pos"), "label")))


def ties(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two labels or more of one score, with their final order."""
    return ranked.groupBy(*keys, "score").agg(F.count("*").alias("n_tied"), F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "label"))), lambda x: x["label"]).alias("applied_order")).where("n_tied >= 2")


def top(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """J5, SO8: the first label of each key."""
    return ranked.where("final_rank = 1").select(*keys, F.col("label").alias("top_label"))


def wide(ranked: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """One row per key: the final order and the score of each label."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "label"))), lambda x: x["label"])
    return ranked.groupBy(*keys).agg(order.alias("final_order"), *[F.max(F.when(F.col("label") == v, F.col("score"))).alias(f"score_{v}") for v in labels])


def distance(a, b) -> Column:
    """M2: sum of rank differences of array a's items in array b; a missing item adds 0."""
    at = F.transform(a, lambda x, i: F.when(F.array_position(b, x) > 0, F.abs(i + 1 - F.array_position(b, x))).otherwise(0))
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x)


def spearman(a, b) -> Column:
    """M1: 1 - 6 sum d^2 / (n (n^2 - 1)), no ties; null for fewer than two items."""
    n = F.size(a).cast("double")
    d = F.aggregate(F.transform(a, lambda x, i: F.pow(i + 1 - F.array_position(b, x), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 1, 1 - 6 * d / (n * (n * n - 1)))


def comparison_error(human, model) -> Column:
    """M3: the first reason why two rankings can't be compared, else empty."""
    return (
        F.when((F.size(human) == 0) | (F.size(model) == 0), "empty ranking")
        .when(F.size(F.array_distinct(human)) < F.size(human), "human ranking repeats a label")
        .when(F.size(F.array_distinct(model)) < F.size(model), "model ranking repeats a label")
        .when(F.array_sort(human) != F.array_sort(model), "rankings hold different labels")
        .otherwise("")
    )


def agreement(human: DataFrame, model: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Human and model rankings of the same key; of a key's model rows the last counts; invalid pairs stay, without metrics."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = model.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.col("ranking").alias("model_ranking"))
    both = human.select(*keys, F.col("ranking").alias("human_ranking")).join(last, keys).withColumn("error", comparison_error("human_ranking", "model_ranking"))
    ok = F.col("error") == ""
    return both.withColumns(
        {
            "top1_match": F.when(ok, F.get("human_ranking", F.lit(0)) == F.get("model_ranking", F.lit(0))),
            "full_match": F.when(ok, F.col("human_ranking") == F.col("model_ranking")),
            "rank_distance": F.when(ok, distance(F.col("human_ranking"), F.col("model_ranking"))),
            "spearman": F.when(ok, spearman(F.col("human_ranking"), F.col("model_ranking"))),
        }
    )


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and, over valid rows alone, means."""
    ok = F.col("error") == ""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"), F.avg(F.col("top1_match").cast("int")).alias("top1_rate"),
        F.avg(F.col("full_match").cast("int")).alias("full_rate"), F.avg("rank_distance").alias("mean_distance"), F.avg("spearman").alias("mean_spearman"),
    )


def permutation_errors(ranking, labels) -> Column:
    """V7: what keeps a ranking from being a complete permutation of the labels."""
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_except(labels, ranking)) > 0, "missing label"),
            F.when(F.size(F.array_except(ranking, labels)) > 0, "unknown label"),
            F.when(F.size(F.array_distinct(ranking)) < F.size(ranking), "repeated label"),
        )
    )


def candidate_blocks(segments: DataFrame, mappings: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Segments by block with their candidates in label order; 2 to 5 candidates, labels 1..n without a gap."""
    items = F.array_sort(F.collect_list(F.struct("label", "sample_index")))
    one = segments.crossJoin(F.broadcast(blocks)).join(mappings, [*keys, "block"]).groupBy(*keys, "block").agg(items.alias("candidates"))
    n = F.size("candidates")
    return one.withColumn("n_candidates", n).where(n.between(2, 5) & (F.transform("candidates", lambda c: c["label"]) == F.sequence(F.lit(1), n)))
