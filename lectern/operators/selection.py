"""Target selection: which responses of an exchange are evidence, and why an exchange is rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .turns import exchanges, with_evidence


def audit(turns: DataFrame) -> DataFrame:
    """PF8: one row per exchange: decision, primary reason, all reasons in fixed order, texts, counts, turn lists."""
    rows = with_evidence(exchanges(turns))
    rows = rows.withColumn("weak", T.weak_reason("clear_tokens")).withColumn("claim", T.is_claim("clear_tokens")).withColumn("cutoff", T.is_cutoff("clear_text"))
    q = with_evidence(rows.select("interview_id", "question_turn_index", F.col("question").alias("text")).distinct()).select("interview_id", "question_turn_index", F.col("clear_tokens").alias("question_tokens"))
    good = F.col("weak").isNull()
    item = F.struct("turn_index", F.concat("speaker_label", F.lit(": "), "text").alias("line"), "clear_tokens", "total_tokens", "weak", "claim", "cutoff", "speaker_label")
    one = rows.groupBy("interview_id", "segment_id", "record_id", "question", "question_turn_index", "ordinal").agg(
        F.array_sort(F.collect_list(item)).alias("all"), F.sum(F.size("clear_tokens")).alias("candidate_clear"), F.sum(F.size("total_tokens")).alias("candidate_total"), F.count_if(good).alias("n_kept")
    )
    one = one.join(q, ["interview_id", "question_turn_index"]).withColumn("kept", F.filter("all", lambda r: r["weak"].isNull()))
    clear = F.flatten(F.transform("kept", lambda r: r["clear_tokens"]))
    one = one.withColumns({"clear": clear, "total_word_count": F.size(F.flatten(F.transform("kept", lambda r: r["total_tokens"])))}).withColumn("clear_word_count", F.size("clear"))
    some = F.col("n_kept") > 0
    weak = F.transform("all", lambda r: r["weak"])
    found = {
        "no_clear_evidence": ~some & F.array_contains(weak, "no_clear_evidence"),
        "acknowledgement_or_no_information": ~some & F.array_contains(weak, "acknowledgement_or_no_information"),
        "question_echo": some & T.is_echo("clear", "question_tokens"),
        "short_fragment": some & (F.col("clear_word_count") <= 5) & ~F.exists("kept", lambda r: r["claim"]),
        "clear_cutoff": some & F.coalesce(F.try_element_at("kept", F.lit(-1))["cutoff"], F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(found[r], r) for r in L.REJECTIONS]))
    one = one.withColumn("reason_codes", reasons).withColumn("primary_reason", F.get("reason_codes", F.lit(0)))
    return one.select(
        "interview_id", "record_id", "segment_id", F.when(F.col("primary_reason").isNull(), "retained").otherwise("rejected").alias("decision"), "primary_reason", "reason_codes",
        "question", "question_turn_index", F.array_join(F.transform("all", lambda r: r["line"]), "\n").alias("candidate_text"), F.array_join(F.transform("kept", lambda r: r["line"]), "\n").alias("selected_text"),
        F.transform("all", lambda r: r["turn_index"]).alias("candidate_turns"), F.transform("kept", lambda r: r["turn_index"]).alias("target_turns"),
        F.transform(F.filter("all", lambda r: r["weak"].isNotNull()), lambda r: F.struct(r["turn_index"].alias("turn_index"), r["speaker_label"].alias("speaker_label"), r["weak"].alias("reason"))).alias("pruned_turns"),
        "candidate_total", "candidate_clear", "total_word_count", "clear_word_count",
    )


def quality(rows: DataFrame) -> DataFrame:
    """A1: an interview's exchanges, retained and rejected, pruned turns and words."""
    kept = F.col("decision") == "retained"
    return rows.groupBy("interview_id").agg(
        F.count("*").alias("n_candidates"), F.count_if(kept).alias("n_retained"), F.count_if(~kept).alias("n_rejected"), F.sum(F.size("pruned_turns")).alias("n_pruned"),
        F.sum("candidate_total").alias("candidate_words"), F.sum(F.when(kept, F.col("clear_word_count")).otherwise(0)).alias("retained_words"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """A2, A3: how often each reason stands, as the primary one and at all."""
    return rows.select("primary_reason", F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_all"), F.count_if(F.col("primary_reason") == F.col("reason")).alias("n_primary"))
