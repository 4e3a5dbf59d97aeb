"""Turn operators: islands of question and answers, neighbours, windows, full contexts.

Everything is partitioned by interview, and nothing orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import replace_unclear

def _by():
    return Window.partitionBy("interview_id").orderBy("turn_index")


def flagged(turns: DataFrame) -> DataFrame:
    """PF1-PF3 as columns."""
    return turns.withColumns({"is_filler_only": T.is_filler("text"), "is_unclear_only": T.is_unclear("text"), "is_backchannel": T.is_backchannel("text")})


def with_evidence(turns: DataFrame) -> DataFrame:
    """TX5: total and clear tokens of each turn."""
    bare = T.without_stage_directions("text")
    clear, total = replace_unclear(bare, F.lit(False)), replace_unclear(bare, F.lit(True))
    return turns.withColumn("clear_text", clear).withColumns({"clear_tokens": T.tokens("clear_text"), "total_tokens": T.tokens(total)})


def exchanges(turns: DataFrame) -> DataFrame:
    """One row per eligible response with its exchange: question turn, ordinal, id.

    Fillers go first. A question is an interviewer turn that is neither unclear nor a
    backchannel; responses belong to the last question; questions without any are no exchange.
    """
    kept = flagged(turns).where(~F.col("is_filler_only"))
    asks = (F.col("role") == "interviewer") & ~F.col("is_unclear_only") & ~F.col("is_backchannel")
    q = F.last(F.when(asks, F.struct("turn_index", "text")), True).over(_by().rowsBetween(Window.unboundedPreceding, 0))
    answers = kept.withColumn("q", q).where((F.col("role") == "participant") & F.col("speaker_label").isin("Male", "Female") & F.col("target_eligible") & F.col("q").isNotNull())
    whole = Window.partitionBy("interview_id")
    ranked = answers.withColumns({"question_turn_index": F.col("q.turn_index"), "question": F.col("q.text")}).withColumn("ordinal", F.dense_rank().over(whole.orderBy("question_turn_index")))
    ranked = ranked.withColumn("n_exchanges", F.max("ordinal").over(whole))
    segment = F.concat(F.lit("SEG"), F.expr("lpad(ordinal, greatest(3, length(n_exchanges)), '0')"))
    return ranked.withColumn("segment_id", segment).withColumn("record_id", F.concat_ws("_", F.col("interview_id").cast("string"), "segment_id")).drop("q")


def neighbours(turns: DataFrame) -> DataFrame:
    """Participant turns with the turns before and after, of any role, as `role: text`."""
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    out = turns.withColumns({"previous_context": F.coalesce(F.lag(line).over(_by()), F.lit("")), "next_context": F.coalesce(F.lead(line).over(_by()), F.lit(""))})
    return out.where(F.col("role") == "participant")


def window_context(turns: DataFrame, before: int, after: int) -> DataFrame:
    """For each participant turn, the turns from `before` positions earlier to `after` later, and how many are left out on either side."""
    around = _by().rowsBetween(-before, after)
    line = F.concat(F.lit("Turn "), F.col("turn_index").cast("string"), F.lit(" | "), F.initcap("role"), F.lit(": "), "text")
    n = F.count("*").over(Window.partitionBy("interview_id"))
    pos = F.row_number().over(_by())
    out = turns.withColumns({"context": F.array_join(F.collect_list(line).over(around), "\n"), "omitted_before": F.greatest(pos - 1 - before, F.lit(0)), "omitted_after": F.greatest(n - pos - after, F.lit(0))})
    return out.where(F.col("role") == "participant")


def full_context(turns: DataFrame) -> DataFrame:
    """An interview's turns in order, one line each."""
    line = F.concat(F.lit("Turn "), F.col("turn_index").cast("string"), F.lit(" | "), F.initcap("role"), F.lit(": "), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line"))))
    return turns.groupBy("interview_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("full_context"), F.count("*").alias("n_turns"))


def analysis_context(turns: DataFrame, scope: str, before: int = 20, after: int = 20) -> DataFrame:
    """(interview_id, turn_index, context) of participant turns under a scope."""
    if scope == "immediate":
        out = neighbours(turns).withColumn("context", F.concat(F.lit("Previous context:\n"), "previous_context", F.lit("\n\nNext context:\n"), "next_context"))
    elif scope == "turn_window":
        out = window_context(turns, before, after)
    elif scope == "full_interview":
        out = turns.where("role = 'participant'").join(full_context(turns).withColumnRenamed("full_context", "context"), "interview_id")
    else:
        raise ValueError(f"unknown context scope: {scope}")
    return out.select("interview_id", "turn_index", "context")


def order_violations(turns: DataFrame, index: str = "turn_index", by: str = "ord") -> DataFrame:
    """Turns whose index does not exceed the one before, in the order given."""
    w = Window.partitionBy("interview_id").orderBy(by)
    return turns.withColumn("before", F.lag(index).over(w)).where(F.col(index) <= F.col("before"))


def turn_errors(turns: DataFrame) -> DataFrame:
    """Turns with the errors of their fields: an index, a known speaker, a text, a place in the source."""
    found = [F.when(F.col("turn_index").isNull() | (F.col("turn_index") < 0), "no index"), F.when(~F.coalesce(F.col("role").isin("interviewer", "participant"), F.lit(False)), "unknown speaker"), F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")]
    return turns.withColumn("errors", F.array_compact(F.array(*found)))
