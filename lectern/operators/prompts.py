"""Prompt variables, contexts with their target marked, and digests of what was sent."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import _col

# fixed values: metadata that no prompt shows
EXCLUDED = ("candidate_example_codes", "codebook_id", "codebook_version", "interview_turns")


@F.pandas_udf(StringType())
def indented(x: pd.Series) -> pd.Series:
    """JSON with an indent of two, other characters as they are; null stays null."""
    return x.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, indent=2))


def prompt_vars(rows: DataFrame, metadata: dict[str, bool], scope: str = "immediate", before: int = 20, after: int = 20, codebook: dict | None = None, excluded=EXCLUDED) -> DataFrame:
    """PF16: rows with `vars`, a map of the template's variables.

    rows: record_id, text, source, analysis_context and the metadata columns; metadata: column -> whether it is
    nested (then shown as JSON). A codebook's codes, id and version override those of the row.
    """
    shown = [c for c in metadata if c not in excluded]
    payload = indented(F.to_json(F.struct("record_id", "text", *shown, "source"), {"ignoreNullFields": "false"}))
    value = lambda c: indented(F.to_json(F.col(c))) if metadata[c] else F.col(c).cast("string")
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    codes = F.lit(json.dumps(codebook.get("codes", []), ensure_ascii=False, indent=2)) if codebook is not None else indented(F.to_json("candidate_example_codes")) if "candidate_example_codes" in rows.columns else F.lit("[]")
    out = {"record_id": F.col("record_id").cast("string"), "input_text": F.col("text"), "context_scope": F.lit(scope), "analysis_context": F.col("analysis_context"), "segment_json": payload, "candidate_example_codes_json": codes, "record_json": payload}
    if scope == "turn_window":
        out |= {"context_turns_before": F.lit(str(before)), "context_turns_after": F.lit(str(after))}
    for c in ("codebook_id", "codebook_version"):
        out[c] = F.lit(str(codebook.get(c, ""))) if codebook is not None else given(c)
    out |= {c: value(c) for c in shown}
    return rows.withColumn("vars", F.create_map(*[x for k, v in out.items() for x in (F.lit(k), v)]))


def aligned_scope(prompt, scope: str) -> Column:
    """TX18: under a turn window, the example's literal scope is the window's."""
    return F.replace(_col(prompt), F.lit('"analysis_context_scope": "full_interview"'), F.lit('"analysis_context_scope": "turn_window"')) if scope == "turn_window" else _col(prompt)


def key_value(x) -> Column:
    """TX18: struct(key, value) of KEY=VALUE, parted at the first sign; null without one."""
    parts = F.split(_col(x), "=", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("key"), parts[1].alias("value")))


def question_list(questions) -> Column:
    """TX18: the JSON list of the questions that aren't blank, trimmed."""
    return F.to_json(F.filter(F.transform(_col(questions), lambda x: F.trim(x)), lambda x: x != ""))


def marked_context(turns: DataFrame, targets: DataFrame, mark: str = "segment") -> DataFrame:
    """Each target's whole interview, its turns marked. targets: (interview_id, segment_id, target_turn_indexes).

    mark "segment" names the segment and shows the speaker's label; "plain" only marks, with the role in lower case.
    """
    told = F.col("speaker_label") if mark == "segment" else F.lower("role")
    flag = F.concat(F.lit(" [TARGET SEGMENT "), F.col("segment_id"), F.lit("]")) if mark == "segment" else F.lit(" [TARGET SEGMENT]")
    marked = F.array_contains("target_turn_indexes", F.col("turn_index"))
    line = F.concat(F.lit("Turn "), F.col("turn_index").cast("string"), F.lit(" | "), told, F.when(marked, flag).otherwise(""), F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line")))), lambda x: x["line"])
    return turns.join(targets, "interview_id").groupBy("interview_id", "segment_id").agg(F.array_join(lines, "\n").alias("context"), F.count_if(marked).alias("n_marked"))


def rolling_digest(rows: DataFrame, order: str, line: str) -> str:
    """sha256 over all lines, each ended, in order. The order is the value's own, so one reader takes the sorted partitions one after the other; none is held whole."""
    digest = hashlib.sha256()
    for r in rows.select(order, F.col(line).alias("line")).orderBy(order).select("line").toLocalIterator():
        digest.update(r.line.encode() + b"\n")
    return digest.hexdigest()
