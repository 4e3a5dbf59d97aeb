"""Operators over nested samples, aligned files, frozen snapshots and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_sha256


def invalid_samples(rows: DataFrame, samples: str = "samples", status: str = "final_parse_status") -> DataFrame:
    """PF12: each invalid sample with its place in the list."""
    out = rows.select("*", F.posexplode(samples).alias("sample_list_index", "sample"))
    return out.where(F.col("sample")[status] == "invalid").drop(samples)


def failed_segments(rows: DataFrame, samples: str = "samples", status: str = "final_parse_status") -> DataFrame:
    """PF13: segments with samples, none of them valid, and the indexes of the invalid ones."""
    s = F.col(samples)
    out = rows.where((F.size(s) > 0) & ~F.exists(s, lambda x: x[status] == "valid"))
    return out.withColumn("invalid_indexes", F.transform(F.filter(s, lambda x: x[status] == "invalid"), lambda x: x["sample_index"]))


def saved_attempts(status, samples) -> Column:
    """PF17: earlier attempts count only of a failed checkpoint with exactly one sample."""
    return F.when((F.col(status) == "failed") & (F.size(samples) == 1), F.col(samples)[0]["attempts"])


def sample_at(samples, index) -> Column:
    """The first sample of that index."""
    return F.get(F.filter(samples, lambda s: s["sample_index"] == index), F.lit(0))


def block_payload(payload, block: str, fields: list[str]) -> Column:
    """PF10: a review block's fields of a JSON sample, missing ones empty."""
    return F.struct(*[F.coalesce(F.get_json_object(payload, f"$.code_quality_examples.{block}.{f}"), F.lit("")).alias(f) for f in fields])


def normal_path(path) -> Column:
    """A relative path with forward slashes, for joining."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def aligned(first: DataFrame, second: DataFrame, line: str = "line") -> DataFrame:
    """Lines that one of two positional files lacks; none if the files align."""
    a, b = first.select(F.col(line).alias("line_a")), second.select(F.col(line).alias("line_b"))
    return a.join(b, a["line_a"] == b["line_b"], "full").where(F.col("line_a").isNull() | F.col("line_b").isNull()).select(F.coalesce("line_a", "line_b").alias(line), F.when(F.col("line_a").isNull(), "first").otherwise("second").alias("missing_in"))


def audit_violations(audit: DataFrame) -> DataFrame:
    """Audit rows that target their own rejection or repeat a pair id or a line."""
    again = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    out = audit.withColumn("errors", F.array_compact(F.array(F.when(F.col("target_category") == F.col("rejected_source_category"), "target is rejected"), F.when(again("pair_id"), "pair_id repeats"), F.when(again("line_number"), "line repeats"))))
    return out.where(F.size("errors") > 0)


def target_errors(turns: str, targets: str, text: str) -> Column:
    """Target turns must be increasing, all participants, and compose to the segment's text."""
    chosen = F.filter(turns, lambda t: F.array_contains(targets, t["turn_index"]))
    return F.array_compact(
        F.array(
            F.when(F.array_sort(F.array_distinct(targets)) != F.col(targets), "targets not increasing"),
            F.when(F.exists(chosen, lambda t: t["speaker"] != "participant"), "target is no participant"),
            F.when(F.array_join(F.transform(chosen, lambda t: F.concat(t["speaker_label"], F.lit(": "), t["text"])), "\n") != F.col(text), "text differs"),
        )
    )


def checkpoint_errors(saved: DataFrame, expected: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Checkpoints whose identity differs from the run's, or whose attempts are not 1..n. Null equals null."""
    e = expected.select(key, *[F.col(c).alias(f"_{c}") for c in identity])
    bad = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in identity]
    order = F.when(F.col("attempts") != F.sequence(F.lit(1), F.size("attempts")), F.lit("attempts"))
    return saved.join(e, key).withColumn("errors", F.array_compact(F.array(*bad, order))).where(F.size("errors") > 0).drop(*[f"_{c}" for c in identity])


def frozen(records: DataFrame, ids: DataFrame | None, statuses: list[str], key: str = "record_id", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(records taken, records skipped): by the frozen ids of a snapshot if there is one, else by status."""
    if ids is None:
        return records.where(F.col(status).isin(*statuses)), records.where(~F.coalesce(F.col(status).isin(*statuses), F.lit(False)))
    return records.join(ids.select(key), key, "left_semi"), records.join(ids.select(key), key, "left_anti")


def split_by_lines(examples: DataFrame, test_lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(train, test) by the manifest's test lines."""
    return examples.join(test_lines.select(line), line, "left_anti"), examples.join(test_lines.select(line), line, "left_semi")


def migrated(old: DataFrame, current: DataFrame, key: str, label: str) -> DataFrame:
    """Old checkpoints whose labels equal the current ones after normalisation; others say why not."""
    from ..functions.text import code_label

    both = old.join(current.select(key, F.col(label).alias("_now")), key, "full")
    same = code_label(label).eqNullSafe(code_label("_now"))
    return both.withColumn("outcome", F.when(F.col(label).isNull(), "no checkpoint").when(F.col("_now").isNull(), "no record").when(F.col(label) == F.col("_now"), "unchanged").when(same, "migrated").otherwise("differs")).drop("_now")


def first_mismatch(a, b) -> Column:
    """M6: first place from 0 at which two sequences differ; null if they are equal. The sequences are walked once, side by side."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True) - 1
    apart = F.size(a) != F.size(b)
    return F.when(at >= 0, F.when(apart, F.least(at, n.cast("long"))).otherwise(at)).when(apart, n.cast("long"))


def latest_checkpoint(paths: DataFrame, path: str = "path", pattern: str = r"checkpoint-(\d+)$") -> DataFrame:
    """SO6: the path of the highest step."""
    step = F.regexp_extract(path, pattern, 1)
    return paths.where(step != "").agg(F.max_by(path, step.cast("long")).alias(path))


def preview(ids: DataFrame, key: str, n: int = 10) -> DataFrame:
    """SO7: the first n ids, and how many more there are."""
    total = ids.agg(F.count("*").alias("total"))
    head = ids.select(key).orderBy(key).limit(n).agg(F.array_sort(F.collect_list(key)).alias("first"))
    return head.crossJoin(F.broadcast(total)).select("first", F.greatest(F.col("total") - F.size("first"), F.lit(0)).alias("more"))


def failure_items(rows: DataFrame) -> DataFrame:
    """Invalid samples with a repair target and the sample's fingerprint."""
    out = invalid_samples(rows)
    return out.select("record_id", "sample_list_index", F.col("sample.sample_index").alias("sample_index"), canonical_sha256(record_id="record_id", sample_index=F.col("sample.sample_index"), raw=F.col("sample.raw_text")).alias("fingerprint"))


def normalized_labels(rows: DataFrame, label: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with normalised labels, rows that this would make equal to another of their key): apply only if the second is empty."""
    from ..functions.text import casefold, code_label

    out = rows.withColumn("_new", code_label(label))
    w = Window.partitionBy(*keys, casefold("_new"))
    clash = out.withColumn("_n", F.size(F.collect_set(F.col(label)).over(w)))
    return out.withColumn(label, F.col("_new")).drop("_new"), clash.where("_n > 1").drop("_new", "_n")


def prompt_sections(question_list, context_heading: Column, context, target, label) -> Column:
    """TX17: the numbered questions, context, target and label sections of a prompt."""
    numbered = F.array_join(F.transform(question_list, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    part = lambda head, x: F.concat(head if isinstance(head, Column) else F.lit(head), F.lit(":\n"), x)
    return F.concat_ws("\n\n", part("Research questions", numbered), part(context_heading, F.col(context)), part("Target segment", F.col(target)), part("Code label", F.col(label)))


def field_lines(fields: list[str]) -> Column:
    """TX17: `Field: value` lines."""
    from ..functions.text import readable

    return F.concat_ws("\n", *[F.concat(readable(F.lit(f)), F.lit(": "), F.col(f)) for f in fields])


def artefact_id(record, step, sample, attempt, text) -> Column:
    """SK11: the ids and the first 12 hex digits of the text's sha256."""
    return F.concat_ws("_", record, step, F.col(sample).cast("string"), F.col(attempt).cast("string"), F.substr(F.sha2(text, 256), F.lit(1), F.lit(12)))


def focused(samples, fields: list[str]) -> Column:
    """PF11: the samples with these fields alone, in their order."""
    return F.transform(samples, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
