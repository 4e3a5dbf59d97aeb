"""Contracts of samples, traces, rankings, questions and audits, as arrays of errors in columns.

Every check is a Column over parsed structs, so it runs inside the JVM and rows stay where they
are; `required` turns errors into a failing job for readers that must stop at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, casefold, is_collapsed, joined_sha256

# fixed values: the four categories in their order, and the fields of a code of each
CATEGORIES = ("wrong_code", "descriptive_not_answering_research_question", "too_broad_code", "useful_analytical_code")
CODE_FIELDS = {
    "wrong_code": ("code_label", "actual_segment_quote", "why_plausible_for_wider_dataset", "why_unsupported_by_this_segment", "relation_to_research_questions", "category_boundary"),
    "descriptive_not_answering_research_question": ("code_label", "evidence_quote", "surface_description", "why_true_of_segment", "why_not_useful_for_research_questions", "relation_to_research_questions", "category_boundary"),
    "too_broad_code": ("code_label", "evidence_quote", "broad_relevance_to_research_questions", "specific_meaning_lost", "why_it_is_too_broad", "relation_to_research_questions", "category_boundary"),
    "useful_analytical_code": ("code_label", "evidence_quote", "specific_analytical_insight", "why_it_is_useful", "relation_to_research_questions", "category_boundary"),
}
# fixed values: the fields of an audit row, in their order
AUDIT_FIELDS = (
    "schema_version", "line_number", "pair_id", "source_name", "source_trace_path", "dataset", "record_id", "transcript_id", "segment_id", "context_scope", "context_turns_before", "context_turns_after",
    "target_category", "target_code_label", "chosen_question", "rejected_source_category", "rejected_code_label", "rejected_question", "category_evidence_row_sha256", "question_only_row_sha256",
)
AUDIT_VERSION = "preference_pair_audit_v1"
SCOPES = ("immediate", "full_interview", "turn_window")

_QUESTION = "struct<code:string,hint:string,question:string>"
RANKING = "record_id string, review_block string, candidate_assessments map<string,string>, debate_response string, uncertainty string, ranking array<string>, rationale string"
TRACE = (
    "validation_errors array<string>, dataset string, record_id string, transcript_id string, segment_id string, target_segment string, full_interview_context string, research_questions array<string>, "
    f"selected_codes array<struct<hint:string,code:map<string,string>>>, reflective_questions array<{_QUESTION}>, parsed_output struct<reflective_questions:array<{_QUESTION}>>"
)


def blank(x) -> Column:
    """Missing, or without a character that is no white space."""
    return F.coalesce(F.trim(F.regexp_replace(_col(x), r"\s+", " ")) == "", F.lit(True))


def _errors(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _when(bad: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), message)


def required(rows: DataFrame, errors: str = "errors", name: str = "record_id") -> DataFrame:
    """SC14, V9, CF10: the rows without the errors; a row with any stops the job, with its name and errors."""
    stop = F.when(F.size(errors) > 0, F.raise_error(F.concat(F.coalesce(F.col(name).cast("string"), F.lit("?")), F.lit(": "), F.array_join(errors, "; "))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(stop).drop(errors)


def _normal(question) -> Column:
    return casefold(F.trim(F.regexp_replace(question, r"\s+", " ")))


def trace_errors(t: str) -> Column:
    """V9: what keeps a successful trace (struct TRACE) from being used: its errors, its strings, four codes with exactly their fields, four questions that agree with them."""
    c = F.col(t)
    strings = [_when(blank(c[f]), f"{f} is empty") for f in ("dataset", "record_id", "transcript_id", "segment_id", "target_segment", "full_interview_context")]
    asked, codes, qs = c["research_questions"], c["selected_codes"], c["reflective_questions"]
    per = []
    for i, hint in enumerate(CATEGORIES):
        code, q = F.get(codes, F.lit(i)), F.get(qs, F.lit(i))
        fields = F.array(*map(F.lit, sorted(CODE_FIELDS[hint])))
        per += [
            _when(code["hint"] != hint, f"selected_codes[{i}] is not {hint}"),
            _when(F.array_sort(F.map_keys(code["code"])) != fields, f"selected_codes[{i}] has other fields"),
            _when(F.exists(F.map_values(code["code"]), blank), f"selected_codes[{i}] has an empty field"),
            _when(q["hint"] != hint, f"reflective_questions[{i}] is not {hint}"),
            _when(q["code"] != code["code"]["code_label"], f"reflective_questions[{i}] has another code"),
            _when(blank(q["question"]), f"reflective_questions[{i}] is empty"),
        ]
    texts = F.transform(qs, lambda q: _normal(q["question"]))
    return _errors(
        _when(F.size(c["validation_errors"]) != 0, "validation errors"),
        *strings,
        _when((F.size(asked) == 0) | F.exists(asked, blank), "no research questions"),
        _when(F.size(codes) != len(CATEGORIES), "not four codes"),
        _when(F.size(qs) != len(CATEGORIES), "not four questions"),
        _when(~qs.eqNullSafe(c["parsed_output"]["reflective_questions"]), "questions differ from the parsed output"),
        *per,
        _when(F.size(F.array_distinct(texts)) != F.size(texts), "questions repeat"),
    )


def ranking_payload_errors(payload: str, record: str, block: str, labels: str) -> Column:
    """V7: a ranking (struct RANKING) against its record, block and labels: assessments of exactly the labels, a complete permutation, texts that say something, the same identities."""
    p, want = F.col(payload), F.col(labels)
    keys = F.coalesce(F.map_keys(p["candidate_assessments"]), F.array().cast("array<string>"))
    whole = _errors(
        _when(p["candidate_assessments"].isNull(), "no assessments"),
        _when(F.array_sort(keys) != F.array_sort(want), "assessments of other labels"),
        _when(F.exists(F.map_values(p["candidate_assessments"]), blank), "an assessment is empty"),
        *[_when(blank(p[f]), f"{f} is empty") for f in ("debate_response", "uncertainty", "rationale")],
        _when(p["ranking"].isNull(), "no ranking"),
        _when(F.array_sort(p["ranking"]) != F.array_sort(want), "ranking is no permutation"),
        _when(~p["record_id"].eqNullSafe(F.col(record).cast("string")), "another record"),
        _when(~p["review_block"].eqNullSafe(F.col(block).cast("string")), "another block"),
    )
    return F.when(p.isNull(), F.array(F.lit("no JSON object"))).otherwise(whole)


def question_list_errors(questions, selected) -> Column:
    """V8: questions (code, hint, question) against the selected codes (code_label, hint), in order: the same number, codes and hints, one final question mark, all distinct."""
    q, want = _col(questions), _col(selected)
    n = F.size(want)
    at = F.transform(F.arrays_zip(F.slice(q, F.lit(1), n).alias("q"), want.alias("w")), lambda z, i: F.struct(z["q"].alias("q"), z["w"].alias("w"), i.alias("i")))

    def one(z):
        text, place = z["q"]["question"], F.concat(F.lit("question "), (z["i"] + 1).cast("string"))
        own = F.when(blank(text), " is empty").when(is_collapsed(text), " lost its spaces").when((F.regexp_count(text, F.lit(r"\?")) != 1) | ~F.rtrim(text).endswith("?"), " lacks one final question mark")
        return F.when(z["q"].isNull(), F.array(F.concat(place, F.lit(" is missing")))).otherwise(
            _errors(*[F.when(F.coalesce(bad, F.lit(True)), F.concat(place, F.lit(m))) for bad, m in ((z["q"]["code"] != z["w"]["code_label"], " has another code"), (z["q"]["hint"] != z["w"]["hint"], " has another hint"))], F.concat(place, own))
        )

    texts = F.transform(F.filter(q, lambda x: ~blank(x["question"])), lambda x: _normal(x["question"]))
    rest = _errors(F.when(F.size(q) != n, "not as many questions as codes"), F.when(F.size(F.array_distinct(texts)) != F.size(texts), "questions repeat"))
    return F.when(q.isNull(), F.array(F.lit("no questions"))).otherwise(F.concat(F.flatten(F.transform(at, one)), rest))


def code_example_errors(examples: str, strict: bool = True) -> Column:
    """V3: examples (map of category to map of fields): the four categories, each with exactly its fields, all non-empty; labels distinct after white space and case are evened out."""
    e = F.col(examples)
    found = [_when(F.size(F.array_except(F.array(*map(F.lit, CATEGORIES)), F.map_keys(e))) > 0, "a category is missing")]
    if strict:
        found.append(_when(F.size(F.array_except(F.map_keys(e), F.array(*map(F.lit, CATEGORIES)))) > 0, "an unknown category"))
    for c in CATEGORIES:
        fields = F.array_sort(F.array(*map(F.lit, CODE_FIELDS[c])))
        found += [_when(F.array_sort(F.map_keys(e[c])) != fields, f"{c} has other fields"), _when(F.exists(F.map_values(e[c]), blank), f"{c} has an empty field")]
    labels = F.array_compact(F.array(*[F.when(~blank(e[c]["code_label"]), _normal(e[c]["code_label"])) for c in CATEGORIES]))
    return F.when(e.isNull(), F.array(F.lit("no examples"))).otherwise(_errors(*found, _when(F.size(F.array_distinct(labels)) != F.size(labels), "labels repeat")))


def analysis_unit_errors(unit: str, scope: str) -> Column:
    """V5: an analysis unit (struct of interview_id, segment_id, speaker, target_text, analysis_context_used, analysis_context_scope, context_warning) under the run's scope."""
    u = F.col(unit)
    strings = [_when(u[f].isNull(), f"{f} is no string") for f in ("interview_id", "segment_id", "speaker", "target_text", "analysis_context_scope", "context_warning")]
    return _errors(*strings, _when(~u["analysis_context_used"], "context was not used"), _when(u["analysis_context_scope"] != scope, "another context scope"))


def usefulness_errors(questions, allowed, useful, summary, why) -> Column:
    """V2: only questions of this run; useful exactly if there is one; the texts say something."""
    q, told = _col(questions), F.filter(F.transform(_col(allowed), lambda x: F.trim(x)), lambda x: x != "")
    return _errors(
        _when(q.isNull(), "no list of questions"), _when(F.size(F.array_except(q, told)) > 0, "unknown question"), _when(_col(useful).isNull(), "usefulness is no boolean"),
        _when(_col(useful) != (F.size(q) > 0), "usefulness disagrees"), _when(blank(summary), "no summary"), _when(blank(why), "no reason"),
    )


def audit_rows(pairs: DataFrame) -> DataFrame:
    """SP2: the audit of pairs, AUDIT_FIELDS in their order. pairs holds all but schema_version and pair_id."""
    rows = pairs.withColumns({"schema_version": F.lit(AUDIT_VERSION), "pair_id": joined_sha256("dataset", "record_id", "target_category")})
    return rows.select(*AUDIT_FIELDS)


def audit_errors(audit: DataFrame) -> DataFrame:
    """Audit rows with their errors: the fields, the scope and its limits, no rejection of the target, pair ids and lines once each."""
    from pyspark.sql import Window

    if set(audit.columns) != set(AUDIT_FIELDS):
        raise ValueError(f"audit has other fields: {sorted(set(audit.columns) ^ set(AUDIT_FIELDS))}")
    scope, before, after = F.col("context_scope"), F.col("context_turns_before"), F.col("context_turns_after")
    again = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    strings = [f for f in AUDIT_FIELDS if f not in ("schema_version", "line_number", "context_turns_before", "context_turns_after")]
    found = [
        _when(F.col("schema_version") != AUDIT_VERSION, "another schema"), *[_when(F.coalesce(F.col(f), F.lit("")) == "", f"{f} is empty") for f in strings], _when(F.col("line_number").isNull(), "no line"),
        F.when(scope == "full_interview", F.when(before.isNotNull() | after.isNotNull(), "limits of a full interview")).when(scope == "turn_window", _when((before < 0) | (after < 0) | before.isNull() | after.isNull(), "no limits of the window")).otherwise("another scope"),
        _when(F.col("target_category") == F.col("rejected_source_category"), "target is rejected"), F.when(again("pair_id"), "pair_id repeats"), F.when(again("line_number"), "line repeats"),
    ]
    return audit.withColumn("errors", _errors(*found))


def retained_audit(audit: DataFrame) -> DataFrame:
    """SC14: retained audit rows with their errors: no id, or one that repeats. Raises if a required field is missing."""
    from pyspark.sql import Window

    # fixed values: the fields that an audit must have
    fields = ["candidate_record_id", "decision", "selected_text", "interviewer_question", "clear_word_count", "total_word_count", "target_turn_indexes"]
    if missing := [f for f in fields if f not in audit.columns]:
        raise ValueError(f"audit lacks {missing}")
    again = F.count("*").over(Window.partitionBy("candidate_record_id")) > 1
    return audit.where("decision = 'retained'").withColumn("errors", _errors(_when(blank("candidate_record_id"), "no id"), F.when(again, "id repeats")))


def review_errors(review: DataFrame, audit: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Review rows with their errors: no retained audit row of the key, or one that differs in a column of `same`."""
    a = audit.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in same])
    differ = [F.when(F.col("_there").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c} differs")) for c in same]
    return review.join(a, key, "left").withColumn("errors", _errors(F.when(F.col("_there").isNull(), "no audit row"), *differ)).drop("_there", *[f"_{c}" for c in same])


def exclusion_problems(records: DataFrame, exclusions: DataFrame, key: str, text: str) -> DataFrame:
    """Exclusions that match no record, or one with another text: (key, problem)."""
    there = records.select(key, F.lit(True).alias("_there"), F.col(text).alias("_text"))
    problem = F.when(F.col("_there").isNull(), "no record").when(~F.col(text).eqNullSafe(F.col("_text")), "another text")
    return exclusions.join(there, key, "left").select(key, problem.alias("problem")).where("problem is not null")


def not_exactly_one(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that rows holds never or several times: (keys, n)."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return wanted.select(*keys).distinct().join(n, keys, "left").fillna(0, ["n"]).where("n <> 1")


def with_trace(segments: DataFrame, traces: DataFrame, run: str, path: str) -> DataFrame:
    """Segments with the trace of their run and path, slashes evened out; each trace is read once, by the join."""
    from .records import normal_path

    right = traces.withColumns({"_run": F.col(run), "_path": normal_path(path)}).drop(run, path)
    return segments.withColumn("_norm", normal_path(path)).join(right, (F.col(run) == F.col("_run")) & (F.col("_norm") == F.col("_path")), "left").drop("_run", "_path", "_norm")


def unsettled(decisions: DataFrame, key: str, decision: str = "decision", n: int = 10) -> list:
    """A3: the first n keys that are still to review; outputs are refused while there are any."""
    return [r[0] for r in decisions.where(F.col(decision) == "review").select(key).orderBy(key).limit(n).collect()]


def checked_selector(selector):
    """UD2: a selector (keys, choices) whose choice must lie within the choices."""

    def choose(*key, choices):
        index = selector(*key, choices=choices)
        return F.when((index >= 0) & (index < choices), index).otherwise(F.raise_error(F.concat(F.lit("selector chose "), index.cast("string"))).cast("int"))

    return choose


def count_mismatches(rows: DataFrame, split: str, expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """SP3, SP4: splits whose count is not the expected one: {split: (found, expected)}."""
    found = {r[0]: r[1] for r in rows.groupBy(split).agg(F.count("*").alias("n")).collect()}
    return {k: (found.get(k, 0), expected.get(k, 0)) for k in sorted({*found, *expected}) if found.get(k, 0) != expected.get(k, 0)}
