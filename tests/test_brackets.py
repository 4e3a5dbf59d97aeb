"""Registered queries on conversations with [unclear ...] spans."""

from lectern.plans import registry


def test_unclear_spans_are_no_evidence(spark, tmp_path):
    turns = [
        (2, 0, "user", "What did you grow on the farm?"),
        (2, 1, "assistant", "We grew wheat [unclear: and [unclear] some barley] for many years before the war and sold it in town."),
        (2, 2, "user", "And who worked there with you?"),
        (2, 3, "assistant", "[unclear: my two brothers worked there every summer]"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    got = {r.segment_id: (r.decision, r.primary_reason, r.clear_word_count, r.candidate_clear) for r in run("exchange_audit")}
    assert got == {"SEG001": ("retained", None, 14, 14), "SEG002": ("rejected", "no_clear_evidence", 0, 0)}
    assert {r.turn_index: r.weak for r in run("turn_evidence")}[4] == "no_clear_evidence"
    assert [(r.n_retained, r.n_rejected, r.candidate_words) for r in run("exchange_qa")] == [(1, 1, 24)]


def test_review_reads_clear_words(spark, tmp_path):
    turns = [(2, 0, "user", "[unclear: when was it]?"), (2, 1, "assistant", "We grew wheat for many years before the war and sold it all in the market town.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = registry.QUERIES["review_reasons"](spark, str(tmp_path)).collect()
    assert [list(r.suggested_reasons) for r in rows] == [["unclear_or_damaged"]]
