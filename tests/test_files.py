"""Readers, sinks and drivers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import attempts, contracts, generation, pairs, prompts, records, turns
from lectern.sources import files, html, rtf


def test_lines_count_per_file(spark, tmp_path):
    lines = [f'{{"record_id":"{i}","text":"t"}}' if i % 5 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"record_id":"x","text":"y"}\r\n\r\n{"record_id":"z"}\n[1]\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.jsonl_lines(spark, str(tmp_path))
        got = {(r.file, r.line): r.raw for r in rows.collect()}
        assert rows.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k[1]: v for k, v in got.items() if k[0] == "a.jsonl"} == {i + 1: x for i, x in enumerate(lines) if x}
    assert {k[1] for k in got if k[0] == "b.jsonl"} == {1, 3, 4}
    bad = files.segment_errors(files.jsonl_lines(spark, str(tmp_path / "b.jsonl")), ["record_id", "text"]).collect()
    assert sorted((r.line, r.error) for r in bad) == [(3, "lacks text"), (4, "no JSON object")]
    typed = spark.createDataFrame([("f", 1, '{"record_id":5,"text":"t"}')], "file string, line int, raw string")
    assert files.segment_errors(typed, ["record_id", "text"]).first().error == "record_id is no string"


def test_segment_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.segment_files(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.segment_files(spark, str(tmp_path))
    for name in ("b.jsonl", "a.jsonl", "x.txt"):
        (tmp_path / name).write_text("{}")
    names = lambda: [x.rsplit("/", 1)[1] for x in files.segment_files(spark, str(tmp_path))]
    assert names() == ["a.jsonl", "b.jsonl"]
    (tmp_path / "c_segments.jsonl").write_text("{}")
    assert names() == ["c_segments.jsonl"] and files.segment_files(spark, str(tmp_path / "a.jsonl")) == [str(tmp_path / "a.jsonl")]
    with pytest.raises(ValueError):
        files.segment_files(spark, str(tmp_path / "x.txt"))


def test_json_files(spark, tmp_path):
    (tmp_path / "book.json").write_text('{"codes": [{"code_label": "a"}],\n "codebook_id": "b"}')
    (tmp_path / "list.json").write_text("[1]")
    assert files.load_codebook(spark, str(tmp_path / "book.json"))["codebook_id"] == "b"
    for name in ("list.json", "none.json"):
        with pytest.raises(ValueError, match=name):
            files.read_json_object(spark, str(tmp_path / name), "manifest")


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", "r"), ("é\n", "c2", "r2")], "prompt string, chosen string, rejected string")
    meta = files.write_snapshot(spark, df, str(tmp_path / "s"))
    assert meta["rows"] == 2 and files.read_snapshot(spark, meta["path"], meta).collect() == df.collect()
    with pytest.raises(ValueError):
        files.read_snapshot(spark, meta["path"], meta | {"rows": 3})
    with pytest.raises(ValueError):
        files.read_snapshot(spark, meta["path"], meta | {"sha256": "0"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "d string, x int")
    files.replace_partitions(df, str(tmp_path / "t"), "d")
    files.replace_partitions(df.where("d = 'a'").withColumn("x", F.lit(9)), str(tmp_path / "t"), "d")
    assert sorted((r.d, r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9), ("b", 2)]
    one = files.write_by_content({"a": 1}, str(tmp_path / "m"))
    assert files.write_by_content({"a": 1}, str(tmp_path / "m")) == one
    (tmp_path / "m" / one.rsplit("/", 1)[1]).write_text('{"a": 2}')
    with pytest.raises(ValueError):
        files.write_by_content({"a": 1}, str(tmp_path / "m"))
    files.write_all({"rows": df}, str(tmp_path / "all"), {"n": 2})
    assert json.loads((tmp_path / "all" / "manifest.json").read_text())["status"] == "complete"
    with pytest.raises(Exception):
        files.write_all({"rows": df, "bad": df.select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "two"), {})
    assert not (tmp_path / "two").exists() and json.loads((tmp_path / "two.failed.json").read_text())["status"] == "failed"
    files.write_csv_rows([], ["a", "b"], str(tmp_path / "e.csv"))
    assert (tmp_path / "e.csv").read_text().strip() == "a,b"
    assert files.run_folder(str(tmp_path), "run") != files.run_folder(str(tmp_path), "run")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,n\nx,\n")
    got = files.check_columns(files.read_csv(spark, str(tmp_path / "bom.csv"), "a string, n int"), ["a", "n"], "bom.csv")
    assert [(r.a, r.n) for r in got.collect()] == [("x", None)]
    with pytest.raises(ValueError):
        files.check_columns(got, ["a"], "bom.csv")
    assert files.trace_inventory(df, 5) == {"traces": 2, "missing": 3}
    with pytest.raises(ValueError):
        files.trace_inventory(df, 1)


def test_interview_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        html.read_interviews(spark, str(tmp_path))
    (tmp_path / "b.htm").write_text("<html><head><title>T</title></head><body><h2 class='who'>A</h2><p>one</p><h2>x</h2><h2 class='who'>B</h2><p>two</p></body></html>")
    (tmp_path / "a.html").write_text("<p>alone</p>")
    (tmp_path / "c.html5").write_text("<p>no</p>")
    assert sorted(r.interview_id for r in html.read_interviews(spark, str(tmp_path)).collect()) == ["a", "b"]
    many = {r.interview_id: r.html for r in html.read_interviews(spark, str(tmp_path), "h2.who").collect()}
    assert set(many) == {"a_001", "b_001", "b_002"} and many["a_001"] == "<p>alone</p>"
    assert all("<title>T</title>" in many[k] for k in ("b_001", "b_002")) and "one" in many["b_001"] and "two" not in many["b_001"]


def test_rtf_is_strict():
    assert rtf.rtf_text(rb"{\rtf1 caf\'e9}") == "café"
    with pytest.raises(UnicodeDecodeError):
        rtf.rtf_text(b"{\\rtf1 \x81}")


def test_repair_keeps_each_record_once(spark):
    import random

    def unsure():
        return lambda prompt, seed: '{"a": 1}' if random.random() < 0.4 else "no"

    rows = spark.range(200).select(F.col("id"), F.lit("p").alias("prompt"))
    out = generation.repair(rows, 2, unsure).collect()
    assert len(out) == len({r.id for r in out}) == 200
    refined = generation.self_refine(rows, 2, lambda: lambda p, s: f'{{"stop": {str(random.random() < 0.5).lower()}}}').collect()
    assert len(refined) == len({r.id for r in refined}) == 200


def test_debate(spark):
    def agent():
        def answer(prompt, seed):
            record = prompt.split("record ")[1].split()[0]
            if record == "3" and "Critic" in prompt or record == "2" and "Refused" not in prompt:
                return "no"
            labels = ["A", "B", "C"] if "Proposer" in prompt.split("\n")[0] else ["B", "A", "C"]
            assert "Critic" not in prompt.split("\n")[0] or "t1 (Proposer): A > B > C" in prompt
            return json.dumps({"record_id": record, "review_block": "k", "candidate_assessments": dict.fromkeys("ABC", "x"), "debate_response": "x", "uncertainty": "x", "ranking": labels, "rationale": "x"})

        return answer

    blocks = spark.createDataFrame([(str(i), "k", f"record {i} ", ["A", "B", "C"]) for i in range(5)], "record_id string, review_block string, prompt string, labels array<string>")
    good, failed = generation.debate(blocks, [{"id": "t1", "agent": "Proposer"}, {"id": "t2", "agent": "Critic", "contributes": False}], agent)
    rows = sorted((r.record_id, r.turn_index, "".join(r.ranking), r.contributes) for r in good.collect())
    assert rows == [x for i in "0124" for x in ((i, 1, "ABC", True), (i, 2, "BAC", False))]
    assert [(r.record_id, r.failed_turn_id, r.failure_reason) for r in failed.collect()] == [("3", "t2", "no JSON object")]


def test_contract_helpers(spark):
    rows = spark.createDataFrame([("a", []), ("b", ["x"])], "record_id string, errors array<string>")
    assert contracts.required(rows.where("record_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="b: x"):
        contracts.required(rows).collect()
    audit = spark.createDataFrame([("a", "retained"), ("a", "retained"), (" ", "retained"), ("c", "rejected")], "candidate_record_id string, decision string").withColumns({c: F.lit("x") for c in ("selected_text", "interviewer_question", "clear_word_count", "total_word_count", "target_turn_indexes")})
    assert sorted(",".join(r.errors) for r in contracts.retained_audit(audit).collect()) == ["id repeats", "id repeats", "no id"]
    with pytest.raises(ValueError):
        contracts.retained_audit(audit.drop("selected_text"))
    assert contracts.unsettled(spark.createDataFrame([("a", "keep"), ("b", "review")], "k string, decision string"), "k") == ["b"]
    assert contracts.count_mismatches(spark.createDataFrame([("test",), ("train",)], "split string"), "split", {"test": 1, "train": 2}) == {"train": (1, 2)}
    cats = spark.createDataFrame([("r", c) for c in "abcd"], "record string, category string")
    fine = pairs.negative_pairs(cats, ["record"], selector=contracts.checked_selector(pairs.draw))
    assert fine.count() == 4
    with pytest.raises(Exception, match="selector chose"):
        pairs.negative_pairs(cats, ["record"], selector=contracts.checked_selector(lambda *k, choices: choices + 0)).collect()
    with pytest.raises(ValueError):
        pairs.disjoint_holdout(spark.createDataFrame([("train", 1), ("test", 1)], "split string, k int"), "k")
    samples = spark.createDataFrame([(1, [("a", 1)])], "k int, samples array<struct<raw:string,sample_index:int>>")
    assert samples.select(records.focused("samples", ["sample_index"]).alias("s")).schema["s"].dataType.elementType.names == ["sample_index"]
    state = attempts.with_state(samples, samples.select("k", F.lit("saved").alias("result")), ["k"])
    assert state.first().result == "saved"


def test_prompt_vars(spark):
    rows = spark.createDataFrame([("r", "t", "s", "ctx", "é", ["q"], "id1")], "record_id string, text string, source string, analysis_context string, place string, topics array<string>, codebook_id string")
    v = prompts.prompt_vars(rows, {"place": False, "topics": True, "codebook_id": False}, "turn_window", 2, 3).first().vars
    assert v["input_text"] == "t" and v["context_turns_before"] == "2" and v["codebook_id"] == "id1" and v["place"] == "é" and json.loads(v["topics"]) == ["q"] and v["candidate_example_codes_json"] == "[]"
    assert v["segment_json"] == json.dumps({"record_id": "r", "text": "t", "place": "é", "topics": ["q"], "source": "s"}, ensure_ascii=False, indent=2)
    book = prompts.prompt_vars(rows, {}, codebook={"codes": [1], "codebook_id": "b"}).first().vars
    assert book["codebook_id"] == "b" and book["codebook_version"] == "" and json.loads(book["candidate_example_codes_json"]) == [1] and "context_turns_before" not in book


def test_turn_errors(spark):
    rows = spark.createDataFrame([(1, "participant", "x"), (None, "ghost", " ")], "turn_index int, role string, text string")
    assert sorted(len(r.errors) for r in turns.turn_errors(rows).collect()) == [0, 3]
