import pytest
from pyspark.sql import functions as F

from lectern.functions import jsonx
from lectern.operators import records
from lectern.plans import config


def test_checkpoints_and_migration(spark):
    saved = spark.createDataFrame([("a", "p1", None, [1, 2]), ("b", "p0", "x", [1, 2]), ("c", "p1", None, [2])], "id string, prompt string, book string, attempts array<int>")
    want = spark.createDataFrame([("a", "p1", None), ("b", "p1", "x"), ("c", "p1", None)], "id string, prompt string, book string")
    assert {r.id: r.errors for r in records.checkpoint_errors(saved, want, "id", ["prompt", "book"]).collect()} == {"b": ["prompt"], "c": ["attempts"]}
    old = spark.createDataFrame([("a", "cost_pressure"), ("b", "x"), ("c", "y"), ("d", "q")], "id string, label string")
    now = spark.createDataFrame([("a", "cost pressure"), ("b", "x"), ("c", "z"), ("e", "n")], "id string, label string")
    assert {r.id: r.outcome for r in records.migrated(old, now, "id", "label").collect()} == {"a": "migrated", "b": "unchanged", "c": "differs", "d": "no record", "e": "no checkpoint"}
    ok, clash = records.normalized_labels(spark.createDataFrame([(1, "a_b"), (1, "a b"), (2, "c_d")], "k int, label string"), "label", ["k"])
    assert clash.count() == 2 and {r.label for r in ok.collect()} == {"a b", "c d"}


def test_target_errors(spark):
    turns = [(1, "interviewer", "Interviewer", "Why?"), (2, "participant", "Male", "So."), (3, "participant", "Male", "Yes.")]
    df = spark.createDataFrame([(turns, [2, 3], "Male: So.\nMale: Yes."), (turns, [3, 2], "x"), (turns, [1], "Interviewer: Why?")], "turns array<struct<turn_index:int,speaker:string,speaker_label:string,text:string>>, targets array<int>, text string")
    assert [r.e for r in df.select(records.target_errors("turns", "targets", "text").alias("e")).collect()] == [[], ["targets not increasing", "text differs"], ["target is no participant"]]


def test_samples(spark):
    df = spark.createDataFrame([('{"code_quality_examples":{"wrong_code":{"a":"x"}}}', "failed", [(1, [7]), (1, [8])])], "p string, status string, samples array<struct<sample_index:int,attempts:array<int>>>")
    r = df.select(records.block_payload("p", "wrong_code", ["a", "b"]).alias("b"), records.sample_at("samples", 1).alias("s"), records.saved_attempts("status", "samples").alias("t"), records.normal_path(F.lit(".\\x\\y")).alias("q")).first()
    assert (r.b.a, r.b.b, r.s.attempts, r.t, r.q) == ("x", "", [7], None, "x/y")


def test_canonicalisation():
    got, log = jsonx.quotes_restored({"possible_new_codes": [{"evidence_quote": "a goodday"}], "code_quality_examples": {"wrong_code": {"code_label": "cost_pressure"}}}, "it was a good day")
    assert got["possible_new_codes"][0]["evidence_quote"] == "a good day" and got["code_quality_examples"]["wrong_code"]["code_label"] == "cost pressure" and len(log) == 2
    got, log = jsonx.reflective_canonical({"reflective_questions": [{"hint": 1, "code": "costpressure", "question": "Is costpressure high?"}]}, [{"hint": 1, "code_label": "cost_pressure"}])
    assert got["reflective_questions"][0] == {"hint": 1, "code": "cost pressure", "question": "Is cost pressure high?"} and len(log) == 2


def test_configs():
    ok = {"agents": ["a", "b"], "turns": [["1", "a"], ["2", "b"], ["3", "a"], ["4", "b"]], "contributing": ["3", "4"], "tiebreak": "b"}
    assert config.from_mapping(config.DebateConfig, ok).tiebreak == "b"
    for bad in ({**ok, "tiebreak": "c"}, {**ok, "extra": 1}, {**ok, "turns": ok["turns"][:3]}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(config.DebateConfig, bad)
    with pytest.raises(config.ConfigError):
        config.SourceConfig("s", ("d",), "full_interview", 1, 2)
    with pytest.raises(config.ConfigError):
        config.HoldoutConfig(("a",), ("a",), {"a": 1})
    assert config.HoldoutConfig(("a",), ("b",), {"a": 1, "b": 2}).pairs() == {"a": 4, "b": 8}
