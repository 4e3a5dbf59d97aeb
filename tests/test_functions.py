import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import jsonx, spans
from lectern.functions import text as T
from lectern.operators import attempts, generation, lineage, pairs, ranking, selection
from lectern.sources import files, html, rtf
from lectern.streaming.state import run_to_table, upsert_state


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_predicates(spark):
    for text, want in (("Mmm, yeah.", True), ("No.", False), ("", True), ("uhh hmm", True)):
        assert one(spark, T.is_filler("t"), t=text) == want
    assert one(spark, T.is_unclear("t"), t="[unclear]") and not one(spark, T.is_unclear("t"), t="Maybe [unclear]")
    assert one(spark, T.is_backchannel("t"), t="Right, yeah.") and not one(spark, T.is_backchannel("t"), t="You moved after the birth.")
    got = one(spark, T.normalized_turn("t"), t="Why? ?? uncertain words ?? B?? High ???")
    assert (got.text, got.paired, got.isolated) == ("Why? [unclear: uncertain words] B[unclear] High [unclear]", 1, 2)
    assert one(spark, T.slug("t"), t="!!") == "unnamed_code" and one(spark, T.separator_insensitive("t"), t="Groß _x") == "grossx"


def test_spans():
    nested = "Before [unclear: nested [unclear] damaged words] after."
    assert spans.unclear_removed(nested, False).split() == ["Before", "after."]
    assert spans.unclear_removed(nested, True).split() == ["Before", "nested", "damaged", "words", "after."]
    assert spans.unclear_removed("x [unclear: open", True) == "x  "
    assert spans.whitespace_match("agood day", "it was a good day indeed") == "a good day"
    assert spans.whitespace_match("aa", "a a a a") is None
    assert spans.mojibake_repaired("cafÃ©") == "café" and spans.mojibake_repaired("itâ€™s 日") == "it’s 日"
    assert spans.label_repaired("Why is costpressure high?", "cost pressure", "costpressure") == "Why is cost pressure high?"


@pytest.mark.parametrize("question,answer,reason", [
    ("These are state schools?", "State schools.", "question_echo"), ("How old?", "10 months.", "short_fragment"), ("Was it?", "Yes.", "acknowledgement_or_no_information"),
    ("And then?", "I had a job and.", "clear_cutoff"), ("And then?", "We moved to the coast in the spring because work was there.", None),
])
def test_selection(spark, question, answer, reason):
    rows = [(1, 1, "interviewer", "Interviewer", question, False), (1, 2, "participant", "Male", answer, True)]
    got = selection.audit(spark.createDataFrame(rows, "interview_id long, turn_index int, role string, speaker_label string, text string, target_eligible boolean")).first()
    assert got.primary_reason == reason and got.decision == ("rejected" if reason else "retained")


def test_json():
    assert jsonx.tolerant('<think>x</think>{"a":1}}')[0] == '{"a":1}' and jsonx.strict('{"a":1}}')[0] is None
    assert jsonx.strict('```json\n{"a": 1}\n```') == ('{"a":1}', None, "fence")
    assert jsonx.tolerant('x ```json\n{"a":1}\n``` y', True)[2] == "surrounded_fence" and jsonx.tolerant("[1]")[0] is None
    assert jsonx.strict_response("<think>a</think><think>b</think>{}")[1] and jsonx.strict_response('<think>a</think> {"b":2}')[0] == '{"b":2}'
    fixed, log = jsonx.corrections({"id": 2, "q": {}}, {"id": 1, "q.v": "x"})
    assert fixed == {"id": 1, "q": {"v": "x"}} and [x["path"] for x in log] == ["id", "q.v"]
    spec = {"a": "text", "n": "confidence", "c": {"x", "y"}, "l": ["string"], "o": {"b": "bool"}}
    assert jsonx.contract_errors({"a": "t", "n": 3, "c": "x", "l": ["q"], "o": {"b": True}}, spec) == []
    assert len(jsonx.contract_errors({"a": " ", "n": True, "c": "z", "l": [1], "o": {}, "u": 1}, spec)) == 6
    assert jsonx.differences({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == ["a[1].b"]


def test_ranking(spark):
    rows = [("r", a, p, l) for a, order in ((1, "ABCDE"), (2, "BACDE")) for p, l in enumerate(order)]
    got = ranking.borda(spark.createDataFrame(rows, "k string, agent int, pos int, label string"), ["k"], 2)
    out = {r.label: (r.score, r.final_rank) for r in got.collect()}
    assert out["A"] == (9, 2) and out["B"] == (9, 1)
    h, m = spark.createDataFrame([("r", list("ACBDE"))], "k string, ranking array<string>"), spark.createDataFrame([("r", list("ABCDE"), 1)], "k string, ranking array<string>, ord int")
    r = ranking.agreement(h, m, ["k"]).first()
    assert (r.top1_match, r.full_match, r.rank_distance, round(r.spearman, 6)) == (True, False, 2, 0.9)


def subset(groups, target, seed, dataset, total):
    import hashlib

    h = lambda *p: hashlib.sha256("\0".join(map(str, p)).encode()).hexdigest()
    sums = {0: []}
    for g, n in sorted(groups.items(), key=lambda x: h(seed, dataset, x[0])):
        for s, v in list(sums.items()):
            sums.setdefault(s + n, v + [g]) if s + n not in sums else None
    best = min((abs(s - target), h(seed, dataset, s), v) for s, v in sums.items() if 0 < s < total)
    return set(best[2])


def test_group_split(spark):
    r = random.Random(4)
    sizes = {d: {f"t{i}": r.randint(1, 9) for i in range(r.randint(3, 25))} for d in ("x", "y")}
    rows = [(d, t, f"{d}{t}{k}") for d, ts in sizes.items() for t, n in ts.items() for k in range(n)]
    got = pairs.group_split(spark.createDataFrame(rows, "d string, t string, rec string"), "d", "t", "rec", 0.1).collect()
    for d, ts in sizes.items():
        total = sum(ts.values())
        assert {x.t for x in got if x.d == d and x.split == "test"} == subset(ts, max(1, round(total * 0.1)), 42, d, total)


def test_lineage(spark):
    df = spark.createDataFrame([(i, f"h{i}") for i in range(50)], "id long, h string")
    assert lineage.fingerprint(df, "id", "h").first() == lineage.fingerprint(df.orderBy(F.desc("id")).repartition(3), "id", "h").first()
    with pytest.raises(lineage.Violation):
        lineage.require_none(df, "rows")


def test_streaming_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(k % 7, f"s{k % 3}", k) for k in range(100)], "k long, status string, at long")
    rows.repartition(5).write.parquet(path)
    q = run_to_table(spark.readStream.schema(rows.schema).parquet(path), "latest_state", ["k"], "status", "at", str(tmp_path / "cp"))
    q.awaitTermination(60)
    batch = {(r.k, r.status) for r in attempts.latest(rows, ["k"], ["at"]).collect()}
    assert {(r.k, r.status) for r in spark.table("latest_state").collect()} == batch
    state = upsert_state(rows.where("at < 60"), None, ["k"], ["at"])
    twice = upsert_state(rows.where("at >= 60"), upsert_state(rows.where("at >= 60"), state, ["k"], ["at"]), ["k"], ["at"])
    assert {(r.k, r.status) for r in twice.collect()} == batch


def test_generation(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id long, prompt string")
    assert generation.self_consistency(df, 3).count() == 18
    assert {r.status for r in generation.single_pass(df).collect()} == {"valid"}
    assert {r.rounds for r in generation.self_refine(df, 2, seed=41).collect()} == {1}

    def broken():
        return lambda prompt, seed: "{}" if "refused" in prompt else "no"

    assert {r.attempt for r in generation.repair(df, 2, broken).collect()} == {1}


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text('<h2>One</h2><table><tr><td>Age</td><td>40</td><td>Town</td><td>X</td></tr></table><p class="q">Interviewer: Why?</p><p class="a">Participant: <b>So</b> it is.<h2>Two</h2><p class="q">Next', encoding="utf-8")
    rows = html.read_interviews(spark, str(tmp_path))
    assert [(r.turn_index, r.paragraph_index, r.role, r.text) for r in html.turns(rows, "p.q", "p.a").orderBy("turn_index").collect()][0] == (1, 1, "interviewer", "Why?")
    assert html.characteristics(rows.first().html) == {"Age": "40", "Town": "X"} and [s[1] for s in html.sections(rows.first().html, "h2")] == ["One", "Two"]
    (tmp_path / "int001t.rtf").write_bytes(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Pseudonym\par Ann\tab 40\par *Q: How?\par MALE; It\'92s \u233?t fine.\line More\par Q: Next\par}")
    got = rtf.speaker_turns(rtf.read_transcripts(spark, str(tmp_path))).orderBy("turn_index").collect()
    assert [(r.raw_speaker_label, r.raw_text) for r in got] == [("Q", "How?"), ("MALE", "It’s ét fine.\nMore"), ("Q", "Next")]
    assert rtf.cover_sheet("Pseudonym | Age\nAnn | 40\n*Q: x") == {"pseudonym": "Ann", "age": "40"}
    names = rtf.documented_names(spark.createDataFrame([("int001t | Interview transcript",), ("x",)], "value string"))
    assert [r.name for r in names.collect()] == ["int001t"]


def test_codebook(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i}">' + "".join(cell(f"{'ABC'[k]}{i}", v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    path = str(tmp_path / "c.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="S1"/><sheet name="S2"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([("Code", "Quotes", "Example Questions"), ("Cost pressure", "q1", "w1"), (None, "q2", "w1"), ("Other", "q3", None)]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([("Quote", "Codes"), ("q9", "cost pressure"), (None, "Other")]))
    book = {r.code_id: r for r in files.codebook(files.codebook_quotes(spark, path)).collect()}
    assert book["cost_pressure"].example_quotes == ["q1", "q2", "q9"] and book["cost_pressure"].code_label == "Cost pressure"
    assert book["other"].example_quotes == ["q3", "q9"] and book["other"].source_sheets == ["S1", "S2"]


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    lines = [{"record_id": "a", "text": "t", "speaker": "participant", "extra": 1}, {"record_id": "b", "text": "u", "speaker": "interviewer"}]
    p.write_text("\n".join(map(json.dumps, lines)) + "\n\n", encoding="utf-8")
    rows = files.jsonl_lines(spark, str(p))
    assert [(r.line, r.record_id, r.metadata["extra"]) for r in files.segment_records(rows, ["record_id", "text"]).collect()] == [(1, "a", "1")]
    e = tmp_path / "e.jsonl"
    e.write_text('{"record_id":"a","text":"t"}\n{"record_id":"a","text":"u"}\n{"record_id":"c","text":" "}\n{"record_id":"d"}\n', encoding="utf-8")
    found = files.exclusion_errors(files.jsonl_lines(spark, str(e))).orderBy("line").collect()
    assert [r.line for r in found] == [1, 2, 3, 4]
    out = str(tmp_path / "out")
    files.write_jsonl(spark.range(3), out, compress=True)
    with pytest.raises(Exception):
        files.write_jsonl(spark.range(3), out)
    assert spark.read.json(out).count() == 3 and files.inventory(spark, out).count() >= 1
    splits = str(tmp_path / "splits")
    files.write_splits(spark.createDataFrame([("train", '{"a": "£"}'), ("test", "raw  line")], "split string, raw string"), splits)
    assert spark.read.text(splits + "/split=train").first().value == '{"a": "£"}'
    files.write_manifest({"a": "é"}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == {"a": "é"}
