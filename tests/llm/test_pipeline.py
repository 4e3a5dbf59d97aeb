"""The pipeline on planted cases, and the queries' columns."""

import random

import corpus_pipeline
from lectern.llm.queries import QUERIES


def tables(spark, folder):
    r = random.Random(2)
    syl = ["ba", "lo", "ti", "ren", "mu", "sha", "ko", "vi", "den", "pra"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [[i, text(60) + "\n" + text(20), "en", f"src{i % 20}"] for i in range(200)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    for i in range(0, 200, 5):
        docs[i][1] = docs[i][1].replace(" ", " idiot ", 1) + " worthless scumbag"
    passage = text(25)
    docs[1][1] += " " + passage  # contaminated
    docs[7][1] = docs[6][1]  # a copy
    w = docs[11][1].split(" ")
    docs[12][1] = " ".join([*w[:-1], "ba"])  # a near copy
    for i in range(21, 60):
        docs[i][1] += "\nAll rights reserved by nobody."
    spark.createDataFrame([(a, b, c, d, len(b)) for a, b, c, d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(5, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {1, 7, 12} | set(range(0, 200, 5))
    assert set(rows) == {d[0] for d in docs} - gone
    for i, r in rows.items():
        clean = docs[i][1].replace("\nAll rights reserved by nobody.", "")
        assert r.text == r.decoded == clean and r.n_chars == len(clean) and r.n_tokens == len(r.piece_ids) > 0
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert stage(spark, df, str(tmp_path)).columns == df.columns


def test_query_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    want = {
        "op2_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op4_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, str(tmp_path)).columns[: len(columns)] == columns
