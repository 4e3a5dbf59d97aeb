"""Registered generation queries send whole texts."""

import hashlib
import json

from lectern.operators import generation
from lectern.plans import registry


def test_prompts_hold_whole_texts(spark, tmp_path, monkeypatch):
    texts = {1: "same start " * 40 + "one end", 2: "same start " * 40 + "another end"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: json.loads(r.payload)["digest"] for r in registry.QUERIES["dry_run_samples"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(f"42\0Summarise: {t}".encode()).hexdigest()[:12] for i, t in texts.items()}

    refine, seen = generation.self_refine, []
    monkeypatch.setattr(generation, "self_refine", lambda rows, *a, **k: seen.append(rows) or refine(rows, *a, **k))
    registry.QUERIES["self_refine_rounds"](spark, str(tmp_path))
    assert {r.doc_id: r.prompt for r in seen[0].collect()} == texts
