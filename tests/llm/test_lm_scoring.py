"""LM scoring against counts of the tokens and pairs themselves."""

import math
import random
import re
from collections import Counter

import pytest

from lectern.llm.lm_scoring import lm_scores


def brute(rows, wanted):
    words = lambda t: re.findall(r"[ \t-\r]?(?:[0-9A-Za-z\x80-\U0010ffff]+|[^ \t-\r0-9A-Za-z\x80-\U0010ffff])|[ \t-\r]", t or "")
    models = []
    for only in (True, False):
        one, two = Counter(), Counter()
        for i, t, *_ in rows:
            w = words(t)
            if w and (i in wanted or not only):
                one.update([*w, None])
                two.update(zip([None, *w], [*w, None]))
        models.append((one, two))
    vocabulary = len(models[1][0])
    out = []
    for i, t, *_ in rows:
        w, losses = words(t), []
        for one, two in models:
            p1 = lambda x: (one[x] + 1) / (one.total() + vocabulary)  # noqa: E731, B023
            losses.append(sum(-math.log((two[a, b] + 4 * p1(b)) / (one[a] + 4)) for a, b in zip([None, *w], w)) / max(1, len(w)))  # noqa: B023
        out.append((str(i), len(w), *losses, losses[1] - losses[0]))
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 500, 1 << 21])
def test_equals_brute_force(spark, piece):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé7") for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word() + r.choice(["", "", ",", ".\n", "?!"]) for _ in range(r.randint(1, 60))), "x") for i in range(150)]
    rows += [(200, None, "x"), (201, "", "x"), (202, " \n\t", "x"), (203, "...", None), (None, "ab cd, ab", None), (204, "ab cd " * 30_000, None), (5, rows[5][1], "x")]
    wanted = [*range(0, 150, 3), 203, 200]
    labels = spark.createDataFrame([(i, 1) for i in wanted] + [(3, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lm_score string")
    out = lm_scores(df, labels, piece=piece)
    assert out.columns == ["doc_id", "text", "n_tokens", "loss_target", "loss_background", "lm_score"]
    got = sorted((str(r.doc_id), r.n_tokens, r.loss_target, r.loss_background, r.lm_score) for r in out.collect())
    want = brute(rows, set(wanted))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], abs=1e-9)


def test_no_target_is_uniform(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a a")], "doc_id long, text string")
    rows = lm_scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r.loss_target for r in rows] == pytest.approx([math.log(5)] * 2)
