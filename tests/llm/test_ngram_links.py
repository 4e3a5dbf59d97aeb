"""The links of the n-gram join against all pairs of sets."""

import random

import pytest

from lectern.llm.ngram_join import ngram_jaccard_join

from test_ngram_join import SCHEMA, fixture


def brute_links(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())
    different = set(sets.values()) - {frozenset()}
    return {i: sum(t != s and 100 * len(s & t) >= 75 * len(s | t) for t in different) if s else 0 for i, s in sets.items()}


@pytest.mark.parametrize("block", [4, 512])
def test_links_equal_brute_force(spark, block):
    rows = fixture()
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    for k in range(60):  # different texts that all link in pairs
        w = list(base)
        w[r.randrange(5, 195)] = f"x{k}"
        rows.append((300 + k, " ".join(w), "x"))
    rows += [(400, rows[-1][1], "x"), (401, rows[-1][1].upper(), "x")]
    got = {r.doc_id: r.links for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    want = brute_links(rows)
    assert got == want and want[310] == 59
