"""Pairs that bitmaps rule out: never pairs that link; long texts against brute force; packed postings."""

import random

import numpy as np

from test_ngram_join import SCHEMA, brute
from test_ngram_links import brute_links

from lectern.llm import ngram_join
from lectern.llm.ngram_join import BITS, ngram_jaccard_join, parity, possible, wide_apart, wide_parity


def test_wide_bitmaps_bound_the_difference():
    r = np.random.default_rng(4)
    for n in (1025, 1500, 2047, 2049, 5000):
        s = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for changed in (0, 1, 40, n // 4):
            t = np.unique(np.concatenate((s[changed:], r.integers(0, 2**64, changed + 7, dtype=np.uint64))))
            d = wide_apart(wide_parity(s), wide_parity(t))
            assert d <= len(np.setxor1d(s, t)) and d == wide_apart(wide_parity(t), wide_parity(s)) and (d > 0) == (len(np.setxor1d(s, t)) > 0)


def test_possible_keeps_links_and_drops_strangers(spark):
    r = np.random.default_rng(5)
    long = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (4000, 4100)]
    short = [np.unique(r.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2)]
    sets = [*long, *short, np.unique(np.concatenate((long[0][:3600], long[1][:300]))), short[0][30:]]
    rows = [(i, len(s), wide_parity(s) or None, *[int(x) for x in parity(s)]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, wide binary, " + ", ".join(f"{b} long" for b in BITS))
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 4), (2, 5)], "a long, b long")
    assert sorted(tuple(x) for x in possible(pairs, nodes, 75).collect()) == [(0, 4), (2, 5)]
    assert sorted(tuple(x) for x in possible(pairs, nodes, 75, bits=False).collect()) == [(0, 4), (2, 3), (2, 5)]


def test_packed_postings():
    rows = np.zeros(7, dtype=ngram_join._POST)
    rows["token"], rows["group"], rows["n"] = np.arange(7, dtype=np.uint64) << np.uint64(32), [5, 5, -2, -2, -2, 5, 9], [3, 3, 4, 4, 4, 3, 70000]
    got = ngram_join._posts(ngram_join._post_bytes(rows))
    assert got["token"].tolist() == list(range(7)) and got["group"].tolist() == rows["group"].tolist() and got["n"].tolist() == rows["n"].tolist()


def test_long_texts_equal_brute_force(spark):
    r = random.Random(6)
    rows, base = [], [[f"{x}{r.randrange(10**6)}" for _ in range(1900)] for x in "ab"]
    for k in range(24):  # some 30 changed words break the threshold
        w = list(base[k % 2])
        for _ in range(r.choice([1, 20, 50, 60, 90])):
            w[r.randrange(len(w))] = f"c{r.randrange(10**6)}"
        rows.append((k, " ".join(w[: r.choice([1900, 1700, 1100])]), "x"))
    got = {x.doc_id: x for x in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == brute(rows) and {i: x.links for i, x in got.items()} == brute_links(rows)
