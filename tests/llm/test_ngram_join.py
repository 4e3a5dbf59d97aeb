import random

from test_tokenizers import morse

from lectern.llm.ngram_join import keep_one, ngram_jaccard_join

SCHEMA = "doc_id long, text string, node string"


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] < comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[b] = comp[a]
                    changed = True
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def fixture(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    rows = [(0, None, "x"), (1, "", "x"), (2, " \t\n ", "x"), (3, "one two", "x"), (4, "ONE  two", "x"), (5, "one two three", None), (6, "É é x a b c d", "x")]
    base = [word() for _ in range(120)]
    for k in range(40):  # a dense group near the threshold, chains included
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = word()
        rows.append((10 + k, " ".join(w), "x"))
    for k in range(20):
        rows.append((60 + k, " ".join(word() for _ in range(r.randint(5, 60))), "x"))
    passage = " ".join(word() for _ in range(50))
    rows += [(90 + k, passage + " " + " ".join(word() for _ in range(r.randint(3, 30))), "x") for k in range(25)]
    rows.append((200, "long " * 20000, "x"))
    rows.append((201, "long " * 30000, "x"))
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    rows = [(i, morse(n, x, y), "x") for i, (n, x, y) in enumerate((n, x, y) for n in (1024, 4096) for x, y in ("ab", "ba", "qz", "zq"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (1, i) for i, *_ in rows}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "z z z z z y", "x")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = keep_one(spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, "x"), (None, "q", "x")], SCHEMA))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3] and kept.columns == ["doc_id", "text", "node"]
