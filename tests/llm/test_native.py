"""Line dedup, decontamination and quality rules on small tables, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

from lectern.llm.decontamination import decontaminate, drop_contaminated, proximity_matches
from lectern.llm.line_dedup import clean_documents, line_dedup
from lectern.llm.quality_rules import ablation, apply_policy, ledger

DOCS = "doc_id long, text string, source string, n_words string"


def test_line_dedup(spark):
    rows = [(i, f"own line {i} with words\nAll rights reserved.\n\n own  {i}\nnear {i % 11}", f"s{i}", "clash") for i in range(60)]
    rows += [(100, None, "s1", None), (101, "", None, None), (102, "All rights reserved.", "s1", None), (103, "x\nAll rights reserved. \nthe rest of the document stays here", None, None), (103, "x\nAll rights reserved. \nthe rest of the document stays here", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    rows += [(200 + i, "a copy as a whole\nof one document", f"s{i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    spread, least = defaultdict(set), {}
    for _, t, s, _ in rows:
        if s is not None:
            least[t] = min(least.get(t, s), s)
    for _, t, s, _ in rows:
        s = least.get(t)
        for line in (t or "").split("\n"):
            if line.strip(" ") and s is not None:
                spread[line.strip(" ")].add(s)

    def clean(t):
        if t is None:
            return None, 0
        kept = [x for x in t.split("\n") if not len(spread.get(x.strip(" "), ())) >= 10]
        new = "\n".join(kept)
        return new, len(t.split("\n")) - len(kept)

    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup(df).collect()), key=str)
    assert got == sorted(((i, *clean(t)) for i, t, _, _ in rows), key=str)
    assert clean_documents(df).columns == df.columns and line_dedup(df.limit(0)).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for g in {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v else ():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (10, "ÉTÉ étÉ x9"), (3, ""), (4, None), (None, "rare thing"), (5, "one two"), (6, "a a a a a a a a a a a")]
    rows = [
        (1, "x ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa lambda mu one", "s", None), (2, "alpha beta gamma delta epsilon zeta eta theta iota", "s", None), (3, "one two one two", None, None),
        (3, "one two one two", None, None), (4, None, "s", None), (5, "", "s", None), (6, "été étÉ x9 ÉTÉ ÉtÉ x9", "s", None), (None, "a rare thing", "s", None), (7, "a " * 3000 + "one  two", "s", None), (8, "a " * 10, "s", None), (9, "one x two", "s", None),
    ]
    df, it = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(df, it).collect())
    assert got == sorted((str(i), *contaminated(t, items)) for i, t, *_ in rows)
    assert {r.doc_id for r in drop_contaminated(df, it).collect()} == {i for i, t, *_ in rows if not contaminated(t, items)[1]}
    near = proximity_matches(df, spark.createDataFrame([(2, "one two")], "item_id long, text string"), slop=1)
    assert {r.doc_id for r in near.collect()} == {3, 7, 9}
    assert decontaminate(df.limit(0), it).count() == 0 and not decontaminate(df, it.limit(0)).where("contaminated").count()


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_ledger(spark):
    texts = [None, "", " \n\t", "a b c d", "a " * 12, "a b c d e a b c d e x y z", "one\none\n two \ntwo\n\x0bthree\n", "# $ | word <b> & 50%", "é 日本 ß\x0cx\ry " * 4, "w%d " * 3000, " ".join(f"w{i}" for i in range(5000)) + " w1 w2 w3 w4 w5", "same line here\n" * 50]
    df = spark.createDataFrame([(i, t, "s", "clash") for i, t in enumerate(texts)] + [(None, "a b", None, None)] * 2, DOCS)
    rows = apply_policy(ledger(df)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.doc_id is not None}
    assert got == {i: measures(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    table = {r.rule: (r.n_failed, r.n_alone) for r in ablation(ledger(df)).collect()}
    assert table["few_words"][0] == sum(r.n_words < 10 for r in rows)
    assert table["symbols"][1] == sum(r.fail_bits == 4 for r in rows)
    assert ledger(df.limit(0)).count() == 0
