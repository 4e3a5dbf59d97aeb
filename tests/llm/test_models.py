"""Toxicity and LM scoring: held-out accuracy and defined edge cases; HTML extraction by hand."""

import random
import zlib

import numpy as np

from lectern.llm.html_extraction import content, extract, fold, hash_text, match, packed, parse, shape, unpacked, wrappers
from lectern.llm.lm_scoring import lm_scores
from lectern.llm.toxicity import drop_toxic, toxicity

DOCS = "doc_id long, text string, score string"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    syl = ["ba", "lo", "ti", "ren", "mu", "sha", "ko", "vi"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    bad = ["idiot", "pathetic", "worthless", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                b = r.choice(bad)
                w.insert(r.randrange(len(w)), b + b[-1] if r.random() < 0.3 else b)
        docs.append((i, " ".join(w), "clash"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    docs += [(None, None, None), (9000, "", None), (9001, "!!! ...", None), (9002, "ba lo " * 20000 + "patheticc", None), (5, docs[5][1], None)]
    df, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(0, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    out = toxicity(df, y)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    rows = out.collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[None].score == by[9001].score < 0.3 and by[9002].predicted == 1
    kept = drop_toxic(df, y)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert {r.score for r in toxicity(df.limit(3), y.limit(0)).collect()} == {0.0} and toxicity(df.limit(0), y).count() == 0


def test_lm_scores(spark):
    docs, _ = corpus(200)
    docs += [(1000 + i, "".join(random.Random(i).choice("zxqj#7 ") for _ in range(300)), None) for i in range(40)] + [(None, None, None), (2000, "", None)]
    y = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000, 0), (None, 1), (0, None)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, DOCS)
    rows = lm_scores(df, y).collect()
    good = [r.lm_score for r in rows if r.doc_id is not None and r.doc_id < 200]
    junk = [r.lm_score for r in rows if r.doc_id is not None and 1000 <= r.doc_id < 2000]
    assert min(good) > max(junk)
    assert {(r.n_tokens, r.lm_score) for r in rows if not r.text} == {(0, 0.0)}
    assert lm_scores(df.limit(0), y).count() == 0


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li>Home<li>{0}</ul></nav>
<div class="cookie-notice">We use cookies {0}</div><article><h1>Head {0}</h1><p>First <b>bold</b>ed&nbsp;&amp; {0}<br>next<p>Second {0}<div class="advert">Buy {0}</div>
<div class="teaser">Read all our stories</div><form><input value="q"><button>Go</button></form><script>var x = "</p>{0}";</script></article><section id="comments"><p>Nice {0}</p></section><footer>&copy; {0}</footer></body></html>"""


def test_extract(spark):
    rows = [(i, f"http://h{i % 2}.org/a/{i}", PAGE.format(i), "clash") for i in range(20)] + [(90, None, "<p>alone</p>", None), (91, "http://x.org", None, None), (92, "http://x.org", "", None), (93, "http://y.org/", "<article>" * 500 + "deep" + "</article>" * 500, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    for i in range(20):
        assert got[i] == f"Head {i} First bolded & {i} next Second {i}"
    assert (got[90], got[91], got[92], got[93]) == ("alone", "", "", "deep")
    assert extract(df.limit(0)).count() == 0 and wrappers(df).where("host is null").count() == 0


def wrapper(pages):
    tree = None
    for html in pages:
        page = parse(html)
        one = shape(page, hash_text(content(page, None)))
        tree = fold(tree, one) if tree else one
    return unpacked(packed(tree))


def test_copies_of_one_article_are_no_template():
    one = PAGE.format(1)
    assert content(parse(one), wrapper([one] * 9)) == "Head 1 First bolded & 1 next Second 1 Read all our stories"


BARE = """<html><body><div><ul><li><a href="/">Home {1}</a><li><a href="/x">News {1}</a></ul></div><div>Buy {1} now</div><div><h1>Head {0}</h1><p>First {0} of some length<p>Second {0}</div>{2}<div>All rights {1}</div></body></html>"""


def test_wrapper_finds_the_article_without_names():
    """No class, role or telling element: the slot of the varying text is the article, also on pages that alone would be judged otherwise."""
    text = lambda i: f"text {i} " * 30
    pages = [BARE.format(text(i), i, "<div><p>More like this<p>And this</div>" if i % 2 else "") for i in range(6)]
    tree = wrapper(pages)
    for i, html in enumerate(pages):
        assert content(parse(html), tree) == " ".join(f"Head {text(i)} First {text(i)} of some length Second {text(i)}".split())
    short = BARE.format("x", "many more words than the article has, and then as many again, to be sure", "")
    assert content(parse(short), tree) == "Head x First x of some length Second x" != content(parse(short), None)


def test_names_alone_do_not_drop_articles():
    one = '<article><h1>T</h1><div class="share-price related-work">Body of it</div><p id="login-flow">and more</p><div class="related-work"><a href="/">See this</a></div><div class="comment-list">Nice</div></article>'
    assert content(parse(one), None) == "T Body of it and more"
    teaser = f"<body><article>A teaser</article><div><p>{'main text ' * 20}</p></div></body>"
    assert content(parse(teaser), None).endswith("main text")


def test_any_depth():
    deep = '<div class="comments">' + "<div>" * 5000 + "</div>" * 5000 + "<p>reader comment</p></div><p>main</p>"
    assert content(parse(deep), None) == "main"
    page = "<div>" * 5000 + "<p>main</p>" + "</div>" * 5000
    assert content(parse(page), wrapper([page, page.replace("main", "other")])) == "main"


def test_matching_keeps_order():
    leaf = lambda s: [s, 0, [], 0, [], None]
    a, b = ["r", 0, [], 0, [leaf("x"), leaf("y"), leaf("z")], None], ["r", 0, [], 0, [leaf("z"), leaf("x"), leaf("z")], None]
    assert match(a, b) == (3, [(0, 1), (2, 2)])
