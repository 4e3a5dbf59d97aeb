import pyarrow as pa
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.piece_transducer import Encoder, Transducer, compile_model, model_bytes, sentencepiece as transduce
from lectern.llm.token_counts import Counter, token_counts

JSON = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
LIB = Tokenizer.from_str(JSON)
COUNT = Counter(JSON)
SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ENC = Encoder(compile_model(model_bytes()))
HARD = ["", " ", "a", "  two  blanks ", "\n\n\t x\r\n y", "don't we'll I'M", "<|endoftext|>mid<|endoftext|> end", "é à b　c  d\x85e", "日本語 текст 😀 नमस्ते", "x" * 3000, "▁a▁▁b <s></s><0x0A>", "1234567 3.14 000", "    def f(x):\n\treturn x  # no"]
TEXT = st.text(alphabet=st.sampled_from("ab tThe é\n\t ▁1'sß日😀 .<|>"), max_size=60)


def morse(n, a, b):
    """The Thue-Morse word of n letters: with a and b changed over, polynomial hashes modulo 2^64 can't tell it apart."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


CONFUSING = [morse(n, x, y) for n in (1024, 4096) for x, y in (("a", "b"), ("b", "a"), ("q", "z"), ("z", "q"), ("ab ", "cd "), ("cd ", "ab "))]
LONG = ["".join("aeiouqwrtzüß日"[(i * i * 7 + i // 3) % 13] for i in range(60_000)), "the" * 20_000, ("word and " * 30 + "\n") * 800]


def test_confusing_and_long_texts():
    for texts in (CONFUSING, LONG):
        assert COUNT.count(pa.array(texts)).tolist() == [len(e) for e in LIB.encode_batch(texts, add_special_tokens=False)]
        ids, back = pieces(texts)
        assert ids == [SP.encode(x) for x in texts] and back == [SP.decode(x) for x in ids]


def test_unigram_takes_the_shortest_path():
    """A unigram model with byte fallback against the best of all segmentations."""
    pieces_, scores = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"], [-2.0, -2.5, -2.5, -2.75, -3.0, -3.25, -6.5, -3.5, -4.0]
    kinds = [2, 3, 3, *[6] * 256, *[1] * len(pieces_)]
    model = {"pieces": ["<unk>", "<s>", "</s>", *[f"<0x{i:02X}>" for i in range(256)], *pieces_], "scores": [0.0] * 259 + scores, "kinds": kinds, "prefix": True, "bpe": False, "unk": 0}
    enc, cost = Encoder(Transducer(model)), dict(zip(pieces_, scores))

    def best(x):
        paths = [(0.0, [])] + [None] * len(x)
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if paths[i] and x[i:j] in cost:
                    new = (paths[i][0] - cost[x[i:j]], [*paths[i][1], x[i:j]])
                    if not paths[j] or new[0] < paths[j][0]:
                        paths[j] = new
        return paths[-1][1]

    for text in ("abc", "a b", "abcabca cab", "cabc" * 100):
        ids, counts = enc.encode([text])
        assert [model["pieces"][i] for i in ids] == best("▁" + text.replace(" ", "▁")) and enc.decode(ids, counts) == [text]
    ids, counts = enc.encode(["aéb"])
    assert [model["pieces"][i] for i in ids] == ["▁a", "<0xC3>", "<0xA9>", "b"] and enc.decode(ids, counts) == ["aéb"]


def test_counts_equal_the_library():
    assert COUNT.count(pa.array(HARD)).tolist() == [len(e) for e in LIB.encode_batch(HARD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_equal_the_library_on_any_text(texts):
    assert COUNT.count(pa.array(texts, pa.string())).tolist() == [len(e) for e in LIB.encode_batch(texts, add_special_tokens=False)]


def pieces(texts):
    ids, counts = ENC.encode(texts)
    at, out = 0, []
    for c in counts.tolist():
        out.append(ids[at : at + c].tolist())
        at += c
    return out, ENC.decode(ids, counts)


def test_pieces_equal_the_library():
    ids, texts = pieces(HARD)
    assert ids == [SP.encode(x) for x in HARD]
    assert texts == [SP.decode(x) for x in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_pieces_equal_the_library_on_any_text(texts):
    ids, back = pieces(texts)
    assert ids == [SP.encode(x) for x in texts]
    assert back == [SP.decode(x) for x in ids]


def test_operators_on_rows(spark):
    rows = [(1, "the cat sat", "clash"), (1, "the cat sat", "clash"), (None, None, "clash"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = token_counts(df, JSON)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.n_bytes, r.n_tokens) for r in out.collect()) == [(0, 0), (0, 0), (11, 3), (11, 3)]
    clash = df.withColumnsRenamed({"n_tokens": "piece_ids"}).selectExpr("*", "1 AS decoded")
    assert transduce(clash, model_bytes()).columns == ["doc_id", "text", "piece_ids", "decoded"]
    out = transduce(df, model_bytes()).collect()
    assert sorted(str(r.decoded) for r in out) == ["", "None", "the cat sat", "the cat sat"]
    assert all(r.piece_ids == SP.encode(r.text or "") for r in out)
    assert token_counts(df.limit(0), JSON).count() == 0 and transduce(df.limit(0), model_bytes()).count() == 0
