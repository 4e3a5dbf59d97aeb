"""LM scoring by cross-entropy difference.

A target model (documents labelled good) and a background model (all documents) are
matched: same order, same smoothing, one vocabulary, that of the whole corpus. A document's
score is the mean over its tokens of the background loss minus the target loss; higher is
closer to the target.

Tokens are words (runs of letters, digits and bytes from 0x80) and single marks, each with the
blank before it, and each blank left. Models are interpolated 2- and 1-gram models over tokens. Every token and every pair is counted under a
64-bit hash of its own, so the count tables grow with the corpus:

1.  Texts are gathered into pieces of about PIECE tokens. A piece sends its distinct tokens and
    pairs with their counts, packed by range of the hash, and its texts.
2.  Each range adds up its counts over all pieces and answers each piece in the piece's order.
3.  Each piece scores its texts by these answers; no table is held whole anywhere.

A boundary token stands between texts, so that a token's count is its count as a context.

Defined results: null and empty texts have no tokens and losses and score 0; a null or
repeated label counts once and only if it is the good one; without any target
document the target model is its prior, uniform over the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, others, own, row_key, small_side, table, tidy
from .kernels import SPACES, U64, chunks, mix, span_hashes

PIECE = 1 << 21  # tokens of a piece, about
RANGE = 1 << 20  # counts that meet in one range, about
MASS2, MASS1 = 4.0, 1.0
BOUNDARY = U64(0x6C6D5F626F756E64)  # no token hashes to it but by chance
#: 0: blank, 1: part of a word, 2: a mark, a token by itself.
KIND = np.where(SPACES, 0, 2).astype(np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of the texts, in order, and the number of tokens of each text."""
    if not len(buf):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offs) - 1, dtype=np.int64)
    kind = KIND[buf]
    begins = kind == 0
    begins[1:] |= (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    begins[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(begins)
    return span_hashes(buf, starts, np.append(starts[1:], len(buf))), np.diff(np.searchsorted(starts, offs))


def grams(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a piece with a boundary after each text that has any, and the hash of each with the token before it."""
    seq = np.insert(words, np.cumsum(n)[n > 0], BOUNDARY)
    before = np.concatenate(([BOUNDARY], seq[:-1]))
    with np.errstate(over="ignore"):
        return seq, mix(before * U64(0xD6E8FEB86659FD93) + seq)


def packed(x: np.ndarray) -> bytes:
    """An array for shipping: its bytes by place, compressed; none is lost."""
    return np.array([x.nbytes], dtype="<i8").tobytes() + pa.compress(pa.py_buffer(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, kind: str) -> np.ndarray:
    size, kind = np.frombuffer(data, "<i8", 1)[0], np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data.slice(8), int(size), codec="zstd"), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Each number less the one before it; a cumulative sum gives the numbers back."""
    return np.diff(x, prepend=U64(0))


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins and the last one ends in sorted keys."""
    starts = np.array([-(-(i << 64) // ranges) for i in range(ranges)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _pieces(ranges: int, most: int):
    """Batches (text, key, good) to rows (range, piece, texts, keys, counts): a row for each piece and range, the texts with one of them."""

    def flush(held):
        words, n, keys, good, texts = (np.concatenate([h[i] for h in held]) for i in range(5))
        piece = int(mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))
        flags = np.repeat(good, n + (n > 0))
        found = []
        for x in grams(words, n):
            key, at = np.unique(x, return_inverse=True)
            found.append((key, np.bincount(at, minlength=len(key)).astype("<u4"), np.bincount(at[flags], minlength=len(key)).astype("<u4"), bounds(key, ranges)))
        lengths = np.concatenate([h[5] for h in held])
        head = np.array([len(keys), len(texts)], dtype="<i8").tobytes() + keys.astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
        whole = head + pa.compress(pa.py_buffer(texts), codec="zstd", asbytes=True)
        cell = lambda i, part: np.concatenate([f[part][f[3][i] : f[3][i + 1]] for f in found])
        row = range(ranges)
        return pa.RecordBatch.from_pydict(
            {
                "range": pa.array(row, pa.int32()), "piece": pa.array([piece] * ranges, pa.int64()), "texts": pa.array([whole if i == piece % ranges else None for i in row], pa.binary()),
                "singles": pa.array([int(found[0][3][i + 1] - found[0][3][i]) for i in row], pa.int64()), "keys": pa.array([packed(steps(cell(i, 0))) for i in row], pa.binary()),
                "counts": pa.array([packed(cell(i, 1)) for i in row], pa.binary()), "good": pa.array([packed(cell(i, 2)) for i in row], pa.binary()),
            }
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            keys, good = np.array(batch.column(1).to_pylist(), dtype=np.int64), np.array(batch.column(2).to_pylist(), dtype=bool)
            for a, b, buf, offs in chunks(batch.column(0)):
                words, n = tokens(buf, offs)
                held.append((words, n, keys[a:b], good[a:b], buf, np.diff(offs)))
                size += len(words)
                if size >= most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


_PIECES = "range int, piece long, texts binary, singles long, keys binary, counts binary, good binary"


def _adding(t: pa.Table) -> pa.Table:
    """One range: the sums over all pieces, answered to each piece, with the range's share of the vocabulary and of the tokens."""
    read = lambda name, kind: [unpacked(x.as_buffer(), kind) for x in t.column(name)]
    keys, counts, good, singles = [np.cumsum(x, dtype=np.uint64) for x in read("keys", "<u8")], read("counts", "<u4"), read("good", "<u4"), t.column("singles").to_pylist()
    sums = [[], []]
    for part in (0, 1):
        side = lambda xs: [x[s:] if part else x[:s] for x, s in zip(xs, singles)]  # noqa: E731, B023
        mine = side(keys)
        key, at = np.unique(np.concatenate(mine), return_inverse=True)
        both = [np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)]
        cuts = np.cumsum([len(x) for x in mine])[:-1]
        for total, xs in zip(both, (counts, good)):
            np.add.at(total, at, np.concatenate(side(xs)).astype(np.int64))
        if not part:
            share = np.array([len(key), both[0].sum(), both[1].sum()], dtype="<i8").tobytes()
        for k in (0, 1):
            sums[k].append(np.split(both[k][at], cuts))
    answer = lambda k: pa.array([packed(np.concatenate((x, y))) for x, y in zip(*sums[k])], pa.binary())
    return pa.table({"range": t.column("range"), "piece": t.column("piece"), "texts": t.column("texts"), "singles": t.column("singles"), "share": pa.array([share] * t.num_rows, pa.binary()), "counts": answer(0), "good": answer(1)})


def losses(total: int, vocabulary: int, single: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Loss in nats of tokens, by the counts of the token, of the token before it and of both."""
    p = (single + MASS1) / (total + MASS1 * vocabulary)
    return -np.log((pair + MASS2 * p) / (before + MASS2))


def _scoring(ranges: int):
    """One piece: its texts' (key, n_tokens, loss_target, loss_background)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("range")
        if t.column("range").to_pylist() != list(range(ranges)):
            raise RuntimeError("a piece lacks the answer of a range, or has one twice")
        data = next(x for x in t.column("texts") if x.is_valid).as_buffer()
        rows, size = np.frombuffer(data, "<i8", 2)
        keys, lengths = np.frombuffer(data, "<i8", rows, 16), np.frombuffer(data, "<i8", rows, 16 + 8 * rows)
        buf = np.frombuffer(pa.decompress(data.slice(16 + 16 * rows), size, codec="zstd"), dtype=np.uint8)
        offs = np.concatenate(([0], np.cumsum(lengths)))
        found = [tokens(part, o) for _, _, part, o in chunks(pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(rows), [None, pa.py_buffer(offs), pa.py_buffer(buf)]))]
        n = np.concatenate([f[1] for f in found])
        single, pair = (np.unique(x, return_inverse=True)[1] for x in grams(np.concatenate([f[0] for f in found]), n))
        vocabulary, *totals = sum(np.frombuffer(x.as_buffer(), "<i8") for x in t.column("share")).tolist()
        word = np.insert(np.ones(n.sum(), dtype=bool), np.cumsum(n)[n > 0], False)
        row = np.repeat(np.arange(len(n)), n)
        singles, out = t.column("singles").to_pylist(), {}
        for name, column, total in (("loss_background", "counts", totals[0]), ("loss_target", "good", totals[1])):
            parts = [unpacked(x.as_buffer(), "<i8") for x in t.column(column)]
            c1 = np.concatenate([x[:s] for x, s in zip(parts, singles)])[single]
            c2 = np.concatenate([x[s:] for x, s in zip(parts, singles)])[pair]
            ends = c1[~word][:1] if len(c1) else c1
            loss = losses(total, vocabulary, c1, np.concatenate((ends, c1[:-1])), c2)
            out[name] = np.bincount(row, weights=loss[word], minlength=len(n)) / np.maximum(n, 1)
        return pa.table({"key": pa.array(keys), "n_tokens": pa.array(n.astype(np.int64)), "loss_target": pa.array(out["loss_target"]), "loss_background": pa.array(out["loss_background"])})

    return run


def lm_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", piece: int = PIECE) -> DataFrame:
    """docs with n_tokens, loss_target, loss_background and lm_score."""
    spark = docs.sparkSession
    arrow_rows(spark)
    good, id_, key = own("good"), own("id"), own("key")
    wanted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias(id_)).where(F.col(id_).isNotNull()).distinct().withColumn(good, F.lit(True))
    flagged = docs.select(F.col(id_col).alias(id_), F.col(text_col).alias("text"), row_key(docs, id_col, text_col).alias(key)).join(small_side(cut(wanted)), id_, "left")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(8, size // 8 // RANGE + 1)
    pieces = flagged.select("text", key, F.coalesce(good, F.lit(False)).alias("good")).mapInArrow(tidy(_pieces(ranges, piece)), _PIECES)
    answers = pieces.groupBy("range").applyInArrow(_adding, "range int, piece long, texts binary, singles long, share binary, counts binary, good binary")
    scores = answers.groupBy("piece").applyInArrow(_scoring(ranges), "key long, n_tokens long, loss_target double, loss_background double")
    names = ["n_tokens", "loss_target", "loss_background"]
    scores = scores.groupBy(F.col("key").alias(key)).agg(*[F.first(n).alias(own(n)) for n in names])
    out = docs.withColumn(key, row_key(docs, id_col, text_col)).join(scores, key)
    return out.select(*others(docs, *names, "lm_score"), *[F.col(own(n)).alias(n) for n in names], (F.col(own("loss_background")) - F.col(own("loss_target"))).alias("lm_score"))


def op7_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")).drop("text")
