"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's bag holds its character n-grams (3 to 5, with word ends marked) and the word
itself, hashed into a fixed table. A window of four words is the average of its words'
bags; a linear softmax over that average gives the window's toxicity, and a document is
as toxic as its worst window, so a long text does not dilute a short insult. Embeddings
and softmax are trained jointly (AdaGrad on the worst windows, numpy, in one executor
task, which returns the folded weights) on a bounded sample of labelled rows: the TRAIN_ROWS
of each class that come first by the hash of the id, then by the id. Unseen misspellings keep most of their n-grams, and
with these most of their score.

For scoring the table is folded into one weight per bucket (4 MB, whatever the corpus),
which tasks apply to whole texts.

Defined results: null, empty and wordless texts score the rate of an empty bag, near 0;
if no labelled row of both classes is usable, every score is 0; repeated labels of
a document count as toxic if one is; of rows that share an id the least text trains; null labels and ids without a document are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, others, own, table, tidy, widened
from .kernels import LOWER_TABLE, LOWER_VALUE, U64, chunks, mix, powers, span_hashes, spans

BUCKETS = 1 << 20
GRAMS = (3, 4, 5)
WINDOW = 4
#: Bounds of the training sample: rows of each class, bytes of a text.
TRAIN_ROWS = 1500
TRAIN_BYTES = 10_000
THRESHOLD = 0.7
REMEMBERED = 1 << 18  # words that a scoring task remembers

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x80:] = False


def distinct_words(buf, offs):
    """Row of each word, its number among the distinct words, these words in one buffer with a separator around each, and their hashes."""
    starts, ends, row = spans(buf, offs, NOT_WORD)
    keys, first, number = np.unique(span_hashes(buf, starts, ends, LOWER_TABLE), return_index=True, return_inverse=True)
    starts, length = starts[first], (ends - starts)[first]
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    out = np.full(begin[-1] + 1, 0x20, dtype=np.uint8)
    region = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(region)) + region + 1
    out[at] = buf[at - begin[region] - 1 + starts[region]]
    return row, number.ravel(), out, begin[:-1], length, keys


def subwords(words: np.ndarray, begin: np.ndarray, length: np.ndarray):
    """(word, bucket) of every subword."""
    up, down = powers(len(words) + 1)
    region = np.repeat(np.arange(len(length)), length + 1)
    rel = np.arange(len(region)) - begin[region]
    which, buckets = [], []
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(LOWER_VALUE[words] * up[: len(words)], out=total[1:])
        for n in GRAMS:
            i = np.flatnonzero(rel < length[region] + 3 - n)
            which.append(region[i])
            buckets.append(mix((total[i + n] - total[i]) * down[i] + U64(n)))
        a = begin
        which.append(np.arange(len(length)))
        buckets.append(mix((total[a + length + 2] - total[a]) * down[a] + U64(99)))
    return np.concatenate(which), (np.concatenate(buckets) & U64(BUCKETS - 1)).astype(np.int64)


def _windows(row: np.ndarray):
    """Window of each word: runs of WINDOW words within a row; and the row of each window."""
    if not len(row):
        return row, row
    first = np.concatenate(([True], row[1:] != row[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    new = first | ((np.arange(len(row)) - start) % WINDOW == 0)
    return np.cumsum(new) - 1, row[new]


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The buckets in use, the weight of each in a word's average, and the bias, of the log-odds of toxicity."""
    y = np.array(labels, dtype=np.float64)
    if not (0 < y.sum() < len(y)):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -np.inf
    # words of all chunks, each once: a later chunk's words that an earlier one had take its number
    rows, numbers, which, bucket, hashes, n = [], [], [], [], np.zeros(0, dtype=np.uint64), 0
    for a, _, buf, offs in chunks(pa.array(texts)):
        row, number, words, begin, length, keys = distinct_words(buf, offs)
        w, b = subwords(words, begin, length)
        known = np.isin(keys, hashes)
        at = np.where(known, 0, n + np.cumsum(~known) - 1)
        order = np.argsort(hashes)
        at[known] = order[np.searchsorted(hashes[order], keys[known])]
        rows.append(row + a)
        numbers.append(at[number])
        new = ~known[w]
        which.append(at[w[new]])
        bucket.append(b[new])
        hashes = np.concatenate((hashes, keys[~known]))
        n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -np.inf
    row, number, which, bucket = (np.concatenate(x).astype(np.int32) for x in (rows, numbers, which, bucket))
    length = hashes  # one entry per distinct word
    by = np.argsort(which, kind="stable")
    which, bucket = which[by], bucket[by]
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.ravel()
    size = np.bincount(which, minlength=len(length)).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(size).astype(np.int64)))
    window, owner = _windows(row)
    per = np.bincount(window).astype(np.float64)
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))

    # start from the log-odds of a bucket's document frequency, along one direction
    pairs = np.unique(row * np.int64(len(length)) + number)
    doc, word = pairs // len(length), pairs % len(length)
    df = [np.bincount(bucket, weights=np.bincount(word, weights=w[doc], minlength=len(length))[which], minlength=len(used)) for w in (y, 1 - y)]
    odds = np.log((df[0] + 0.3) / (y.sum() + 1)) - np.log((df[1] + 0.3) / (len(y) - y.sum() + 1))
    odds[(df[0] + df[1]) < 3] = 0
    rng = np.random.default_rng(seed)
    soft = rng.normal(size=(dim, 2)) / np.sqrt(dim)
    bias = np.array([2.0, -2.0])
    axis = soft[:, 1] - soft[:, 0]
    emb = rng.normal(size=(len(used), dim)) * 0.01 + np.outer(np.maximum(odds, -1), axis / (axis @ axis)) * 2
    g_emb, g_soft, g_bias = np.full(len(used), 1e-8), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    weight = np.where(y == 1, 0.8 / y.sum(), 0.2 / (len(y) - y.sum()))
    docs_with = owner[edge]

    def logits():
        s = emb @ (soft[:, 1] - soft[:, 0])
        w = np.add.reduceat(s[bucket], at[:-1]) / size
        return np.bincount(window, weights=w[number]) / per + bias[1] - bias[0]

    for epoch in range(epochs):
        z = logits()
        top = np.maximum.reduceat(z, edge)
        worst = np.flatnonzero(z == np.repeat(top, np.diff(np.append(edge, len(z)))))
        _, one = np.unique(owner[worst], return_index=True)
        take = worst[one]
        some = rng.choice(np.flatnonzero(y[owner] == 0), size=len(y), replace=True) if (y[owner] == 0).any() else take[:0]
        take, share = np.concatenate((take, some)), np.concatenate((weight[docs_with], np.full(len(some), 0.25 / max(1, len(some)))))
        grad = (1 / (1 + np.exp(-z[take])) - y[owner[take]]) * share * len(y)
        per_window = np.zeros(len(per))
        np.add.at(per_window, take, grad)
        hot = np.flatnonzero(per_window[window])
        d_word = np.bincount(number[hot], weights=per_window[window[hot]] / per[window[hot]], minlength=len(length)) / size
        d_bucket = np.bincount(bucket, weights=d_word[which], minlength=len(used))
        axis = soft[:, 1] - soft[:, 0]
        d_axis = emb.T @ d_bucket
        g_emb += d_bucket**2
        emb -= (0.5 * d_bucket / np.sqrt(g_emb))[:, None] * axis[None, :]
        for j, sign in ((0, -1.0), (1, 1.0)):
            g = sign * d_axis
            g_soft[:, j] += g**2
            soft[:, j] -= 0.02 * g / np.sqrt(g_soft[:, j])
            g_bias[j] += (sign * grad.sum()) ** 2
            bias[j] -= 0.1 * sign * grad.sum() / np.sqrt(g_bias[j])
    return used, (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Toxicity of texts under folded weights; remembers the words that it has met."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, bias: float):
        self.weights = np.zeros(BUCKETS, dtype=np.float32)
        self.weights[buckets] = values
        self.bias = bias
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)

    def words(self, words, begin, length, keys) -> np.ndarray:
        """The average weight of each word's bag."""
        out = np.zeros(len(keys), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            size = length[new] + 1
            pick = np.repeat(begin[new] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            which, bucket = subwords(np.append(words[pick], np.uint8(0x20)), np.cumsum(size) - size, length[new])
            out[new] = np.bincount(which, weights=self.weights[bucket]) / np.bincount(which)
            if len(self.keys) + len(new) > REMEMBERED:
                self.keys, self.values = keys[:0], out[:0]
            joined = np.concatenate((self.keys, keys[new]))
            by = np.argsort(joined)
            self.keys, self.values = joined[by], np.concatenate((self.values, out[new]))[by]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Toxicity of each text of the column."""
        out = np.full(len(column), self.bias)
        for a, _, buf, offs in chunks(column):
            row, number, words, begin, length, keys = distinct_words(buf, offs)
            if not len(row):
                continue
            word = self.words(words, begin, length, keys)
            window, owner = _windows(row)
            z = np.bincount(window, weights=word[number]) / np.bincount(window) + self.bias
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[a + owner[edge]] = np.maximum(np.maximum.reduceat(z, edge), self.bias)
        return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -700, 700))))


def _training(batches):
    """All rows (text, y) of one task to one row: the buckets in use, their weights, the bias."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    buckets, values, bias = train(texts, labels)
    yield pa.RecordBatch.from_pydict({"buckets": pa.array([buckets.astype("<i4").tobytes()], pa.binary()), "weights": pa.array([values.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})


def _held_out(id_col):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from at most `rows` labelled documents of each class, none of them held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~_held_out(id_col)).groupBy(F.col(id_col).alias(own("id"))).agg((F.max(label_col) == 1).cast("int").alias(own("y")))
    sizes = docs.where(F.octet_length(text_col) <= most_bytes).select(F.col(id_col).alias(own("id"))).join(known, own("id")).distinct()
    picked = None
    for y in (1, 0):
        part = sizes.where(F.col(own("y")) == y).orderBy(F.xxhash64(own("id")), own("id")).limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.where(F.octet_length(text_col) <= most_bytes).join(F.broadcast(picked), F.col(id_col) == F.col(own("id"))).groupBy(own("id")).agg(F.min(text_col).alias("text"), F.first(own("y")).alias("y"))
    # at most 2 * rows texts of bounded size: one task holds them, and trains; the driver gets the weights alone
    model = sample.repartition(1).sortWithinPartitions(own("id")).select("text", "y").mapInArrow(tidy(_training), "buckets binary, weights binary, bias double").first()
    if model is None:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), -np.inf
    return np.frombuffer(model.buckets, "<i4"), np.frombuffer(model.weights, "<f4"), model.bias


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs with held_out, score and predicted."""
    spark = docs.sparkSession
    arrow_rows(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    score = own("score")

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(batch.column(i)), pa.float64())], names=[*batch.schema.names, score])

    out = docs.mapInArrow(tidy(run), widened(docs, **{score: "double"}))
    return out.select(*others(docs, "held_out", "score", "predicted"), _held_out(id_col).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if {"held_out", "score", "predicted"}.isdisjoint(docs.columns):
        return toxicity(docs, labels).where("predicted = 0").select(*columns)
    row = own("row")
    marked = toxicity(docs.select(F.struct(*columns).alias(row), "doc_id", "text"), labels)
    return marked.where("predicted = 0").select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")).drop("text")
