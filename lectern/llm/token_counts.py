"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where the byte-level pre-tokeniser always splits: before white space that
follows a character which is none. Equal segments of a task, by their bytes, are encoded once, by
the tokenizers library itself, in batches balanced by bytes; only lengths leave the worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens
inside a text are handled as the library does by default; nothing is truncated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, others, own, table, tidy, widened
from .kernels import SPACES, chunks, distinct_spans

BATCH_BYTES = 1 << 19
CACHE = 1 << 18  # segments that a task remembers


def segments(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of segments that the pre-tokeniser can't join."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    before = np.zeros(len(buf), dtype=bool)
    last = buf[:-1]
    before[1:] = (last > 0x20) & (last < 0x7F)  # visible ASCII, or a Latin-1 letter
    before[2:] |= (last[1:] >= 0x80) & (buf[:-2] == 0xC3)
    cut = SPACES[buf] & before
    inside = offs[:-1][np.diff(offs) > 0]
    cut[inside] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(offs, starts, side="right") - 1


class Counter:
    """Lengths of texts under a tokenizer, remembering segments."""

    def __init__(self, json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def _encode(self, texts: list[bytes]) -> np.ndarray:
        out, batch, held = [], [], 0
        for i, t in enumerate(texts):
            batch.append(t.decode("utf-8"))
            held += len(t)
            if held >= BATCH_BYTES or i == len(texts) - 1:
                out += [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, held = [], 0
        return np.array(out, dtype=np.int64)

    def count(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(len(column), dtype=np.int64)
        for a, b, buf, offs in chunks(column, 1 << 21):
            starts, ends, row = segments(buf, offs)
            if not len(starts):
                continue
            first, number = distinct_spans(buf, starts, ends)
            raw = buf.tobytes()
            parts = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
            new = [x for x in parts if x not in self.known]
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, parts
            self.known.update(zip(new, self._encode(new).tolist()))
            lengths = np.array([self.known[x] for x in parts], dtype=np.int64)
            total[a:b] += np.bincount(row, weights=lengths[number], minlength=b - a).astype(np.int64)
        return total


def token_counts(docs: DataFrame, tokenizer_json: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. tokenizer_json: the tokenizer's file content, sent to the tasks."""
    spark = docs.sparkSession
    arrow_rows(spark)
    model = spark.sparkContext.broadcast(tokenizer_json)
    n = own("n_tokens")

    def run(batches):
        counter = Counter(model.value)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.count(batch.column(i)), pa.int64())], names=[*batch.schema.names, n])

    out = docs.mapInArrow(tidy(run), widened(docs, **{n: "long"}))
    return out.select(*others(docs, "n_bytes", "n_tokens", "over_limit"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json = f.read()
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), json).drop("text")
