"""Quality rules as a bitmask ledger, in DataFrame expressions alone.

Every rule is evaluated once per document: its measurement is stored, and the bit of
a failed rule is set in `fail_bits`. Policies are versioned masks over these bits;
applying one, or asking what each rule alone decides (ablation), reads the ledger and
never the texts. The ledger needs no shuffle.

Defined results: null or blank text has no words and fails `few_words`; documents of
under five words have no windows; rows repeat as they do in the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, table

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"

#: Bit of each rule. A bit keeps its meaning for ever; new rules take new bits.
BITS = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "short_words": 4, "long_words": 5}
#: Policies by version: the rules that reject.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")}


def mask(version: str) -> int:
    return sum(1 << BITS[r] for r in POLICIES[version])


def _without(text: Column, chars) -> Column:
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), chars, text)


def _repeats(hashes: Column) -> Column:
    """Words inside 5-word windows whose hash stands twice or more in the array."""
    # equal hashes are neighbours once sorted; positions of those with an equal neighbour, in text order
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    n = F.size(hashes)
    nothing = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
    near = F.arrays_zip(pairs.alias("s"), F.concat(nothing, F.slice(pairs, F.lit(1), n - 1)).alias("a"), F.concat(F.slice(pairs, F.lit(2), n - 1), nothing).alias("b"))
    twice = F.filter(near, lambda z: (z["s"]["h"] == z["a"]["h"]) | (z["s"]["h"] == z["b"]["h"]))
    at = F.sort_array(F.transform(twice, lambda z: z["s"]["p"]))
    step = lambda acc, p: F.struct((acc["n"] + F.lit(5) - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + 5).alias("end"))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and fail_bits."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words, wins = own("words"), own("windows")
    out = docs.withColumn(words, F.array_remove(F.split(t, "[ \t-\r]+"), ""))
    w = F.col(words)
    n = F.size(w)
    zipped = F.arrays_zip(w, *[F.slice(w, F.lit(i), F.greatest(n - (i - 1), F.lit(0))) for i in range(2, 6)])
    out = out.withColumn(wins, F.when(n >= 5, F.transform(F.slice(zipped, F.lit(1), F.greatest(n - 4, F.lit(0))), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    h = F.col(wins)
    bare = _without(t, SPACES)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"),
            own("lines"): lines,
            "n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeats(h)).cast("long"),
        }
    ).drop(words, wins)
    l = F.col(own("lines"))
    out = out.withColumns({"n_lines": F.size(l).cast("long"), "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long")}).drop(own("lines"))
    rules = {
        "few_words": F.col("n_words") < 10,
        "repeated_windows": F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
        "symbols": F.col("n_symbols") * 100 > F.col("n_words") * 10,
        "duplicate_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
        "short_words": F.col("word_chars") < F.col("n_words") * 2,
        "long_words": F.col("word_chars") > F.col("n_words") * 20,
    }
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << BITS[r]).cast("long")).otherwise(F.lit(0).cast("long")) for r, c in rules.items()])
    return out.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """A ledger with base_failed and kept under the policy."""
    failed = lambda v: F.col("fail_bits").bitwiseAND(F.lit(mask(v)).cast("long")) != 0
    return rows.withColumns({"base_failed": failed("base"), "kept": ~(failed("base") | failed(version))})


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """(rule, n_failed, n_alone): documents failing the rule, and those that the policy rejects for it alone.

    Documents are first counted by their masked bits, at most 2^rules rows whatever the input.
    """
    m = F.lit(mask(version)).cast("long")
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    some = counts.select("bits", "n", rules)
    return some.groupBy("r.rule").agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"))


def op6_quality_rules(spark, sf_dir):
    rows = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM w WHERE len(ws) >= 5
), win AS (
  SELECT doc_id, pos, ws[pos] || chr(0) || ws[pos + 1] || chr(0) || ws[pos + 2] || chr(0) || ws[pos + 3] || chr(0) || ws[pos + 4] AS g FROM p
), rep AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS q FROM rep) GROUP BY doc_id
), ln AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dl AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dl.n_lines, 0) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dl ON dl.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id
), b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""
