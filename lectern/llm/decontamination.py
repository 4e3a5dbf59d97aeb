"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

The corpus frequency of every benchmark term is counted, and each window of an item takes its
rarest terms as anchors. The postings (term, document, position) of the anchors are stored. A
posting less the anchor's place in its item names a diagonal (document, item text, offset), which
neighbouring windows share; the lists of a window's anchors, so adjusted, are intersected on it.
Only the windows that survive are compared word by word with the document. Terms outside the
anchors never leave the scan, and no text is shuffled.

Words: A-Z are lower-cased, words are runs of digits, a-z and bytes from 0x80 on. Anchors
are matched on fully lower-cased words, which finds all that the exact comparison keeps.

Defined results: null text has no words; an item without words has no window; a null
item_id contaminates under the empty string; repeated items and rows each count; an
empty benchmark leaves every document clean. The results name their own columns alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own, small_side, table, wide_key

SIZE = 10
ANCHORS = 2
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPLIT), "")


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def item_texts(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seq, w, items): each distinct word sequence once, with the items that have it."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(lowered(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    return w.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("seq", F.xxhash64(F.array_join("w", " ")))


def item_windows(seqs: DataFrame, size: int = SIZE) -> DataFrame:
    """(seq, i, phrase, len, items): the windows of each sequence, by their first word."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return seqs.select("seq", "items", "w", F.explode(starts).alias("i")).select("seq", "i", "items", F.slice("w", F.col("i") + 1, F.lit(size)).alias("w")).select("seq", "i", F.array_join("w", " ").alias("phrase"), F.size("w").alias("len"), "items")


def _anchors(docs: DataFrame, wins: DataFrame, text_col: str, anchors: int) -> DataFrame:
    """(seq, i, len, q, term): the places and terms of each window's anchors; windows with a term that the corpus lacks can't occur and have none."""
    terms = wins.select("seq", "i", "len", F.posexplode(F.split("phrase", " ")).alias("q", "term")).select("seq", "i", "len", (F.col("i") + F.col("q")).alias("q"), F.lower("term").alias("term"))
    vocabulary = small_side(cut(terms.select("term").distinct()))
    seen = docs.select(F.explode(words(F.lower(text_col))).alias("term"))
    counts = cut(seen.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("cf")))
    one = Window.partitionBy("seq", "i")
    cf = F.coalesce("cf", F.lit(0))
    ranked = terms.join(counts, "term", "left").withColumns({"rank": F.row_number().over(one.orderBy(cf, "q")), "least": F.min(cf).over(one)})
    return cut(ranked.where(f"rank <= {anchors} and least > 0").select("seq", "i", "len", "q", "term"))


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, key, pos): the stored postings of the terms (a column `term`); pos counts words from 0."""
    tokens = docs.select(wide_key(docs, id_col, text_col).alias("key"), F.posexplode(words(F.lower(text_col))).alias("pos", "term"))
    return cut(tokens.join(small_side(terms.select("term").distinct()), "term").select("term", "key", "pos"))


def phrase_starts(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, seq, i, len, start): windows all of whose anchors stand on one diagonal, and where these put their first word."""
    places = anchors.select("term", "seq", "q").distinct()
    lists = postings.join(small_side(places), "term").select("key", "seq", (F.col("pos") - F.col("q")).alias("diagonal"), "q")
    got = lists.groupBy("key", "seq", "diagonal").agg(F.collect_set("q").alias("got"))
    need = anchors.groupBy("seq", "i", "len").agg(F.collect_list("q").alias("need"))
    need = need.groupBy("seq").agg(F.min(F.size("need")).alias("least"), F.collect_list(F.struct("i", "len", "need")).alias("wins"))
    hit = got.join(small_side(cut(need)), "seq").where(F.size("got") >= F.col("least"))
    found = hit.select("key", "seq", "diagonal", F.explode(F.filter("wins", lambda x: F.size(F.array_except(x["need"], F.col("got"))) == 0)).alias("x"))
    return found.select("key", "seq", F.col("x.i").alias("i"), F.col("x.len").alias("len"), (F.col("diagonal") + F.col("x.i")).alias("start")).where("start >= 0")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, start): places where the rarest terms of a window stand together, the others each at most `slop` words off its place."""
    wins = cut(item_windows(item_texts(items, item_col)))
    anchors = _anchors(docs, wins, text_col, ANCHORS)
    one = Window.partitionBy("seq", "i")
    best = anchors.withColumns({"rank": F.row_number().over(one.orderBy("q")), "n": F.count("*").over(one)})
    lists = index(docs, anchors, id_col, text_col).join(small_side(cut(best)), "term").select("key", "seq", "i", "rank", "n", (F.col("pos") - F.col("q") + F.col("i")).alias("start")).where(f"start >= -{slop}")
    near = F.when(F.col("rank") == 1, F.array("start")).otherwise(F.sequence(F.col("start") - slop, F.col("start") + slop))
    bits = F.expr("bit_or(shiftleft(1, rank - 1))")
    found = lists.withColumn("start", F.explode(near)).groupBy("key", "seq", "i", "start").agg(bits.alias("bits"), F.first("n").alias("n")).where("bits = shiftleft(1, n) - 1")
    named = found.join(small_side(wins.select("seq", "i", "items")), ["seq", "i"])
    ids = docs.select(F.col(id_col), wide_key(docs, id_col, text_col).alias("key"))
    return named.select("key", "start", F.explode("items").alias("item")).distinct().join(ids, "key").select(id_col, "item", "start")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", size: int = SIZE) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated) and the row key, one row per document."""
    wins = cut(item_windows(item_texts(items, item_col), size))
    anchors = _anchors(docs, wins, text_col, ANCHORS)
    starts = phrase_starts(index(docs, anchors, id_col, text_col), anchors)
    places = cut(starts.groupBy("key").agg(F.collect_list(F.struct("seq", "i", "start", "len")).alias("places")))
    rows = docs.select(F.col(id_col), wide_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(small_side(places), "key", "left")
    # the words, bound once by a lambda: an expression would be evaluated again for each place
    phrase = lambda w, p: F.struct(p["seq"].alias("seq"), p["i"].alias("i"), p["start"].alias("a"), (p["start"] + p["len"]).alias("b"), lowered(F.array_join(F.slice(w, p["start"] + 1, p["len"]), " ")).alias("phrase"))
    read = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.transform("places", lambda p: phrase(w, p)).alias("found")))
    rows = rows.select(id_col, "key", F.element_at(read, 1).alias("read")).select(id_col, "key", F.col("read.n_words").alias("n_words"), F.col("read.found").alias("found"))
    rows = cut(rows)
    each = rows.where("found is not null").select("key", F.explode(F.array_distinct("found")).alias("f")).select("key", "f.*")
    exact = each.join(small_side(wins.select("seq", "i", "phrase", "items")), ["seq", "i", "phrase"]).select("key", "a", "b", "items")
    # words of a document that some window covers: each new span counts from the end of all before it
    before = F.max("b").over(Window.partitionBy("key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    spans = exact.groupBy("key", "a", "b").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0)))))
    hits = fresh.groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    out = rows.drop("found").join(small_side(cut(hits)), "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(id_col, "key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit, with their own columns."""
    me = own("key")
    dirty = decontaminate(docs, items).where("contaminated").select(F.col("key").alias(me)).distinct()
    return docs.withColumn(me, wide_key(docs, "doc_id", "text")).join(small_side(cut(dirty)), me, "left_anti").drop(me)


def op4_benchmark_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hit AS (
  SELECT doc_id, p, n, item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp, (SELECT DISTINCT n FROM iw) WHERE p + n - 1 <= len(w)) JOIN iw USING (n, g)
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
