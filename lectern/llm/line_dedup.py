"""Line dedup: lines that many sites share are boilerplate and go, from every document.

A line's spread is the number of distinct sites it stands on. Every line hash gets a
HyperLogLog sketch of its sites; partial sketches merge map-side and by aggregation,
so a line on a third of all rows costs one sketch per task. Estimates far from the
threshold decide alone; lines within `band` of it are counted exactly first.

Exact copies of a text are one text, on the least of their sites: copies as a whole, wherever
they stand, make none of their lines boilerplate, and are left to the document-level stages.

Defined results: lines are split at newlines and compared without outer blanks; blank
lines are never boilerplate; a null text has no lines and stays null; a null site adds
nothing to a spread; rows, ids and all other columns stay, repeated rows too; n_lines and
n_removed replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, others, own, small_side, table, wide_key

MIN_SITES = 10
BAND = 0.25
LG_K = 12  # relative error 1.6 %: the band is over 15 of these


def _lines(docs: DataFrame, text_col: str):
    return F.split(F.col(text_col), "\n")


def _hash(line):
    return F.xxhash64(F.trim(line))


def _on_sites(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(site, hashes): the distinct lines of each text that aren't blank, exact copies of a text all on their least site."""
    site = F.col(site_col).cast("string").alias("site")
    hashes = F.array_distinct(F.transform(F.filter(_lines(docs, text_col), lambda x: F.trim(x) != ""), _hash)).alias("hashes")
    name = (F.xxhash64(text_col).alias("h"), F.hash(F.lit(1), F.col(text_col)).alias("g"))
    copies = docs.where(F.col(text_col).isNotNull()).select(site, *name).groupBy("h", "g").agg(F.min("site").alias("least"), F.count("*").alias("n"))
    copies = cut(copies.where("n > 1").drop("n"))
    return docs.select(site, hashes, *name).join(small_side(copies), ["h", "g"], "left").select(F.coalesce("least", "site").alias("site"), "hashes")


def line_spread(docs: DataFrame, text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """(line_hash, sketch, spread): one row per distinct line that isn't blank."""
    return _spread(_on_sites(docs, text_col, site_col), lg_k)


def _spread(rows: DataFrame, lg_k: int) -> DataFrame:
    lines = rows.select("site", F.explode("hashes").alias("line_hash"))
    sketches = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    return sketches.withColumn("spread", F.hll_sketch_estimate("sketch"))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(line_hash) of the lines on min_sites sites or more."""
    rows = _on_sites(docs, text_col, site_col)
    wide = cut(_spread(rows, LG_K).where(F.col("spread") >= min_sites * (1 - band)).select("line_hash", "spread"))
    sure = wide.where(F.col("spread") > min_sites * (1 + band)).select("line_hash")
    near = wide.where(F.col("spread") <= min_sites * (1 + band)).select("line_hash")
    pairs = rows.select("site", F.explode("hashes").alias("line_hash"))
    exact = pairs.join(small_side(near), "line_hash", "left_semi").where("site is not null").distinct().groupBy("line_hash").agg(F.count("*").alias("sites"))
    return cut(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line_hash")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and the columns n_lines and n_removed."""
    spread = small_side(boilerplate(docs, text_col, site_col, min_sites))
    key, hits, kept = own("key"), own("hits"), own("kept")
    rows = docs.select(*others(docs, "n_lines", "n_removed"), wide_key(docs, id_col, text_col).alias(key))
    found = rows.select(key, F.explode(F.transform(_lines(docs, text_col), _hash)).alias("line_hash")).join(spread, "line_hash", "left_semi")
    found = small_side(cut(found.groupBy(key).agg(F.collect_set("line_hash").alias(hits))))
    lines = _lines(docs, text_col)
    out = rows.join(found, key, "left").withColumn(kept, F.when(F.col(hits).isNotNull(), F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(hits), _hash(x)))).otherwise(lines))
    n, missing = F.coalesce(F.size(lines), F.lit(0)), F.col(text_col).isNull()
    return out.withColumns(
        {
            "n_lines": F.when(missing, 0).otherwise(n).cast("long"),
            "n_removed": F.when(missing, 0).otherwise(n - F.size(kept)).cast("long"),
            own("text"): F.array_join(kept, "\n"),
        }
    ).withColumn(text_col, F.col(own("text"))).drop(key, hits, kept, own("text"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """line_dedup with the columns of docs alone, n_chars being that of the new text."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, text, arr[pos] AS line, pos
  FROM (SELECT doc_id, source, text, arr, unnest(range(1, len(arr) + 1)) AS pos
        FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS arr FROM documents))
), u AS (
  SELECT min(source) AS source, unnest(string_split(text, chr(10))) AS line FROM documents GROUP BY text
), spread AS (
  SELECT trim(line) AS t FROM u WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.text, l.line, l.pos, s.t IS NOT NULL AS gone FROM l LEFT JOIN spread s ON trim(l.line) = s.t
), d AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id, text
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_gone AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256
FROM d
"""
