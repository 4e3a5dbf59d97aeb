"""JSONL, CSV, XLSX, JSON readers and the sinks."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl_lines(spark: SparkSession, path) -> DataFrame:
    """SC11: (file, line, raw) of the lines that aren't blank; lines count from 1 per file.

    Files are read in splits, and the lines of a split go on from the counts of the splits before it.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    place = F.row_number().over(Window.partitionBy("path", "start").orderBy("id"))
    return rows.withColumn("place", place).join(counts, ["path", "start"]).select("file", (F.col("before") + F.col("place")).cast("int").alias("line"), "raw").where(F.trim("raw") != "")


def segment_files(spark: SparkSession, path: str) -> list[str]:
    """SC10: one .jsonl file, else the folder's *_segments.jsonl, else its *.jsonl, by name; none is an error."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = jvm.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        raise FileNotFoundError(f"no such path: {path}")
    if fs.getFileStatus(at).isFile():
        if not path.lower().endswith(".jsonl"):
            raise ValueError(f"not a .jsonl file: {path}")
        return [path]
    names = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile())
    found = [n for n in names if n.endswith("_segments.jsonl")] or [n for n in names if n.endswith(".jsonl")]
    if not found:
        raise FileNotFoundError(f"no segment files in {path}")
    return found


def _whole(spark: SparkSession, path: str) -> str:
    """The text of one small file of any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_json_object(spark: SparkSession, path: str, what: str) -> dict:
    """SC16: a file that holds one JSON object; else an error that names the path."""
    try:
        value = json.loads(_whole(spark, path))
    except Exception as e:
        raise ValueError(f"{what} at {path} is not readable JSON: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"{what} at {path} is not a JSON object")
    return value


def load_codebook(spark: SparkSession, path: str) -> dict:
    """SC9: a codebook: a JSON object with a list `codes`."""
    book = read_json_object(spark, path, "codebook")
    if not isinstance(book.get("codes"), list):
        raise ValueError(f"codebook at {path} lacks a list of codes")
    return book


def read_snapshot(spark: SparkSession, path: str, metadata: dict) -> DataFrame:
    """SC18: a gzipped JSONL snapshot of exactly three strings a row, checked against {rows, sha256} before use."""
    raw = spark.read.format("binaryFile").load(path)
    found = raw.select(F.sha2("content", 256).alias("h")).first().h
    if found != metadata["sha256"]:
        raise ValueError(f"snapshot at {path} has another checksum: {found}")
    names = ("prompt", "chosen", "rejected")
    lines = spark.read.text(path)
    m = F.from_json("value", "map<string,string>")
    bad = lines.select(m.alias("m")).where(F.col("m").isNull() | (F.array_sort(F.map_keys("m")) != F.array(*map(F.lit, sorted(names)))) | F.exists(F.map_values("m"), lambda v: v.isNull())).count()
    n = lines.count()
    if bad or n != metadata["rows"]:
        raise ValueError(f"snapshot at {path}: {n} rows of {metadata['rows']}, {bad} with other keys")
    return lines.select(m.alias("m")).select(*[F.col("m")[c].alias(c) for c in names])


def check_columns(df: DataFrame, expected: list[str], path: str) -> DataFrame:
    """SC15: df, if it has exactly these columns."""
    if set(df.columns) != set(expected):
        raise ValueError(f"{path} has other columns: {sorted(set(df.columns) ^ set(expected))}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, fail_fast: bool = True) -> DataFrame:
    """SC13: fail-fast, or with bad lines kept in _corrupt_record to be counted."""
    if fail_fast:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def segment_errors(lines: DataFrame, required: list[str]) -> DataFrame:
    """SC11: (file, line, error) of lines that are no JSON object, lack a required field or have one that is no string."""
    names = F.json_object_keys("raw")
    missing = F.array_except(F.array(*map(F.lit, required)), names)
    typed = [F.when(F.array_contains(names, c) & ~F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json("raw"), f"$.{c}", "variant")) == "STRING", F.lit(False)), F.lit(f"{c} is no string")) for c in required]
    error = F.when(names.isNull(), "no JSON object").when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", "))).otherwise(F.array_join(F.array_compact(F.array(*typed)), "; "))
    return lines.select("file", "line", error.alias("error")).where("error <> ''")


def segment_records(lines: DataFrame, required: list[str]) -> DataFrame:
    """SC11: participant segments: required fields as columns, the other keys as a variant map of JSON strings."""
    m = F.from_json("raw", "map<string,string>")
    rows = lines.withColumn("m", m)
    rest = F.map_filter("m", lambda k, v: ~k.isin(*required))
    rows = rows.where(F.col("m")["speaker"] == "participant")
    return rows.select("file", "line", *[F.col("m")[c].alias(c) for c in required], rest.alias("metadata"))


def exclusion_errors(lines: DataFrame) -> DataFrame:
    """SC12: lines that are not exactly {record_id, text} with both non-blank, or repeat an id."""
    m = F.from_json("raw", "map<string,string>")
    rows = lines.withColumn("m", m).withColumn("record_id", F.col("m")["record_id"])
    bad = ~F.coalesce(F.array_sort(F.map_keys("m")) == F.array(F.lit("record_id"), F.lit("text")), F.lit(False)) | (F.coalesce(F.trim("record_id"), F.lit("")) == "") | (F.coalesce(F.trim(F.col("m")["text"]), F.lit("")) == "")
    again = F.count("*").over(Window.partitionBy("record_id")) > 1
    return rows.withColumn("error", F.when(bad, "not exactly a record_id and a text").when(again, "record_id repeats")).where("error is not null").select("file", "line", "error")


def file_sha256(spark: SparkSession, path: str) -> str:
    """SC12: sha256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC15: headed CSV, BOM accepted; blank numbers are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "").csv(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """SC17: every JSON file below the path, by path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def trace_inventory(traces: DataFrame, record_count: int) -> dict[str, int]:
    """SC17: how many traces there are and how many records have none yet; more traces than records is an error."""
    n = traces.count()
    if n > record_count:
        raise ValueError(f"{n} traces of {record_count} records")
    return {"traces": n, "missing": record_count - n}


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def xlsx_rows(path: str) -> list[tuple[str, int, list[str | None]]]:
    """SC8: (sheet, row, values) of a workbook, values only."""
    out = []
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]
        for i, name in enumerate(names, 1):
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{_NS['m']}}}row"):
                values: dict[int, str | None] = {}
                for k, c in enumerate(row.findall("m:c", _NS)):
                    ref = "".join(x for x in (c.get("r") or "") if x.isalpha())
                    col = (sum((ord(x) - 64) * 26**j for j, x in enumerate(reversed(ref))) - 1) if ref else k
                    v = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (shared[int(v.text)] if c.get("t") == "s" else v.text) if v is not None else None
                    values[col] = text.strip() or None if text else None
                out.append((name, int(row.get("r") or len(out) + 1), [values.get(k) for k in range(max(values, default=-1) + 1)]))
    return out


def codebook_quotes(spark: SparkSession, path: str) -> DataFrame:
    """SC8: (sheet, row, code_label, quote, question): sheets routed by their header; codes or quotes filled down blank cells."""
    parts = {"code": [], "quote": []}
    header: dict[str, list[str]] = {}
    for sheet, row, values in xlsx_rows(path):
        if sheet not in header:
            header[sheet] = ["_".join((v or "").lower().split()) for v in values]
            continue
        got = dict(zip(header[sheet], values))
        if {"code", "quotes", "example_questions"} <= set(header[sheet]):
            parts["code"].append((sheet, row, got.get("code"), got.get("quotes"), got.get("example_questions")))
        elif {"quote", "codes"} <= set(header[sheet]):
            parts["quote"].append((sheet, row, got.get("codes"), got.get("quote"), None))
    schema = "sheet string, row int, code_label string, quote string, question string"
    w = Window.partitionBy("sheet").orderBy("row")
    first = spark.createDataFrame(parts["code"], schema).withColumn("code_label", F.last("code_label", True).over(w))
    second = spark.createDataFrame(parts["quote"], schema).withColumn("quote", F.last("quote", True).over(w))
    return first.unionByName(second).where("code_label is not null")


def codebook(quotes: DataFrame) -> DataFrame:
    """Codes by slug: the first label, and quotes, questions and sheets once each, in order."""
    from ..functions.text import slug

    o = F.struct("sheet", "row")
    rows = quotes.withColumn("code_id", slug("code_label"))

    def ordered(c):
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]))

    return rows.groupBy("code_id").agg(F.min_by("code_label", o).alias("code_label"), ordered("quote").alias("example_quotes"), ordered("question").alias("example_reflective_questions"), ordered("sheet").alias("source_sheets"))


# -- sinks


def write_jsonl(df: DataFrame, path: str, compress: bool = False, overwrite: bool = False) -> None:
    """SK1, SK7: compact JSON lines; an existing path is an error unless overwrite (SK9)."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False)
    (w.option("compression", "gzip") if compress else w).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """SK2."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_csv_rows(rows: list[dict], columns: list[str], path: str) -> None:
    """SK2: a small report from the driver, one file; without rows the header alone."""
    import csv

    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.DictWriter(f, columns)
        w.writeheader()
        w.writerows(rows)


def write_snapshot(spark: SparkSession, df: DataFrame, path: str) -> dict:
    """SK7: one gzipped JSONL part with {rows, bytes, sha256}. A snapshot is one file by contract, so its rows pass through one task."""
    write_jsonl(df.coalesce(1), path, compress=True)
    part = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path).select("path", "length", F.sha2("content", 256).alias("h")).first()
    return {"path": part.path, "rows": spark.read.text(path).count(), "bytes": part.length, "sha256": part.h}


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """SK5: the partitions of df replace those of the table; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_by_content(payload: dict, folder: str) -> str:
    """SK10: a manifest named by its own hash; one that is there already must be the same."""
    import hashlib

    data = json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    path = os.path.join(folder, hashlib.sha256(data.encode()).hexdigest() + ".json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if json.load(f) != payload:
                raise ValueError(f"{path} holds something else")
    else:
        os.makedirs(folder, exist_ok=True)
        write_manifest(payload, path)
    return path


def run_folder(root: str, name: str) -> str:
    """SK9: a new folder for one run, by its time in UTC."""
    from datetime import datetime, timezone

    path = os.path.join(root, f"{name}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}")
    os.makedirs(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """SK4: events with their time first."""
    df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), *df.columns).write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", raw: str = "raw") -> None:
    """SK6: each raw line unchanged into its split's folder; the committer makes it all or nothing."""
    df.select(split, raw).write.partitionBy(split).text(path)


def write_all(outputs: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    """SK6: several outputs, all or none: each goes to a staging folder beside, and one rename puts them in place; a failure leaves a failed manifest."""
    import shutil

    if os.path.exists(folder):
        raise FileExistsError(folder)
    stage = f"{folder}.staging"
    shutil.rmtree(stage, ignore_errors=True)
    try:
        for name, df in outputs.items():
            write_jsonl(df, os.path.join(stage, name))
        write_manifest(manifest | {"status": "complete"}, os.path.join(stage, "manifest.json"))
        os.rename(stage, folder)
    except Exception as e:
        shutil.rmtree(stage, ignore_errors=True)
        write_manifest(manifest | {"status": "failed", "error": str(e)[:500]}, f"{folder}.failed.json")
        raise


def write_manifest(payload: dict, path: str) -> None:
    """SK3: driver-side JSON by a temporary sibling and a rename."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    os.replace(temp, path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """H5: (path, bytes, sha256) of every file below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def html_page(title, characteristics, turns):
    """SK8: a normalised interview page: characteristics as a table, a paragraph per turn. turns: array<struct<role,text,turn_index>>."""
    esc = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    rows = F.array_join(F.transform(F.map_entries(characteristics), lambda e: F.concat(F.lit("<tr><th>"), esc(e["key"]), F.lit("</th><td>"), esc(e["value"]), F.lit("</td></tr>"))), "")
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit('<p class="'), t["role"], F.lit('" data-turn-index="'), t["turn_index"].cast("string"), F.lit('">'), esc(t["text"]), F.lit("</p>"))), "\n")
    return F.concat(F.lit("<html><body><h1>"), esc(title), F.lit("</h1><table>"), rows, F.lit("</table>\n"), body, F.lit("</body></html>"))
