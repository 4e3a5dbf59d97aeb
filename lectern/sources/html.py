"""HTML interviews: sections, turns and characteristics, by the standard parser inside Arrow-batched functions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(number: str, *strings: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(number, T.IntegerType()), *[T.StructField(s, T.StringType()) for s in strings]]))


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Elements as [tag, classes, parent, children]; a p closes an open p."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", (), None, []]
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            n = self.at
            while n is not None and n[0] != "p":
                n = n[2]
            if n is not None:
                self.at = n[2]
        node = [tag, tuple((dict(attrs).get("class") or "").split()), self.at, []]
        self.at[3].append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n[0] != tag:
            n = n[2]
        if n is not None and n[2] is not None:
            self.at = n[2]

    def handle_data(self, data):
        self.at[3].append(data)


def tree(html: str):
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def walk(node):
    for x in node[3]:
        if isinstance(x, list):
            yield x
            yield from walk(x)


def text_of(node) -> str:
    """The stripped text pieces below a node, joined by a space."""
    out = []

    def pieces(n):
        if n[0] in ("script", "style"):
            return
        for x in n[3]:
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            else:
                pieces(x)

    pieces(node)
    return " ".join(out)


def matches(node, selector: str) -> bool:
    """tag or tag.class"""
    tag, _, cls = selector.partition(".")
    return node[0] == tag and (not cls or cls in node[1])


def paragraphs(html: str) -> list[tuple[int, str, str]]:
    """SC3: every p in document order: (index from 1, classes, text)."""
    return [(i, " ".join(n[1]), text_of(n)) for i, n in enumerate((n for n in walk(tree(html)) if n[0] == "p"), 1)]


def sections(html: str, heading: str) -> list[tuple[int, str, str]]:
    """SC2: (index, label, text) at every heading with its following siblings, up to the next of its tag; no heading is one section."""
    root = tree(html)
    heads = [n for n in walk(root) if matches(n, heading)]
    if not heads:
        return [(1, "", text_of(root))]
    out = []
    for i, h in enumerate(heads, 1):
        siblings = h[2][3]
        at = next(k for k, x in enumerate(siblings) if x is h)
        parts = [text_of(h)]
        for x in siblings[at + 1 :]:
            if isinstance(x, list):
                if x[0] == h[0]:
                    break
                parts.append(text_of(x))
            elif x.strip():
                parts.append(x.strip())
        out.append((i, text_of(h), " ".join(p for p in parts if p)))
    return out


def characteristics(html: str) -> dict[str, str]:
    """SC4: pairs of the first table's cells; rows of two cells are a pair, longer rows pairs of cells; later keys win."""
    first = next((n for n in walk(tree(html)) if n[0] == "table"), None)
    out: dict[str, str] = {}
    for row in walk(first) if first else ():
        if row[0] == "tr":
            cells = [c for n in walk(row) if n[0] in ("td", "th") and (c := text_of(n))]
            if len(cells) >= 2:
                out |= dict(zip(cells[::2], cells[1::2]))
    return out


@F.pandas_udf(_rows("paragraph_index", "classes", "text"))
def paragraphs_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda x: [{"paragraph_index": i, "classes": c, "text": t} for i, c, t in paragraphs(x)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def characteristics_udf(html: pd.Series) -> pd.Series:
    return html.map(characteristics)


def sections_udf(heading: str):
    @F.pandas_udf(_rows("idx", "label", "text"))
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: [{"idx": i, "label": a, "text": t} for i, a, t in sections(x, heading)])

    return run


def read_interviews(spark: SparkSession, path: str, heading: str | None = None) -> DataFrame:
    """SC1: one row per *.html or *.htm file below the path, or of the one file: (interview_id, html, file), in the order of file names on `file`. With a heading selector a file holds many interviews, one a section. No file is an error."""
    files = spark.read.option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = files.select(F.regexp_replace(name, r"\.html?$", "").alias("interview_id"), F.col("value").alias("html"), name.alias("file"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no .html or .htm file in {path}")
    if heading is None:
        return rows
    parts = rows.select("interview_id", "file", F.explode(interview_sections(heading)("html")).alias("s"))
    return parts.select(F.concat_ws("_", "interview_id", F.lpad(F.col("s.idx").cast("string"), 3, "0")).alias("interview_id"), F.col("s.html").alias("html"), "file")


def split_interviews(html: str, heading: str) -> list[tuple[int, str]]:
    """SC2: (number from 1, html) of each section: a heading that matches `tag` or `tag.class` with what follows up to the next, the document's head in front of each; without a heading the whole document."""
    tag, _, cls = heading.partition(".")
    opening = re.compile(rf"<{tag}\b([^>]*)>", re.I)
    starts = [m.start() for m in opening.finditer(html) if not cls or cls in (re.search(r"class\s*=\s*[\"']?([^\"'>]*)", m[1], re.I) or ["", ""])[1].split()]
    if not starts:
        return [(1, html)]
    head = re.search(r"<head\b.*?</head>", html, re.S | re.I)
    end = re.search(r"</body>", html, re.I)
    stop = end.start() if end else len(html)
    return [(i, f"<html>{head[0] if head else ''}<body>{html[a:b]}</body></html>") for i, (a, b) in enumerate(zip(starts, [*starts[1:], stop]), 1)]


def interview_sections(heading: str):
    @F.pandas_udf("array<struct<idx:int,html:string>>")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: [{"idx": i, "html": t} for i, t in split_interviews(x, heading)])

    return run


def turns(interviews: DataFrame, interviewer: str, participant: str) -> DataFrame:
    """SC3: (interview_id, turn_index, paragraph_index, role, text) of the paragraphs that match a selector, the interviewer's first."""
    from pyspark.sql import Window

    from ..functions.text import without_role

    def is_(sel):
        cls = sel.partition(".")[2]
        return F.array_contains(F.split("p.classes", " "), cls) if cls else F.lit(True)

    rows = interviews.select("interview_id", F.explode(paragraphs_udf("html")).alias("p"))
    role = F.when(is_(interviewer), "interviewer").when(is_(participant), "participant")
    rows = rows.select("interview_id", F.col("p.paragraph_index").alias("paragraph_index"), role.alias("role"), F.col("p.text").alias("text")).where("role is not null")
    text = F.when(F.col("role") == "interviewer", without_role("text", "Interviewer")).otherwise(without_role("text", "Participant"))
    return rows.withColumn("text", text).withColumn("turn_index", F.row_number().over(Window.partitionBy("interview_id").orderBy("paragraph_index")))
