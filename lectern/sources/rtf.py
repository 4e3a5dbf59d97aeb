"""RTF transcripts: text, speaker turns, cover sheets, file lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L

_TOKEN = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
# fixed values: destinations whose text is no document text; control words that are characters
DESTINATIONS = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr footnote object themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl".split())
CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "\t", "row": "\n"}


def rtf_text(data: bytes) -> str:
    """SC5: the document text of an RTF file in cp1252; bytes that cp1252 lacks are an error."""
    out, stack, skip, uc, ignore = [], [], False, 1, 0
    for m in _TOKEN.finditer(data.decode("cp1252")):
        hexa, uni, word, arg, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, uc))
        elif brace == "}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif hexa:
            if ignore:
                ignore -= 1
            elif not skip:
                out.append(bytes.fromhex(hexa).decode("cp1252"))
        elif uni:
            if not skip:
                out.append(chr(int(uni) % 65536))
            ignore = uc
        elif word:
            if word in DESTINATIONS:
                skip = True
            elif word == "uc":
                uc = int(arg or 1)
            elif word in CHARACTERS and not skip:
                out.append(CHARACTERS[word])
        elif symbol:
            if symbol == "*":
                skip = True
            elif not skip:
                out.append({"~": " ", "-": "", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else "\n" if symbol in "\r\n" else ""))
        elif plain:
            plain = plain.replace("\r", "").replace("\n", "")
            if ignore and plain:
                plain, ignore = plain[ignore:], max(0, ignore - len(plain))
            if not skip:
                out.append(plain)
    return "".join(out)


@F.pandas_udf(T.StringType())
def rtf_text_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda b: rtf_text(bytes(b)))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(interview_id, text, sha256) of every *.rtf file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rtf").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.rtf$", 1)
    return files.select(name.alias("interview_id"), rtf_text_udf("content").alias("text"), F.sha2("content", 256).alias("sha256"))


def speaker_turns(transcripts: DataFrame) -> DataFrame:
    """A turn is the text from a speaker label to the next; labels carry role, canonical label and eligibility.

    Splitting in front of each label keeps it native: (interview_id, turn_index, raw_speaker_label, role, speaker_label, target_eligible, raw_text).
    """
    labels = "|".join(sorted(L.SPEAKERS, key=len, reverse=True))
    at = rf"(?im)^(?=[ \t]*\*?(?:{labels})[ \t]*[:;][ \t]*)"
    head = rf"(?is)^[ \t]*\*?({labels})[ \t]*[:;][ \t]*(.*)$"
    rows = transcripts.select("interview_id", F.posexplode(F.filter(F.split("text", at), lambda x: x.rlike(head))).alias("pos", "piece"))
    raw = F.upper(F.regexp_extract("piece", head, 1))
    known = F.create_map(*[x for k, v in L.SPEAKERS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("role"), F.lit(v[1]).alias("label"), F.lit(v[2]).alias("eligible")))])
    got = rows.select("interview_id", (F.col("pos") + 1).alias("turn_index"), raw.alias("raw_speaker_label"), known[raw].alias("s"), F.trim(F.regexp_extract("piece", head, 2)).alias("raw_text"))
    return got.select("interview_id", "turn_index", "raw_speaker_label", F.col("s.role").alias("role"), F.col("s.label").alias("speaker_label"), F.col("s.eligible").alias("target_eligible"), F.regexp_replace("raw_text", r"\s+$", "").alias("raw_text"))


def documented_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """SC6: transcript names in a file list."""
    return lines.select(F.lower(F.regexp_extract(column, r"(?i)^\s*(int\d+t)\s*\|\s*interview transcript", 1)).alias("name")).where("name <> ''").distinct()


def cover_sheet(text: str) -> dict[str, str]:
    """SC7: key fields above the first speaker: pseudonym line, household line, occupations, children."""
    found: dict[str, str] = {}
    lines = [x.strip() for x in re.split(r"(?im)^[ \t]*\*?(?:Q|I|IV|MALE|FEMALE|M|F)[ \t]*[:;]", text, maxsplit=1)[0].split("\n")]

    def cells(line):
        sep = "|" if "|" in line else "\t" if "\t" in line else None
        return [c.strip() for c in (line.split(sep) if sep else re.split(r" {2,}", line)) if c.strip()]

    for i, line in enumerate(lines):
        after = next((x for x in lines[i + 1 :] if x), "")
        if line.lower().startswith("pseudonym"):
            found |= dict(zip(("pseudonym", "age", "gender", "location"), cells(after)))
        elif line.lower().startswith("household structure"):
            found |= dict(zip(("household_structure", "tenure", "income"), cells(after)))
            jobs = [x for x in lines[i + 1 : i + 5] if x.lower().startswith("*occupation") or "occupation" in x.lower()][:2]
            found |= {f"occupation_{k}": x.partition(":")[2].strip() or x for k, x in enumerate(jobs, 1)}
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def cover_sheet_udf(text: pd.Series) -> pd.Series:
    return text.map(cover_sheet)
