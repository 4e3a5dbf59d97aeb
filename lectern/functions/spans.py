"""Scalar functions over nested or irregular text, as Arrow-batched pandas functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNCLEAR = re.compile(r"\[unclear\b", re.I)


def unclear_removed(text: str, keep_words: bool) -> str:
    """TX4: [unclear ...] spans, brackets nested, become a space; with keep_words, words after a colon stay. An open span runs to the end."""
    out, at = [], 0
    while m := _UNCLEAR.search(text, at):
        out.append(text[at : m.start()])
        depth, end = 0, None
        for b in re.finditer(r"[\[\]]", text[m.start() :]):
            depth += 1 if b[0] == "[" else -1
            if not depth:
                end = m.start() + b.start()
                break
        if end is None:
            return "".join([*out, " "])
        inside = text[m.end() : end].lstrip()
        out.append(unclear_removed(inside[1:], True) if keep_words and inside.startswith(":") else " ")
        at = end + 1
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def replace_unclear(text: pd.Series, keep_words: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unclear_removed(t, bool(k)) for t, k in zip(text, keep_words)], dtype=object)


# fixed values: sequences of UTF-8 read as cp1252, and their repairs
MOJIBAKE = (("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€\u009d", "”"), ("â€”", "—"), ("â€“", "–"), ("â€¦", "…"), ("Â ", " "), ("Â", ""))


def mojibake_repaired(text: str) -> str:
    """TX6: the cp1252 to UTF-8 round trip, or single repairs where that fails."""
    try:
        return text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        for bad, good in MOJIBAKE:
            text = text.replace(bad, good)
        return text


@F.pandas_udf(T.StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    return text.map(mojibake_repaired, na_action="ignore")


def whitespace_match(quote: str, source: str) -> str | None:
    """TX13: the source's own slice that equals the quote but for white space, if there is just one."""
    want = "".join(quote.split())
    at = [i for i, c in enumerate(source) if not c.isspace()]
    have = "".join(source[i] for i in at)
    if not want or have.count(want) == 0:
        return None
    first = have.find(want)
    if have.find(want, first + 1) != -1:
        return None
    found = source[at[first] : at[first + len(want) - 1] + 1]
    return found if found != quote else None


@F.pandas_udf(T.StringType())
def unique_source_match(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if q is None or s is None else whitespace_match(q, s) for q, s in zip(quote, source)], dtype=object)


def label_repaired(question: str, label: str, collapsed: str) -> str | None:
    """TX14: the one occurrence of a collapsed or underscored label replaced by the label, where the question has white space besides."""
    if question.count(collapsed) != 1 or label == collapsed:
        return None
    rest = question.replace(collapsed, "", 1)
    return question.replace(collapsed, label, 1) if any(c.isspace() for c in rest.strip()) else None


@F.pandas_udf(T.StringType())
def repair_label(question: pd.Series, label: pd.Series, collapsed: pd.Series) -> pd.Series:
    return pd.Series([None if None in (q, l, c) else label_repaired(q, l, c) for q, l, c in zip(question, label, collapsed)], dtype=object)
