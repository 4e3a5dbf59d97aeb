"""Text functions, Column to Column, all inside the JVM.

Word classes are written out as [\\p{L}\\p{N}], since Java's \\w and \\b are ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

WORD = r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def without_stage_directions(text) -> Column:
    """TX3: bracketed stage directions become a space."""
    return F.regexp_replace(_col(text), rf"(?i)[\[(][^\])]*(?:{L.STAGE_WORDS})[^\])]*[\])]", " ")


def tokens(text) -> Column:
    """TX2: lower-cased Unicode words; inner apostrophes and hyphens belong to them."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)), lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


def is_filler(text) -> Column:
    """PF1: blank, or nothing but filler tokens."""
    t = F.filter(F.split(_col(text), r"[\s,.;!?…'\"()\-]+"), lambda x: x != "")
    return (F.regexp_replace(_col(text), r"\s+", "") == "") | ((F.size(t) > 0) & F.forall(t, lambda x: x.rlike(rf"(?i)^(?:{L.FILLER})$")))


def is_unclear(text) -> Column:
    """PF2: no word character beside [unclear] tags."""
    return ~F.regexp_replace(_col(text), r"(?i)\[unclear\]", "").rlike(r"[\p{L}\p{N}_]")


def is_backchannel(text) -> Column:
    """PF3: an interviewer turn that asks nothing."""
    t = tokens(without_stage_directions(text))
    joined = F.array_join(t, " ")
    return (joined == "") | joined.isin(*L.BACKCHANNEL_PHRASES) | ((F.size(t) <= 4) & F.forall(t, lambda x: x.isin(*L.BACKCHANNEL_TOKENS)))


def weak_reason(clear) -> Column:
    """PF4: why a response of these clear tokens is no evidence; null if it is."""
    t = _col(clear)
    joined = F.array_join(t, " ")
    empty = joined.isin(*L.ACKNOWLEDGEMENT_PHRASES, *L.NO_INFORMATION_PHRASES) | joined.rlike(L.NO_INFORMATION) | F.forall(t, lambda x: x.isin(*L.ACKNOWLEDGEMENT_TOKENS))
    return F.when(F.size(t) == 0, "no_clear_evidence").when(empty, "acknowledgement_or_no_information")


def is_echo(clear, question) -> Column:
    """PF5: up to ten clear tokens, whose content the question holds already."""
    t = _col(clear)
    content = F.filter(t, lambda x: ~x.isin(*L.ECHO_TOKENS))
    return (F.size(t) <= 10) & (F.size(content) > 0) & (F.size(F.array_except(content, _col(question))) == 0)


def is_claim(clear) -> Column:
    """PF6: three to five tokens with a finite verb, after a pronoun or from the third token on."""
    t = _col(clear)
    finite = lambda x: x.isin(*L.FINITE_VERBS) | x.endswith("ed") | F.contains(x, F.lit("n't")) | x.rlike(r"'(?:m|re|s|ve|d|ll)$")
    rest = lambda k: F.exists(F.slice(t, F.lit(k), F.greatest(F.size(t) - (k - 1), F.lit(0))), finite)
    return F.size(t).between(3, 5) & (rest(3) | (F.get(t, F.lit(0)).isin(*L.PRONOUNS) & rest(2)))


def is_cutoff(clear_text) -> Column:
    """PF7: the last clear words break off."""
    x = F.regexp_replace(_col(clear_text), r"\s+$", "")
    last = F.try_element_at(tokens(x), F.lit(-1))
    some = F.size(tokens(x)) > 0
    return some & F.coalesce(last.isin(*L.HARD_CUTOFF) | x.rlike(r"(?:—|–|--)$") | (x.rlike(r"(?:,|:|;|\.\.\.|…)$") & last.isin(*L.CONTINUATION)), F.lit(False))


def review_reasons(text, question, clear_text, n_clear, n_total, n_question, n_targets) -> Column:
    """PF9: the review reasons of a retained target, in fixed order."""
    t, q, x, n = _col(text), _col(question), F.regexp_replace(_col(clear_text), r"\s+$", ""), _col(n_clear)
    words = tokens(x)
    last = F.try_element_at(words, F.lit(-1))
    ratio = n / F.greatest(F.lit(1), _col(n_total))
    unclear_end = t.rlike(r"(?is)\[unclear(?::[^\]]*)?\]\s*[.!?]*\s*$")
    unfinished = (F.size(words) > 0) & ~x.endswith("?") & (last.isin(*L.HARD_CUTOFF) | x.rlike(r"(?:—|–|--)$") | ((unclear_end | x.rlike(r"(?:,|:|;|\.\.\.|…)$")) & last.isin(*L.CONTINUATION)))
    flags = {
        "very_short": n <= 10,
        "explicitly_unfinished": unfinished,
        "unclear_or_damaged": (ratio < 0.5) | ((ratio < 0.75) & (n < 20)) | ((_col(n_question) == 0) & (n < 30)),
        "interview_management": t.rlike(f"(?i)(?:{L.MANAGEMENT})") | ((n <= 25) & q.rlike(f"(?i)(?:{L.MANAGEMENT})")),
        "participant_question": (_col(n_targets) == 1) & (n <= 25) & F.regexp_replace(t, r"\s+$", "").endswith("?"),
        "bare_evaluation": (n <= 12) & ~_col(clear_text).rlike(r"\p{Nd}") & F.exists(tokens(clear_text), lambda w: w.isin(*L.EVALUATION)),
    }
    return F.array_compact(F.array(*[F.when(flags[r], r) for r in L.REVIEW_REASONS]))


def normalized_turn(text) -> Column:
    """TX1: struct(text, paired, isolated): collapsed lines, ??words?? as [unclear: words], other runs of ? as [unclear]."""
    unix = F.replace(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(unix, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " "))), lambda x: x != "")
    pair = r"(?<![\p{L}\p{N}_])\?{2,}\s*(\S(?:.*?\S)?)\s*\?{2,}(?![\p{L}\p{N}_])"
    joined = F.array_join(lines, "\n")
    paired = F.regexp_replace(joined, pair, "[unclear: $1]")
    text_out = F.array_join(F.transform(F.split(F.regexp_replace(paired, r"\?{2,}", "[unclear]"), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return F.struct(text_out.alias("text"), F.regexp_count(joined, F.lit(pair)).alias("paired"), F.regexp_count(paired, F.lit(r"\?{2,}")).alias("isolated"))


def identifier(x) -> Column:
    """TX7: runs of other characters become one underscore, none at the ends; case stays."""
    return F.regexp_replace(F.regexp_replace(_col(x), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def slug(x) -> Column:
    """TX8: ASCII slug in lower case; nothing left is unnamed_code."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(_col(x), "[^a-zA-Z0-9]+", "_")), "^_+", ""), "_+$", "")
    return F.when(s == "", "unnamed_code").otherwise(s)


def without_role(x, role: str) -> Column:
    """TX9: a leading role name goes, with the blanks and colons after it."""
    return F.trim(F.regexp_replace(_col(x), f"^{role}[ : ]*", ""))


def code_label(x) -> Column:
    """TX10: underscores are spaces, white space is single."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(x), "_+", " "), r"\s+", " "))


# fixed values: letters that fold to several or to others, beyond their lower case
FOLDS = (("ß", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ς", "σ"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("և", "եւ"), ("ẞ", "ss"))


def casefold(x) -> Column:
    """Lower case with the letters of FOLDS folded."""
    return reduce(lambda t, f: F.replace(t, F.lit(f[0]), F.lit(f[1])), FOLDS, F.lower(_col(x)))


def separator_insensitive(x) -> Column:
    """TX11: for comparing labels."""
    return casefold(F.regexp_replace(_col(x), r"[\s_]+", ""))


def is_collapsed(x) -> Column:
    """TX12: a long text that lost its spaces."""
    return (F.length(_col(x)) >= 24) & ~_col(x).rlike(r"\s") & (F.regexp_count(_col(x), F.lit("[A-Za-z]")) >= 20)


# fixed values: markers that tokenizers leave in decoded text, and what they stand for
DECODE_MARKERS = (("\u010a", "\n"), ("\u0120", " "), ("\u0109", "\t"), ("\u00c4\u0160", "\n"), ("\u00c4\u00a0", " "), ("\u00c4\u2030", "\t"))


def decoded(x, markers=DECODE_MARKERS) -> Column:
    """TX15: struct(text, replaced, before, after): markers replaced, their count, the hashes around."""
    text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), markers, _col(x))
    count = reduce(lambda a, b: a + b, [F.regexp_count(_col(x), F.lit(m)) for m, _ in markers])
    return F.struct(text.alias("text"), count.alias("replaced"), F.sha2(_col(x), 256).alias("before"), F.sha2(text, 256).alias("after"))


def think_sections(x) -> Column:
    """TX19: struct(status, reasoning, answer) around the first think block."""
    t = _col(x)
    a = F.instr(t, "<think>")
    body = F.substr(t, a + 7)
    b = F.instr(body, "</think>")
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    status = F.when(a == 0, "no_think_block").when(b == 0, "missing_close_think_tag").otherwise("found_closed_think_block")
    reasoning = F.when(a == 0, "").when(b == 0, body).otherwise(F.substr(body, F.lit(1), b - 1))
    answer = F.when(a == 0, t).when(b == 0, "").otherwise(F.substr(body, b + 8))
    return F.struct(status.alias("status"), strip(reasoning).alias("reasoning"), strip(answer).alias("answer"))


def readable(x) -> Column:
    """TX16: some_field as Some field."""
    s = F.replace(_col(x), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def message_value(messages_text, label: str) -> Column:
    """TX20: the value after the first `Label:` line."""
    return F.trim(F.regexp_extract(_col(messages_text), rf"(?m)^\Q{label}\E:(.*)$", 1))


def last_message_value(messages, label: str) -> Column:
    """TX20: message_value of the last message's content."""
    return message_value(F.element_at(_col(messages), -1)["content"], label)


def line_number(text, offset) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substr(_col(text), F.lit(1), _col(offset))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def canonical_sha256(**fields) -> Column:
    """H1: sha256 of the JSON object with sorted keys and no spaces, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[_col(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def joined_sha256(*parts) -> Column:
    """H3, H4: sha256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[_col(p).cast("string") for p in parts]), 256)


def template(pattern: str, /, **values) -> Column:
    """SC19: a template's {names} as columns; unknown names stay as they stand, doubled braces are braces."""
    import re

    out = []
    for piece in re.split(r"(\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\})", pattern):
        if piece in ("{{", "}}"):
            out.append(F.lit(piece[0]))
        elif piece.startswith("{") and piece[1:-1] in values:
            out.append(F.coalesce(_col(values[piece[1:-1]]).cast("string"), F.lit("")))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out) if out else F.lit("")
