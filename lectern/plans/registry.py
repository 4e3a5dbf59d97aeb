"""The registered queries of the engine's own operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonx, spans
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import attempts, contracts, generation, lineage, pairs, prompts, ranking, records, selection, turns
from ..sources import html
from .tables import candidates, conversation_turns, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# the testdata's texts without their stage directions, as tokens; shared by the oracles
_WORD = r"[\p{L}\p{N}]+(?:[’''\-][\p{L}\p{N}]+)*"
_BARE = r"regexp_replace({x}, '(?i)[\[(][^\])]*(?:" + L.STAGE_WORDS + r")[^\])]*[\])]', ' ', 'g')"
_TOK = "list_transform(regexp_extract_all({x}, '" + _WORD + "'), lambda t: replace(lower(t), '’', ''''))"


def _tok(x: str) -> str:
    return _TOK.replace("{x}", x)


def _bare(x: str) -> str:
    return _BARE.replace("{x}", x)


_TURNS = """turns AS (
  SELECT conv_id AS interview_id, turn + 1 AS turn_index, CASE role WHEN 'user' THEN 'interviewer' ELSE 'participant' END AS role,
         CASE WHEN role = 'user' THEN 'Interviewer' WHEN conv_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS speaker_label, text
  FROM conversations WHERE role IN ('user', 'assistant')
)"""
_FLAGS = f"""flags AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\s,.;!?…''"()\\-]+'), lambda t: t <> '') AS ft, {_tok(_bare('text'))} AS bt, {_tok('text')} AS tk FROM turns
), marked AS (
  SELECT *, (len(ft) = 0 AND trim(text) = '') OR (len(ft) > 0 AND len(list_filter(ft, lambda t: NOT regexp_full_match(t, '(?i)(?:{L.FILLER})'))) = 0) AS is_filler_only,
         NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS is_unclear_only,
         len(bt) = 0 OR array_to_string(bt, ' ') IN {_list(L.BACKCHANNEL_PHRASES)} OR (len(bt) <= 4 AND len(list_filter(bt, lambda t: NOT list_contains({_array(L.BACKCHANNEL_TOKENS)}, t))) = 0) AS is_backchannel
  FROM flags
)"""
_EXCHANGES = """asked AS (
  SELECT *, max(CASE WHEN role = 'interviewer' AND NOT is_unclear_only AND NOT is_backchannel THEN turn_index END) OVER (PARTITION BY interview_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING) AS q
  FROM marked WHERE NOT is_filler_only
), answers AS (
  SELECT *, dense_rank() OVER (PARTITION BY interview_id ORDER BY q) AS ordinal FROM asked WHERE role = 'participant' AND q IS NOT NULL
), numbered AS (
  SELECT *, max(ordinal) OVER (PARTITION BY interview_id) AS n_ex FROM answers
), ex AS (
  SELECT a.interview_id, a.turn_index, a.text, a.bt, a.speaker_label, a.q, t.text AS question, t.bt AS qt, a.ordinal,
         'SEG' || lpad(CAST(a.ordinal AS VARCHAR), CAST(greatest(3, length(CAST(n_ex AS VARCHAR))) AS INTEGER), '0') AS segment_id
  FROM numbered a JOIN marked t ON t.interview_id = a.interview_id AND t.turn_index = a.q
)"""
_WEAK = f"""CASE WHEN len(bt) = 0 THEN 'no_clear_evidence'
  WHEN array_to_string(bt, ' ') IN {_list((*L.ACKNOWLEDGEMENT_PHRASES, *L.NO_INFORMATION_PHRASES))} OR regexp_matches(array_to_string(bt, ' '), '{L.NO_INFORMATION.replace("'", "''")}')
    OR len(list_filter(bt, lambda t: NOT list_contains({_array(L.ACKNOWLEDGEMENT_TOKENS)}, t))) = 0 THEN 'acknowledgement_or_no_information' END"""
_FINITE = f"list_contains({_array(L.FINITE_VERBS)}, t) OR suffix(t, 'ed') OR contains(t, 'n''t') OR regexp_matches(t, '''(?:m|re|s|ve|d|ll)$')"
_CLAIM = f"(len(bt) BETWEEN 3 AND 5 AND (len(list_filter(bt[3:], lambda t: {_FINITE})) > 0 OR (list_contains({_array(L.PRONOUNS)}, bt[1]) AND len(list_filter(bt[2:], lambda t: {_FINITE})) > 0)))"
_CUT = f"(len(bt) > 0 AND (list_contains({_array(L.HARD_CUTOFF)}, bt[-1]) OR regexp_matches(rtrim(x), '(?:—|–|--)$') OR (regexp_matches(rtrim(x), '(?:,|:|;|\\.\\.\\.|…)$') AND list_contains({_array(L.CONTINUATION)}, bt[-1]))))"
_AUDIT = f"""resp AS (
  SELECT *, {_WEAK} AS weak, {_CLAIM} AS claim, {_CUT} AS cut FROM (SELECT *, {_bare('text')} AS x FROM ex)
), grp AS (
  SELECT interview_id, segment_id, any_value(q) AS q, any_value(question) AS question, any_value(qt) AS qt, count(*) AS n, count(*) FILTER (WHERE weak IS NULL) AS n_kept,
         coalesce(sum(len(bt)) FILTER (WHERE weak IS NULL), 0) AS n_clear, sum(len(bt)) AS candidate_clear, coalesce(bool_or(claim) FILTER (WHERE weak IS NULL), false) AS claim,
         arg_max(cut, turn_index) FILTER (WHERE weak IS NULL) AS cut, coalesce(bool_or(weak = 'no_clear_evidence'), false) AS w1, coalesce(bool_or(weak = 'acknowledgement_or_no_information'), false) AS w2,
         coalesce(string_agg(speaker_label || ': ' || text, chr(10) ORDER BY turn_index) FILTER (WHERE weak IS NULL), '') AS selected_text
  FROM resp GROUP BY interview_id, segment_id
), content AS (
  SELECT r.interview_id, r.segment_id, count(*) AS n_content, count(*) FILTER (WHERE NOT list_contains(g.qt, w)) AS n_new
  FROM (SELECT interview_id, segment_id, unnest(bt) AS w FROM resp WHERE weak IS NULL) r JOIN grp g ON g.interview_id = r.interview_id AND g.segment_id = r.segment_id
  WHERE NOT list_contains({_array(L.ECHO_TOKENS)}, w) GROUP BY 1, 2
), audit AS (
  SELECT g.*, CASE WHEN n_kept = 0 AND w1 THEN 'no_clear_evidence' WHEN n_kept = 0 THEN 'acknowledgement_or_no_information'
    WHEN n_clear <= 10 AND coalesce(c.n_content, 0) > 0 AND coalesce(c.n_new, 0) = 0 THEN 'question_echo' WHEN n_clear <= 5 AND NOT claim THEN 'short_fragment' WHEN cut THEN 'clear_cutoff' END AS primary_reason
  FROM grp g LEFT JOIN content c ON c.interview_id = g.interview_id AND c.segment_id = g.segment_id
)"""
_ALL = f"WITH {_TURNS}, {_FLAGS}, {_EXCHANGES}, {_AUDIT} "


def _turns(spark, d):
    return conversation_turns(read(spark, d, "conversations"))


def _audit(spark, d):
    return selection.audit(_turns(spark, d))


# -- conversations


@query(f"WITH {_TURNS}, {_FLAGS}, {_EXCHANGES} SELECT interview_id, segment_id, q AS question_turn_index, turn_index FROM ex")
def exchanges(spark, d):
    return turns.exchanges(_turns(spark, d)).select("interview_id", "segment_id", "question_turn_index", "turn_index")


@query(_ALL + "SELECT interview_id, segment_id, CASE WHEN primary_reason IS NULL THEN 'retained' ELSE 'rejected' END AS decision, primary_reason, selected_text, CAST(n_clear AS BIGINT) AS clear_word_count, CAST(candidate_clear AS BIGINT) AS candidate_clear FROM audit")
def exchange_audit(spark, d):
    return _audit(spark, d).select("interview_id", "segment_id", "decision", "primary_reason", "selected_text", F.col("clear_word_count").cast("long").alias("clear_word_count"), F.col("candidate_clear").cast("long").alias("candidate_clear"))


@query(_ALL + "SELECT interview_id, count(*) AS n_candidates, count(*) FILTER (WHERE primary_reason IS NULL) AS n_retained, count(*) FILTER (WHERE primary_reason IS NOT NULL) AS n_rejected, CAST(sum(n - n_kept) AS BIGINT) AS n_pruned, CAST(sum(candidate_clear) AS BIGINT) AS candidate_words, CAST(sum(CASE WHEN primary_reason IS NULL THEN n_clear ELSE 0 END) AS BIGINT) AS retained_words FROM audit GROUP BY interview_id")
def exchange_qa(spark, d):
    return selection.quality(_audit(spark, d))


@query(_ALL + "SELECT count(*) AS n_interviews, CAST(sum(a) AS BIGINT) AS n_candidates, CAST(sum(b) AS BIGINT) AS n_retained FROM (SELECT interview_id, count(*) AS a, count(*) FILTER (WHERE primary_reason IS NULL) AS b FROM audit GROUP BY 1)")
def qa_totals(spark, d):
    return selection.quality(_audit(spark, d)).agg(F.count("*").alias("n_interviews"), F.sum("n_candidates").alias("n_candidates"), F.sum("n_retained").alias("n_retained"))


@query(_ALL + "SELECT primary_reason AS reason, count(*) AS n_primary FROM audit WHERE primary_reason IS NOT NULL GROUP BY 1")
def rejection_reasons(spark, d):
    return selection.reason_counts(_audit(spark, d)).where("n_primary > 0").select("reason", "n_primary")


@query(f"""WITH {_TURNS} SELECT * FROM (SELECT interview_id, turn_index, role, coalesce(lag(upper(role[1]) || role[2:] || ': ' || text) OVER w, '') AS previous_context, coalesce(lead(upper(role[1]) || role[2:] || ': ' || text) OVER w, '') AS next_context
FROM turns WINDOW w AS (PARTITION BY interview_id ORDER BY turn_index)) WHERE role = 'participant'""")
def turn_neighbors(spark, d):
    return turns.neighbours(_turns(spark, d)).select("interview_id", "turn_index", "role", "previous_context", "next_context")


@query(f"""WITH {_TURNS}, p AS (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY turn_index) AS pos, count(*) OVER (PARTITION BY interview_id) AS n FROM turns)
SELECT a.interview_id, a.turn_index, string_agg('Turn ' || b.turn_index || ' | ' || CASE b.role WHEN 'interviewer' THEN 'Interviewer' ELSE 'Participant' END || ': ' || b.text, chr(10) ORDER BY b.pos) AS context,
  CAST(greatest(a.pos - 1 - 2, 0) AS BIGINT) AS omitted_before, CAST(greatest(a.n - a.pos - 2, 0) AS BIGINT) AS omitted_after
FROM p a JOIN p b ON a.interview_id = b.interview_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.role = 'participant' GROUP BY a.interview_id, a.turn_index, a.pos, a.n""")
def context_window_2_2(spark, d):
    return turns.window_context(_turns(spark, d), 2, 2).select("interview_id", "turn_index", "context", F.col("omitted_before").cast("long").alias("omitted_before"), F.col("omitted_after").cast("long").alias("omitted_after"))


@query(f"WITH {_TURNS} SELECT interview_id, string_agg('Turn ' || turn_index || ' | ' || CASE role WHEN 'interviewer' THEN 'Interviewer' ELSE 'Participant' END || ': ' || text, chr(10) ORDER BY turn_index) AS full_context, count(*) AS n_turns FROM turns GROUP BY 1")
def full_context(spark, d):
    return turns.full_context(_turns(spark, d))


@query(f"WITH {_TURNS}, {_FLAGS} SELECT interview_id, turn_index, is_filler_only, is_unclear_only, is_backchannel FROM marked")
def backchannel_flags(spark, d):
    return turns.flagged(_turns(spark, d)).select("interview_id", "turn_index", "is_filler_only", "is_unclear_only", "is_backchannel")


@query(f"WITH {_TURNS}, {_FLAGS} SELECT interview_id, turn_index, {_WEAK} AS weak, {_CLAIM} AS claim, {_CUT} AS cutoff FROM (SELECT *, {_bare('text')} AS x FROM marked)")
def turn_evidence(spark, d):
    return turns.with_evidence(_turns(spark, d)).select("interview_id", "turn_index", T.weak_reason("clear_tokens").alias("weak"), T.is_claim("clear_tokens").alias("claim"), T.is_cutoff("clear_text").alias("cutoff"))


@query("""SELECT interview_id, turn_index, turn_before FROM (SELECT conv_id AS interview_id, (turn * 7) % 5 AS turn_index, turn, lag((turn * 7) % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_before FROM conversations) WHERE turn_index <= turn_before""")
def turn_order_violations(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("interview_id"), ((F.col("turn") * 7) % 5).alias("turn_index"), F.col("turn").alias("ord"))
    return turns.order_violations(rows).select("interview_id", "turn_index", F.col("before").alias("turn_before"))


@query(_ALL + "SELECT interview_id, list(segment_id ORDER BY segment_id) AS segments FROM audit WHERE primary_reason IS NULL GROUP BY 1")
def segments_by_interview(spark, d):
    return _audit(spark, d).where("decision = 'retained'").groupBy("interview_id").agg(F.array_sort(F.collect_list("segment_id")).alias("segments"))


@query(_ALL + "SELECT interview_id, segment_id FROM audit WHERE primary_reason IS NULL ORDER BY interview_id, segment_id LIMIT 25")
def segment_limit(spark, d):
    return lineage.first_records(_audit(spark, d).where("decision = 'retained'").select("interview_id", "segment_id"), ["interview_id", "segment_id"], 25)


@query(_ALL + "SELECT interview_id, segment_id, 'user' AS prompt_role, 'system' AS first_role, question || chr(10) || selected_text AS content FROM audit WHERE primary_reason IS NULL")
def chat_rows(spark, d):
    rows = _audit(spark, d).where("decision = 'retained'").withColumn("prompt", T.template("{question}\n{text}", question="question", text="selected_text"))
    rows = rows.withColumn("chat", pairs.conversation("prompt", "selected_text", F.lit(""))).withColumn("full", pairs.with_system(F.col("chat.prompt"), "Ask one question."))
    return rows.select("interview_id", "segment_id", F.col("chat.prompt")[0]["role"].alias("prompt_role"), F.col("full")[0]["role"].alias("first_role"), F.col("full")[1]["content"].alias("content"))


@query(_ALL + "SELECT interview_id, segment_id, min(turn_index) AS first_turn, max(turn_index) AS last_turn FROM resp WHERE weak IS NULL GROUP BY 1, 2")
def exchange_span(spark, d):
    rows = _audit(spark, d).where("size(target_turns) > 0")
    return rows.select("interview_id", "segment_id", F.array_min("target_turns").alias("first_turn"), F.array_max("target_turns").alias("last_turn"))


@query(_ALL + """SELECT interview_id, segment_id, list_filter([CASE WHEN n_clear <= 10 THEN 'very_short' END,
  CASE WHEN len(st) > 0 AND NOT suffix(rtrim(selected_text), '?') AND (list_contains(""" + _array(L.HARD_CUTOFF) + """, st[-1]) OR regexp_matches(rtrim(selected_text), '(?:—|–|--)$') OR (regexp_matches(rtrim(selected_text), '(?:,|:|;|\\.\\.\\.|…)$') AND list_contains(""" + _array(L.CONTINUATION) + """, st[-1]))) THEN 'explicitly_unfinished' END,
  CASE WHEN len(qt) = 0 AND n_clear < 30 THEN 'unclear_or_damaged' END, CASE WHEN regexp_matches(selected_text, '(?i)(?:""" + L.MANAGEMENT + """)') OR (n_clear <= 25 AND regexp_matches(question, '(?i)(?:""" + L.MANAGEMENT + """)')) THEN 'interview_management' END,
  CASE WHEN n_kept = 1 AND n_clear <= 25 AND suffix(rtrim(selected_text), '?') THEN 'participant_question' END,
  CASE WHEN n_clear <= 12 AND NOT regexp_matches(selected_text, '\\p{Nd}') AND len(list_filter(st, lambda t: list_contains(""" + _array(L.EVALUATION) + f""", t))) > 0 THEN 'bare_evaluation' END], lambda x: x IS NOT NULL) AS suggested_reasons
FROM (SELECT *, {_tok(_bare('selected_text'))} AS st FROM audit WHERE primary_reason IS NULL)""")
def review_reasons(spark, d):
    rows = _audit(spark, d).where("decision = 'retained'").withColumns({c: spans.replace_unclear(T.without_stage_directions(x), F.lit(False)) for c, x in (("clear_text", "selected_text"), ("clear_question", "question"))}).withColumn("nq", F.size(T.tokens("clear_question")))
    reasons = T.review_reasons("selected_text", "question", "clear_text", "clear_word_count", "total_word_count", "nq", F.size("target_turns"))
    return rows.select("interview_id", "segment_id", reasons.alias("suggested_reasons"))


# -- documents


@query(f"SELECT doc_id, CAST(len({_tok('text')}) AS BIGINT) AS n_tokens, array_to_string({_tok('text')}[1:5], ' ') AS head FROM documents")
def token_counts(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(f"SELECT doc_id, sha256({_bare('replace(text, chr(44), chr(40) || chr(108) || chr(97) || chr(117) || chr(103) || chr(104) || chr(41))')}) AS bare_sha256 FROM documents")
def stage_directions_removed(spark, d):
    x = F.replace("text", F.lit(","), F.lit("(laugh)"))
    return read(spark, d, "documents").select("doc_id", F.sha2(T.without_stage_directions(x), 256).alias("bare_sha256"))


@query()
def normalized_lines(spark, d):
    x = F.replace(F.replace("text", F.lit(", "), F.lit(" ?? ")), F.lit("."), F.lit("???"))
    rows = read(spark, d, "documents").select("doc_id", T.normalized_turn(x).alias("n"))
    return rows.select("doc_id", "n.paired", "n.isolated", F.sha2("n.text", 256).alias("text_sha256"))


@query()
def unclear_spans(spark, d):
    x = F.replace(F.replace("text", F.lit(", "), F.lit(" [unclear: one [unclear] two] ")), F.lit("."), F.lit(" [unclear]."))
    rows = turns.with_evidence(read(spark, d, "documents").select("doc_id", x.alias("text")))
    return rows.select("doc_id", F.size("total_tokens").alias("n_total"), F.size("clear_tokens").alias("n_clear"))


@query(f"SELECT doc_id, pos, len(ft) > 0 AND len(list_filter(ft, lambda t: NOT regexp_full_match(t, '(?i)(?:{L.FILLER})'))) = 0 AS filler FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(ls[pos], '[\\s,.;!?…''\"()\\-]+'), lambda t: t <> '') AS ft FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(replace(text, 'the', 'mm'), ' ') AS ls FROM documents)) WHERE ls[pos] <> '')")
def filler_words(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("the"), F.lit("mm")), " ")).alias("p", "w")).where("w <> ''")
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), (T.is_filler("w") & (F.regexp_replace("w", r"[\s,.;!?…'\"()\-]+", "") != "")).alias("filler"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, ' ', '_'), '_+', ' ', 'g'), '\s+', ' ', 'g')) AS code_label FROM documents")
def code_labels(spark, d):
    return read(spark, d, "documents").select("doc_id", T.code_label(F.replace("text", F.lit(" "), F.lit("_"))).alias("code_label"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '_') AS ident, coalesce(nullif(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g')), '_'), ''), 'unnamed_code') AS slug FROM documents")
def slug_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", T.identifier("text").alias("ident"), T.slug("text").alias("slug"))


@query("SELECT doc_id, length(x) >= 24 AND NOT regexp_matches(x, '\\s') AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 20 AS collapsed, replace(lower(regexp_replace(text, '[\\s_]+', '', 'g')), 'ß', 'ss') AS folded FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '\\s', '', 'g') ELSE text END AS x FROM documents)")
def collapsed_text(spark, d):
    x = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"\s", "")).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", T.is_collapsed(x).alias("collapsed"), T.separator_insensitive("text").alias("folded"))


@query("SELECT doc_id, CAST(length(x) - length(replace(replace(x, chr(288), ''), chr(266), '')) AS BIGINT) AS replaced, sha256(x) AS before_sha256, sha256(replace(replace(x, chr(266), chr(10)), chr(288), ' ')) AS after_sha256 FROM (SELECT doc_id, replace(replace(text, ' ', chr(288)), '.', chr(266)) AS x FROM documents)")
def decode_markers(spark, d):
    x = F.replace(F.replace("text", F.lit(" "), F.lit("Ġ")), F.lit("."), F.lit("Ċ"))
    rows = read(spark, d, "documents").select("doc_id", T.decoded(x).alias("n"))
    return rows.select("doc_id", F.col("n.replaced").cast("long").alias("replaced"), F.col("n.before").alias("before_sha256"), F.col("n.after").alias("after_sha256"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'no_think_block' WHEN 1 THEN 'missing_close_think_tag' ELSE 'found_closed_think_block' END AS status,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'because' ELSE 'because' END AS reasoning, CASE doc_id % 3 WHEN 1 THEN '' ELSE '{"id":' || doc_id || '}' END AS answer FROM documents""")
def think_sections(spark, d):
    body = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    x = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.lit("<think> because ")).otherwise(F.concat(F.lit("<think> because </think>\n"), body))
    return read(spark, d, "documents").select("doc_id", T.think_sections(x).alias("s")).select("doc_id", "s.status", "s.reasoning", "s.answer")


@query("""SELECT grp, count(n_chars) AS n, min(n_chars) AS min_value, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS max_value
FROM (SELECT lang AS grp, n_chars FROM documents UNION ALL SELECT '__all__', n_chars FROM documents) GROUP BY grp""")
def length_profile(spark, d):
    return lineage.length_profile(read(spark, d, "documents"), "n_chars", "lang")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 8000")
def over_limit(spark, d):
    return lineage.over_limit(read(spark, d, "documents"), "n_chars", 8000).select("doc_id", "n_chars")


@query("""SELECT l_orderkey, l_linenumber, sha256('{"a":"' || l_returnflag || '","k":' || l_orderkey || ',"n":' || l_linenumber || ',"z":null}') AS row_sha256 FROM lineitem""")
def row_sha256(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.canonical_sha256(k="l_orderkey", a="l_returnflag", n="l_linenumber", z=F.lit(None).cast("string")).alias("row_sha256"))


@query("SELECT doc_id, sha256(lang || chr(0) || doc_id || chr(0) || source) AS pair_id, sha256('42' || chr(0) || lang || chr(0) || source) AS split_hash FROM documents")
def pair_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", T.joined_sha256("lang", "doc_id", "source").alias("pair_id"), T.joined_sha256(F.lit(42), "lang", "source").alias("split_hash"))


@query()
def record_fingerprint(spark, d):
    return lineage.fingerprint(read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


def _exclusions(spark, d):
    bad = read(spark, d, "labels").where("quality = 0").select("doc_id")
    rows = read(spark, d, "documents").join(bad, "doc_id")
    return rows.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("stale")).otherwise(F.col("text")).alias("text"))


_EXCLUDED = "x AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'stale' ELSE d.text END AS text FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0)"


@query(f"WITH {_EXCLUDED} SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = d.doc_id)")
def exclusion_anti_join(spark, d):
    return lineage.exclude(read(spark, d, "documents"), _exclusions(spark, d), "doc_id")[0].select("doc_id", "lang")


@query(f"WITH {_EXCLUDED} SELECT d.doc_id FROM documents d JOIN x ON x.doc_id = d.doc_id WHERE x.text <> d.text")
def exclusion_stale_text(spark, d):
    return lineage.exclude(read(spark, d, "documents"), _exclusions(spark, d), "doc_id")[1].select("doc_id")


@query(f"WITH {_EXCLUDED} SELECT source, count(*) AS n_excluded FROM documents d WHERE doc_id IN (SELECT doc_id FROM x) GROUP BY 1")
def exclusion_summary(spark, d):
    return lineage.exclusion_summary(read(spark, d, "documents"), _exclusions(spark, d), "source", "doc_id")


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_text_groups(spark, d):
    return attempts.duplicates(read(spark, d, "documents").select("text"), ["text"])


@query("SELECT l_orderkey, len(list_distinct(list_transform(f, lambda x: lower(x)))) = len(f) AS all_distinct FROM (SELECT l_orderkey, list(l_returnflag) AS f FROM lineitem GROUP BY 1)")
def distinct_labels(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f")).select("l_orderkey", jsonx.distinct_labels("f").alias("all_distinct"))


@query()
def group_split(spark, d):
    return pairs.group_split(read(spark, d, "documents"), "lang", "source", "doc_id", 0.1)


@query("SELECT doc_id, lang, CASE WHEN lang IN ('de', 'es') THEN 'test' ELSE 'train' END AS split, row_number() OVER (PARTITION BY lang IN ('de', 'es') ORDER BY doc_id) AS line_number FROM documents")
def domain_holdout(spark, d):
    return pairs.holdout(read(spark, d, "documents").select("doc_id", "lang"), "lang", ["de", "es"], "doc_id").withColumn("line_number", F.col("line_number").cast("long"))


@query("SELECT source FROM documents WHERE lang IN ('de', 'es') INTERSECT SELECT source FROM documents WHERE lang NOT IN ('de', 'es')")
def split_overlap(spark, d):
    docs = read(spark, d, "documents")
    return pairs.overlap(docs.where("lang not in ('de', 'es')"), docs.where("lang in ('de', 'es')"), "source")


@query("SELECT lang, source, count(DISTINCT doc_id) AS n_records FROM documents GROUP BY 1, 2")
def group_record_counts(spark, d):
    return read(spark, d, "documents").groupBy("lang", "source").agg(F.count_distinct("doc_id").alias("n_records"))


@query("SELECT doc_id, CASE WHEN n_chars < 4096 THEN least(1024, 4096 - n_chars) END AS budget FROM documents")
def token_budget(spark, d):
    return read(spark, d, "documents").select("doc_id", lineage.token_budget(F.col("n_chars"), 1024, 4096).cast("long").alias("budget"))


@query("SELECT doc_id, CAST(length(left(text, 200)) - length(replace(left(text, 200), chr(10), '')) + 1 AS BIGINT) AS line FROM documents")
def line_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", T.line_number("text", F.lit(200)).cast("long").alias("line"))


@query("SELECT doc_id, 'Doc ' || doc_id || ' in {place}: ' || lang || ' {x}' AS prompt FROM documents")
def prompt_template(spark, d):
    return read(spark, d, "documents").select("doc_id", T.template("Doc {id} in {place}: {lang} {{x}}", id="doc_id", lang="lang").alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' END AS payload, doc_id % 4 = 0 AS ok, '{"doc_id":' || doc_id || '}' AS tolerant_payload, 'braces' AS tolerant_method FROM documents""")
def strict_json(spark, d):
    x = F.concat(F.lit("```json\n"), F.to_json(F.struct("doc_id", "lang")), F.when(F.col("doc_id") % 4 == 0, "\n```").otherwise("}\n```"))
    rows = read(spark, d, "documents").select("doc_id", jsonx.parse_strict(x).alias("s"), jsonx.parse_tolerant(F.concat(F.to_json(F.struct("doc_id")), F.lit("}}"))).alias("t"))
    return rows.select("doc_id", "s.payload", F.col("s.error").isNull().alias("ok"), F.col("t.payload").alias("tolerant_payload"), F.col("t.method").alias("tolerant_method"))


@query("""SELECT doc_id, 'valid' AS status, '{"digest":"' || substr(sha256('42' || chr(0) || p), 1, 12) || '","echo":' || CAST(to_json(substr(p, 1, 40)) AS VARCHAR) || ',"stop":true}' AS payload FROM (SELECT doc_id, 'Summarise: ' || text AS p FROM documents)""")
def dry_run_samples(spark, d):
    rows = read(spark, d, "documents").select("doc_id", T.template("Summarise: {x}", x="text").alias("prompt"))
    return generation.single_pass(rows).select("doc_id", "status", "payload")


@query("SELECT 1 AS rounds, count(*) AS n FROM documents")
def self_refine_rounds(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generation.self_refine(rows, 2, seed=41).groupBy("rounds").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS text_tokens FROM documents")
def chat_token_lengths(spark, d):
    return generation.token_lengths(read(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", F.col("text_tokens").cast("long").alias("text_tokens"))


# -- labels, benchmark


@query("SELECT l.doc_id, CASE WHEN quality = 0 THEN 'exclude' WHEN toxic = 1 THEN 'review' ELSE 'keep' END AS decision, d.doc_id IS NOT NULL AS known FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def review_validation(spark, d):
    decision = F.when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "review").otherwise("keep")
    docs = read(spark, d, "documents").select("doc_id", F.lit(True).alias("known"))
    return read(spark, d, "labels").select("doc_id", decision.alias("decision")).join(docs, "doc_id", "left").fillna(False, ["known"])


@query("SELECT CASE WHEN quality = 0 THEN 'exclude' WHEN toxic = 1 THEN 'review' ELSE 'keep' END AS decision, count(*) AS n FROM labels GROUP BY 1")
def review_decisions(spark, d):
    return review_validation(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT source, lang, arg_min(text, doc_id) AS t FROM documents GROUP BY 1, 2)
SELECT doc_id, CASE WHEN trim(q) = '' THEN 'error' WHEN contains(t, trim(q)) THEN 'ok' ELSE 'warning' END AS status FROM (SELECT doc_id, source, lang, split_part(text, chr(10), 1) AS q FROM documents) JOIN f USING (source, lang)""")
def quote_substring(spark, d):
    """Each document's first line as a quote from the first document of its source and language."""
    docs = read(spark, d, "documents")
    first = docs.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("t"))
    return docs.select("doc_id", "source", "lang", F.split("text", "\n")[0].alias("q")).join(first, ["source", "lang"]).select("doc_id", jsonx.quote_status("t", "q").alias("status"))


@query("SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def inventory_diff(spark, d):
    return lineage.set_differences(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


# -- pages


@query()
def page_paragraphs(spark, d):
    return html.turns(read(spark, d, "pages").select(F.col("page_id").alias("interview_id"), "html"), "p.q", "p").select("interview_id", "turn_index", "paragraph_index", "role", "text")


@query()
def page_sections(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(html.sections_udf("h1")("html")).alias("s")).select("page_id", "s.idx", "s.label", "s.text")


@query()
def page_characteristics(spark, d):
    return read(spark, d, "pages").select("page_id", html.characteristics_udf(F.replace("html", F.lit("<nav>"), F.lit("<table><tr><td>Age</td><td>40</td></tr></table><nav>"))).alias("m"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS title_id FROM pages")
def page_title_slug(spark, d):
    return read(spark, d, "pages").select("page_id", T.identifier(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_id"))


@query()
def mojibake_repair(spark, d):
    bad = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    return read(spark, d, "documents").select("doc_id", F.sha2(spans.repair_mojibake(bad), 256).alias("repaired_sha256"))


# -- events


def _events(spark, d):
    return read(spark, d, "events")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, -event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_attempt(spark, d):
    return attempts.latest(_events(spark, d), ["user_id", "event_type"], ["ts"], "event_id").select("user_id", "event_type", "event_id", "ts")


@query("SELECT count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(*) FILTER (WHERE event_type <> 'error') AS n_other, count(DISTINCT user_id) AS n_keys FROM events")
def attempt_scan_counts(spark, d):
    return attempts.scan_counts(_events(spark, d), "event_type", "error")


def _checkpoints(spark, d):
    last = attempts.latest(_events(spark, d), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success").alias("status"))


_LAST = "c AS (SELECT user_id, CASE WHEN arg_max(event_id, (ts, event_id)) % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1)"


@query(f"WITH {_LAST} SELECT coalesce(c_custkey, user_id) AS user_id, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN status IS NULL THEN 'missing' WHEN status = 'success' THEN 'skip' ELSE 'retry' END AS action FROM customer FULL JOIN c ON c_custkey = user_id")
def resume_plan(spark, d):
    return attempts.resume_plan(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _checkpoints(spark, d), "user_id")


@query(f"WITH {_LAST} SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM c WHERE status = 'success')")
def resume_remaining(spark, d):
    return attempts.remaining(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _checkpoints(spark, d), "user_id")


@query(f"WITH {_LAST} SELECT count(*) FILTER (WHERE status = 'success') AS n_success, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status IS NULL) AS n_missing, count(*) FILTER (WHERE status IS NULL OR status = 'failed') AS n_retry, CASE WHEN count(*) FILTER (WHERE status IS NULL OR status = 'failed') = 0 THEN 'complete' ELSE 'incomplete' END AS state FROM customer LEFT JOIN c ON c_custkey = user_id")
def run_state_counts(spark, d):
    return attempts.run_state(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _checkpoints(spark, d), "user_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_attempts(spark, d):
    return attempts.duplicates(_events(spark, d), ["user_id", "event_type"])


@query("SELECT count(*) AS n_lines, count(*) FILTER (WHERE event_id % 7 = 0) AS n_bad FROM events")
def bad_json_lines(spark, d):
    line = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return _events(spark, d).select(jsonx.parse_strict(line).alias("r")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("r.payload").isNull()).alias("n_bad"))


@query(f"WITH {_LAST} SELECT user_id, status, CASE WHEN user_id % 5 = 0 THEN 'target_missing' WHEN user_id % 7 = 0 THEN 'fingerprint_mismatch' WHEN status = 'failed' THEN 'unrepairable' ELSE 'repaired' END AS outcome FROM c")
def repair_outcomes(spark, d):
    c = _checkpoints(spark, d)
    failed = c.withColumns({"fingerprint": F.sha2(F.col("user_id").cast("string"), 256), "repaired": F.when(F.col("status") == "success", "x")})
    targets = c.where("user_id % 5 <> 0").select("user_id", F.when(F.col("user_id") % 7 == 0, "other").otherwise(F.sha2(F.col("user_id").cast("string"), 256)).alias("fingerprint"))
    return attempts.repair_outcomes(failed, targets, ["user_id"]).select("user_id", "status", "outcome")


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts, count(*) AS n_attempts FROM events GROUP BY 1")
def stream_state(spark, d):
    """The batch form of the streaming aggregate; tests compare the two."""
    from ..streaming.state import latest_status

    return latest_status(_events(spark, d), ["user_id"], "event_type", "ts")


# -- orders and lines: candidates and rankings

_CAND = "c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS label FROM lineitem)"
_RANK = f"""{_CAND}, r AS (
  SELECT l_orderkey, 1 AS agent, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, label) - 1 AS pos FROM c
  UNION ALL SELECT l_orderkey, 2, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, label) - 1 FROM c
), b AS (
  SELECT r.l_orderkey, r.label, CAST(sum(n.n - r.pos) AS BIGINT) AS score, min(CASE WHEN agent = 2 THEN pos END) AS tie_pos
  FROM r JOIN (SELECT l_orderkey, count(*) AS n FROM c GROUP BY 1) n ON n.l_orderkey = r.l_orderkey GROUP BY 1, 2
), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, tie_pos, label) AS final_rank FROM b)"""


def _rankings(spark, d):
    c = candidates(read(spark, d, "lineitem"))
    at = lambda col: (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(col), "label")) - 1).alias("pos")
    return c.select("l_orderkey", F.lit(1).alias("agent"), "label", at("l_extendedprice")).unionByName(c.select("l_orderkey", F.lit(2).alias("agent"), "label", at("l_quantity")))


def _borda(spark, d):
    return ranking.borda(_rankings(spark, d), ["l_orderkey"], 2)


@query(f"WITH {_RANK} SELECT l_orderkey, label, score, final_rank FROM f")
def borda_ranking(spark, d):
    return _borda(spark, d).select("l_orderkey", F.col("label").cast("long").alias("label"), "score", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"WITH {_RANK} SELECT l_orderkey, score, count(*) AS n_tied, array_to_string(list(label ORDER BY final_rank), ',') AS applied_order FROM f GROUP BY 1, 2 HAVING count(*) >= 2")
def borda_ties(spark, d):
    return ranking.ties(_borda(spark, d), ["l_orderkey"]).withColumn("applied_order", F.array_join("applied_order", ","))


@query(f"WITH {_RANK} SELECT l_orderkey, array_to_string(list(label ORDER BY final_rank), ',') AS final_order, max(CASE WHEN label = 1 THEN score END) AS score_1, max(CASE WHEN label = 2 THEN score END) AS score_2 FROM f GROUP BY 1")
def ranking_wide(spark, d):
    return ranking.wide(_borda(spark, d), ["l_orderkey"], [1, 2]).withColumn("final_order", F.array_join("final_order", ","))


@query(f"WITH {_RANK} SELECT f.l_orderkey, f.label AS top_label, c.l_partkey FROM f JOIN c ON c.l_orderkey = f.l_orderkey AND c.label = f.label WHERE final_rank = 1")
def top_candidate_lookup(spark, d):
    best = ranking.top(_borda(spark, d), ["l_orderkey"])
    c = candidates(read(spark, d, "lineitem")).select("l_orderkey", F.col("label").alias("top_label"), "l_partkey")
    return best.join(c, ["l_orderkey", "top_label"]).withColumn("top_label", F.col("top_label").cast("long"))


def _two(spark, d):
    r = _rankings(spark, d).groupBy("l_orderkey", "agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("ranking"))
    human = r.where("agent = 1").select("l_orderkey", F.when(F.col("l_orderkey") % 50 == 0, F.slice("ranking", 2, 50)).otherwise(F.col("ranking")).alias("ranking"))
    model = r.where("agent = 2").select("l_orderkey", "ranking", F.lit(2).alias("ord"))
    old = model.where("l_orderkey % 9 = 0").select("l_orderkey", F.reverse("ranking").alias("ranking"), F.lit(1).alias("ord"))
    return ranking.agreement(human, model.unionByName(old), ["l_orderkey"])


_AGREE = f"""{_RANK}, n AS (SELECT l_orderkey, count(*) AS n FROM c GROUP BY 1), two AS (
  SELECT a.l_orderkey, a.label, a.pos AS pa, b.pos AS pb, n.n FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.label = b.label AND a.agent = 1 AND b.agent = 2 JOIN n ON n.l_orderkey = a.l_orderkey
), g AS (
  SELECT l_orderkey, CASE WHEN l_orderkey % 50 = 0 THEN CASE WHEN any_value(n) = 1 THEN 'empty ranking' ELSE 'rankings hold different labels' END ELSE '' END AS error,
    bool_or(pa = 0 AND pb = 0) AS top1, bool_and(pa = pb) AS full_, CAST(sum(abs(pa - pb)) AS BIGINT) AS dist, any_value(n) AS n, sum((pa - pb) * (pa - pb)) AS d2
  FROM two GROUP BY 1
), m AS (
  SELECT l_orderkey, error, CASE WHEN error = '' THEN top1 END AS top1_match, CASE WHEN error = '' THEN full_ END AS full_match, CASE WHEN error = '' THEN dist END AS rank_distance,
    CASE WHEN error = '' AND n > 1 THEN round(1 - 6 * CAST(d2 AS DOUBLE) / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1)), 6) END AS spearman FROM g
)"""


@query(f"WITH {_AGREE} SELECT * FROM m")
def rank_agreement(spark, d):
    return _two(spark, d).select("l_orderkey", "error", "top1_match", "full_match", "rank_distance", F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {_AGREE} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE error = '') AS n_valid, count(*) FILTER (WHERE error <> '') AS n_invalid, round(avg(CAST(top1_match AS INTEGER)), 6) AS top1_rate,
round(avg(CAST(full_match AS INTEGER)), 6) AS full_rate, round(avg(rank_distance), 6) AS mean_distance FROM m JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def agreement_summary(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    s = ranking.summary(_two(spark, d).join(o, "l_orderkey"), ["o_orderpriority"])
    return s.select("o_orderpriority", "n", "n_valid", "n_invalid", *[F.round(c, 6).alias(c) for c in ("top1_rate", "full_rate", "mean_distance")])


@query(f"WITH {_CAND} SELECT l_orderkey, CASE WHEN l_orderkey % 50 = 0 THEN 'missing label' ELSE '' END AS errors FROM c GROUP BY 1")
def ranking_permutation_check(spark, d):
    rows = _two(spark, d)
    return rows.select("l_orderkey", F.array_join(ranking.permutation_errors(F.col("human_ranking"), F.col("model_ranking")), ";").alias("errors"))


@query(f"WITH {_CAND} SELECT l_orderkey, block, count(*) AS n_candidates FROM c JOIN (VALUES ('N'), ('A'), ('R')) v(block) ON l_returnflag = block GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 5 AND max(label) = count(*)")
def candidate_mapping_join(spark, d):
    c = candidates(read(spark, d, "lineitem"))
    maps = c.select("l_orderkey", F.col("l_returnflag").alias("block"), "label", F.col("l_partkey").alias("sample_index"))
    blocks = spark.createDataFrame([("N",), ("A",), ("R",)], "block string")
    segs = c.select("l_orderkey").distinct()
    return ranking.candidate_blocks(segs, maps, blocks, ["l_orderkey"]).select("l_orderkey", "block", F.col("n_candidates").cast("long").alias("n_candidates"))


_NEG = """k AS (SELECT DISTINCT l_orderkey, l_shipdate_m AS category FROM (SELECT l_orderkey, CAST(month(l_shipdate) % 4 AS VARCHAR) AS l_shipdate_m FROM lineitem)),
o AS (SELECT a.l_orderkey, a.category, list(b.category ORDER BY b.category) AS others, sha256(a.l_orderkey || chr(0) || a.category) AS h FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.category <> b.category GROUP BY 1, 2),
p AS (SELECT l_orderkey, category, others[CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) % len(others) AS BIGINT) + 1] AS rejected, h AS pair_id FROM o)"""


def _negatives(spark, d):
    k = read(spark, d, "lineitem").select("l_orderkey", (F.month("l_shipdate") % 4).cast("string").alias("category")).distinct()
    return pairs.negative_pairs(k, ["l_orderkey"])


@query(f"WITH {_NEG} SELECT * FROM p")
def negative_pairs(spark, d):
    return _negatives(spark, d).select("l_orderkey", "category", "rejected", "pair_id")


@query(f"WITH {_NEG}, v AS (SELECT DISTINCT category FROM k) SELECT a.category, b.category AS rejected, count(p.pair_id) AS n FROM v a JOIN v b ON a.category <> b.category LEFT JOIN p ON p.category = a.category AND p.rejected = b.category GROUP BY 1, 2")
def rejection_matrix(spark, d):
    p = _negatives(spark, d)
    return pairs.rejection_matrix(p, p.select("category").distinct())


@query(f"WITH {_NEG} SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT category) AS n_categories FROM p GROUP BY 1 HAVING count(*) <> 4 OR count(DISTINCT category) <> 4")
def bundle_check(spark, d):
    return pairs.bundle_violations(_negatives(spark, d), ["l_orderkey"])


@query("SELECT n_nationkey AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def zero_filled_counts(spark, d):
    return lineage.zero_filled(read(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


@query("SELECT coalesce(a.k, b.k) AS k, actual, expected FROM (SELECT c_nationkey AS k, count(*) AS actual FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS expected FROM supplier GROUP BY 1) b ON a.k = b.k WHERE actual IS DISTINCT FROM expected")
def expected_vs_actual(spark, d):
    a = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return pairs.count_differences(a, b, "k")


@query(f"WITH {_NEG} SELECT version, l_orderkey, category, CASE version WHEN 'evidence' THEN category || ' over ' || rejected ELSE category END AS text FROM p, (VALUES ('evidence'), ('question')) v(version)")
def stacked_versions(spark, d):
    p = _negatives(spark, d)
    one = p.select(F.lit("evidence").alias("version"), "l_orderkey", "category", F.concat("category", F.lit(" over "), "rejected").alias("text"))
    return one.unionByName(p.select(F.lit("question").alias("version"), "l_orderkey", "category", F.col("category").alias("text")))


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dimension_membership(spark, d):
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return read(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


# -- nested samples, aligned files, snapshots


def _segments(spark, d):
    """Orders as segments, their lines as samples: returned lines are invalid, filled ones valid."""
    c = candidates(read(spark, d, "lineitem"))
    sample = F.struct(F.col("label").alias("sample_index"), F.when(F.col("l_returnflag") == "N", "valid").otherwise("invalid").alias("final_parse_status"), F.col("l_linestatus").alias("raw_text"))
    return c.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array_sort(F.collect_list(sample)).alias("samples"))


@query(f"WITH {_CAND} SELECT l_orderkey AS record_id, label - 1 AS sample_list_index FROM c WHERE l_returnflag <> 'N'")
def invalid_samples(spark, d):
    return records.invalid_samples(_segments(spark, d)).select("record_id", F.col("sample_list_index").cast("long").alias("sample_list_index"))


@query(f"WITH {_CAND} SELECT l_orderkey AS record_id, array_to_string(list(label ORDER BY label), ',') AS invalid_indexes FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'N') = 0")
def failed_segments(spark, d):
    return records.failed_segments(_segments(spark, d)).select("record_id", F.array_join("invalid_indexes", ",").alias("invalid_indexes"))


@query(f"""WITH {_CAND} SELECT l_orderkey AS record_id, label AS sample_index, sha256('{{"raw":"' || l_linestatus || '","record_id":' || l_orderkey || ',"sample_index":' || label || '}}') AS fingerprint FROM c WHERE l_returnflag <> 'N'""")
def failure_items(spark, d):
    return records.failure_items(_segments(spark, d)).select("record_id", F.col("sample_index").cast("long").alias("sample_index"), "fingerprint")


@query("SELECT coalesce(a.k, b.k) AS line, CASE WHEN a.k IS NULL THEN 'first' ELSE 'second' END AS missing_in FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 11 <> 0) a FULL JOIN (SELECT doc_id AS k FROM documents WHERE doc_id % 13 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def positional_alignment(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("line"))
    return records.aligned(docs.where("line % 11 <> 0"), docs.where("line % 13 <> 0"))


@query(f"WITH {_LAST} SELECT user_id, status FROM c WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def frozen_snapshot(spark, d):
    ids = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return records.frozen(_checkpoints(spark, d), ids, ["success"], "user_id")[0]


@query(f"WITH {_NEG} SELECT l_orderkey, category, CASE WHEN h % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, l_orderkey AS h FROM p)")
def predefined_split(spark, d):
    p = _negatives(spark, d).withColumn("line", F.col("l_orderkey"))
    train, test = records.split_by_lines(p, p.where("l_orderkey % 3 = 0").select("line").distinct())
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))).select("l_orderkey", "category", "split")


@query("SELECT list(doc_id ORDER BY doc_id)[1:10] AS first, count(*) - 10 AS more FROM documents WHERE lang = 'fr'")
def id_preview(spark, d):
    return records.preview(read(spark, d, "documents").where("lang = 'fr'"), "doc_id")


@query("SELECT 'p/checkpoint-' || max(n_nationkey) AS path FROM nation")
def latest_checkpoint(spark, d):
    return records.latest_checkpoint(read(spark, d, "nation").select(F.concat(F.lit("p/checkpoint-"), F.col("n_nationkey").cast("string")).alias("path")))


@query(f"""WITH {_RANK}, r1 AS (SELECT l_orderkey, label, pos FROM r WHERE agent = 1), r2 AS (SELECT l_orderkey, label, pos FROM r WHERE agent = 2)
SELECT a.l_orderkey, min(CASE WHEN a.label <> b.label THEN a.pos END) AS first_mismatch FROM r1 a JOIN r2 b ON a.l_orderkey = b.l_orderkey AND a.pos = b.pos GROUP BY 1""")
def first_mismatch(spark, d):
    r = _rankings(spark, d).groupBy("l_orderkey").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("agent") == k, F.struct("pos", "label")))), lambda x: x["label"]).alias(f"r{k}") for k in (1, 2)])
    return r.select("l_orderkey", records.first_mismatch(F.col("r1"), F.col("r2")).cast("long").alias("first_mismatch"))


@query(f"WITH {_NEG} SELECT pair_id, 'target is rejected' AS errors FROM p WHERE l_orderkey % 97 = 0")
def pair_audit_violations(spark, d):
    p = _negatives(spark, d)
    rows = p.select("pair_id", F.col("category").alias("target_category"), F.when(F.col("l_orderkey") % 97 == 0, F.col("category")).otherwise(F.col("rejected")).alias("rejected_source_category"), F.col("pair_id").alias("line_number"))
    return records.audit_violations(rows).select("pair_id", F.array_join("errors", ";").alias("errors"))


@query("""SELECT doc_id, 'Research questions:' || chr(10) || '1. ' || lang || chr(10) || '2. ' || source || chr(10) || chr(10) || 'Interview context window:' || chr(10) || text || chr(10) || chr(10) || 'Target segment:' || chr(10) || source || chr(10) || chr(10) || 'Code label:' || chr(10) || lang AS prompt, 'Lang: ' || lang || chr(10) || 'Source: ' || source AS fields FROM documents""")
def rendered_prompts(spark, d):
    rows = read(spark, d, "documents").withColumns({"q": F.array("lang", "source"), "context": F.col("text"), "target": F.col("source")})
    return rows.select("doc_id", records.prompt_sections("q", F.lit("Interview context window"), "context", "target", "lang").alias("prompt"), records.field_lines(["lang", "source"]).alias("fields"))


@query("SELECT doc_id, source || '_' || lang || '_' || doc_id || '_1_' || left(sha256(text), 12) AS artefact FROM documents")
def artefact_ids(spark, d):
    return read(spark, d, "documents").withColumn("one", F.lit(1)).select("doc_id", records.artefact_id("source", "lang", "doc_id", "one", "text").alias("artefact"))


# -- contracts, with planted faults

_JOINED = "array_to_string(list_filter([{}], lambda e: e IS NOT NULL), '; ') AS errors"


def _joined(errors):
    return F.array_join(errors, "; ").alias("errors")


def _when_sql(*cases) -> str:
    return _JOINED.format(", ".join(f"CASE WHEN {bad} THEN '{message}' END" for bad, message in cases))


def _code(hint, label):
    return F.create_map(*[x for f in contracts.CODE_FIELDS[hint] for x in (F.lit(f), label if f == "code_label" else F.concat(F.lit(f"{f} of "), "source"))])


def _questions(rows, labels):
    hints = contracts.CATEGORIES
    text = lambda i: F.concat(F.lit(f"What of {hints[i]}, "), "lang", F.lit("?")) if i < 3 else F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit(f"what  OF {hints[0]}, "), "lang", F.lit("?"))).otherwise(F.concat(F.lit("Why "), "source", F.lit("?")))
    return rows.withColumn("questions", F.array(*[F.struct(labels[i].alias("code"), F.lit(h).alias("hint"), text(i).alias("question")) for i, h in enumerate(hints)]))


def _labels():
    return [F.concat(F.lit(f"{h} "), "source") for h in contracts.CATEGORIES]


@query("SELECT doc_id, " + _when_sql(("doc_id % 7 = 0", "validation errors"), ("doc_id % 13 = 0", "segment_id is empty"), ("doc_id % 5 = 0", "questions differ from the parsed output"), ("doc_id % 17 = 0", "selected_codes[1] has an empty field"), ("doc_id % 11 = 0", "questions repeat")) + " FROM documents")
def trace_contract(spark, d):
    rows = _questions(read(spark, d, "documents"), _labels())
    codes = F.array(*[F.struct(F.lit(h).alias("hint"), (F.transform_values(_code(h, _labels()[i]), lambda k, v: F.when((F.col("doc_id") % 17 == 0) & (k == "category_boundary"), " ").otherwise(v)) if i == 1 else _code(h, _labels()[i])).alias("code")) for i, h in enumerate(contracts.CATEGORIES)])
    parsed = F.when(F.col("doc_id") % 5 == 0, F.slice("questions", 1, 3)).otherwise(F.col("questions"))
    trace = F.struct(
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("validation_errors"), F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("transcript_id"),
        F.when(F.col("doc_id") % 13 == 0, " ").otherwise("SEG").alias("segment_id"), F.lit("t").alias("target_segment"), F.col("source").alias("full_interview_context"), F.array(F.lit("Why?")).alias("research_questions"),
        codes.alias("selected_codes"), F.col("questions").alias("reflective_questions"), F.struct(parsed.alias("reflective_questions")).alias("parsed_output"),
    )
    return rows.withColumn("t", trace).select("doc_id", _joined(contracts.trace_errors("t")))


@query("SELECT doc_id, " + _when_sql(("doc_id % 5 = 0", "assessments of other labels"), ("doc_id % 7 = 0", "uncertainty is empty"), ("doc_id % 3 = 0", "ranking is no permutation"), ("doc_id % 11 = 0", "another block")) + " FROM documents")
def ranking_contract(spark, d):
    i = F.col("doc_id")
    labels = F.array(*map(F.lit, "ABC"))
    payload = F.struct(
        i.cast("string").alias("record_id"), F.when(i % 11 == 0, "other").otherwise("wrong_code").alias("review_block"), F.when(i % 5 == 0, F.create_map(F.lit("A"), F.col("source"))).otherwise(F.map_from_arrays(labels, F.array("source", "lang", "source"))).alias("candidate_assessments"),
        F.col("source").alias("debate_response"), F.when(i % 7 == 0, "").otherwise("low").alias("uncertainty"), F.when(i % 3 == 0, F.array(F.lit("A"), F.lit("A"), F.lit("B"))).otherwise(F.reverse(labels)).alias("ranking"), F.col("lang").alias("rationale"),
    )
    rows = read(spark, d, "documents").withColumns({"p": payload, "block": F.lit("wrong_code"), "labels": labels})
    return rows.select("doc_id", _joined(contracts.ranking_payload_errors("p", "doc_id", "block", "labels")))


@query("SELECT doc_id, " + _when_sql(("doc_id % 3 = 0", "question 2 has another code"), ("doc_id % 4 = 0", "not as many questions as codes"), ("doc_id % 11 = 0", "questions repeat")) + " FROM documents")
def question_contract(spark, d):
    rows = _questions(read(spark, d, "documents"), _labels())
    label = lambda k, h: F.when(F.col("doc_id") % 3 == 0, "another").otherwise(_labels()[k]) if k == 1 else _labels()[k]
    wanted = F.array(*[F.struct(label(k, h).alias("code_label"), F.lit(h).alias("hint")) for k, h in enumerate(contracts.CATEGORIES)])
    asked = F.when(F.col("doc_id") % 4 == 0, F.concat("questions", F.array(F.struct(F.lit("more").alias("code"), F.lit("more").alias("hint"), F.lit("One more?").alias("question"))))).otherwise(F.col("questions"))
    return rows.withColumns({"asked": asked, "wanted": wanted}).select("doc_id", _joined(contracts.question_list_errors("asked", "wanted")))


@query("SELECT doc_id, " + _when_sql(("doc_id % 5 = 0", "an unknown category"), ("doc_id % 7 = 0", "too_broad_code has an empty field"), ("doc_id % 3 = 0", "labels repeat")) + " FROM documents")
def example_contract(spark, d):
    i, hints = F.col("doc_id"), contracts.CATEGORIES
    label = lambda k: F.when(i % 3 == 0, F.lit("Same  LABEL" if k == 1 else "same label")).otherwise(_labels()[k]) if k < 2 else _labels()[k]
    code = lambda k: F.transform_values(_code(hints[k], label(k)), lambda f, v: F.when((i % 7 == 0) & (f == "why_it_is_too_broad"), "").otherwise(v))
    whole = F.create_map(*[x for k, h in enumerate(hints) for x in (F.lit(h), code(k))])
    examples = F.when(i % 5 == 0, F.map_concat(whole, F.create_map(F.lit("more"), code(0)))).otherwise(whole)
    return read(spark, d, "documents").withColumn("e", examples).select("doc_id", _joined(contracts.code_example_errors("e")))


@query("SELECT doc_id, " + _when_sql(("doc_id % 5 = 0", "unknown question"), ("doc_id % 3 = 0", "usefulness disagrees"), ("doc_id % 7 = 0", "no reason")) + " FROM documents")
def usefulness_contract(spark, d):
    i = F.col("doc_id")
    asked = F.when(i % 5 == 0, F.array(F.lit("What else?"))).when(i % 2 == 0, F.array(F.lit("Why?"))).otherwise(F.array().cast("array<string>"))
    rows = read(spark, d, "documents").withColumns({"asked": asked, "told": F.array(F.lit(" Why?"), F.lit("How?"), F.lit(" "))})
    useful = (F.size("asked") > 0) != (i % 3 == 0)
    return rows.select("doc_id", _joined(contracts.usefulness_errors("asked", "told", useful, "source", F.when(i % 7 == 0, " ").otherwise(F.col("lang")))))


@query("SELECT doc_id, " + _when_sql(("doc_id % 3 = 0", "context was not used"), ("doc_id % 5 = 0", "another context scope")) + " FROM documents")
def unit_contract(spark, d):
    i = F.col("doc_id")
    unit = F.struct(F.col("source").alias("interview_id"), F.lit("S").alias("segment_id"), F.lit("participant").alias("speaker"), F.col("text").alias("target_text"), (i % 3 != 0).alias("analysis_context_used"), F.when(i % 5 == 0, "immediate").otherwise("turn_window").alias("analysis_context_scope"), F.lit("").alias("context_warning"))
    return read(spark, d, "documents").where("text is not null").withColumn("u", unit).select("doc_id", _joined(contracts.analysis_unit_errors("u", "turn_window")))


@query(f"WITH {_NEG} SELECT sha256('orders' || chr(0) || l_orderkey || chr(0) || category) AS pair_id, " + _when_sql(("l_orderkey % 3 = 0 AND l_orderkey % 2 = 0", "limits of a full interview"), ("l_orderkey % 2 = 1 AND l_orderkey % 5 = 0", "no limits of the window"), ("l_orderkey % 97 = 0", "target is rejected")) + " FROM p")
def audit_contract(spark, d):
    k = F.col("l_orderkey")
    full = k % 2 == 0
    rows = _negatives(spark, d).select(
        F.xxhash64("pair_id").alias("line_number"), F.lit("orders").alias("source_name"), F.concat(F.lit("p/"), k).alias("source_trace_path"), F.lit("orders").alias("dataset"), k.cast("string").alias("record_id"), k.cast("string").alias("transcript_id"), F.lit("S").alias("segment_id"),
        F.when(full, "full_interview").otherwise("turn_window").alias("context_scope"), F.when(full & (k % 3 != 0), None).when(~full & (k % 5 == 0), -1).otherwise(20).alias("context_turns_before"), F.when(full, None).otherwise(20).alias("context_turns_after"),
        F.col("category").alias("target_category"), F.col("category").alias("target_code_label"), F.lit("Why?").alias("chosen_question"), F.when(k % 97 == 0, F.col("category")).otherwise(F.col("rejected")).alias("rejected_source_category"), F.col("rejected").alias("rejected_code_label"), F.lit("How?").alias("rejected_question"),
        F.sha2(F.lit("e"), 256).alias("category_evidence_row_sha256"), F.sha2(F.lit("q"), 256).alias("question_only_row_sha256"),
    )
    return contracts.audit_errors(contracts.audit_rows(rows)).select("pair_id", _joined(F.col("errors")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'no record' ELSE 'another text' END AS problem FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 7 = 0")
def exclusion_problems(spark, d):
    records_ = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    told = records_.select(F.when(F.col("c_custkey") % 50 == 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return contracts.exclusion_problems(records_, told, "c_custkey", "c_mktsegment").select(F.when(F.col("c_custkey") < 0, -1 - F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"), "problem")


@query("SELECT DISTINCT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no audit row' WHEN d.doc_id % 7 = 0 THEN 'lang differs' ELSE '' END AS errors FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def review_errors(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    audit = docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("lang")))
    return contracts.review_errors(docs, audit, "doc_id", ["source", "lang"]).select("doc_id", _joined(F.col("errors"))).distinct()


@query("SELECT o_orderkey AS l_orderkey, f AS l_returnflag, count(l_orderkey) AS n FROM (SELECT DISTINCT o_orderkey, unnest(['N', 'R']) AS f FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = f GROUP BY 1, 2 HAVING count(l_orderkey) <> 1")
def not_exactly_one(spark, d):
    wanted = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit("N"), F.lit("R"))).alias("l_returnflag"))
    return contracts.not_exactly_one(read(spark, d, "lineitem"), wanted, ["l_orderkey", "l_returnflag"])


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def trace_lookup(spark, d):
    segments = read(spark, d, "documents").select("doc_id", F.lit("r").alias("run_name"), F.concat(F.lit(".\\a\\"), "doc_id").alias("path"))
    traces = read(spark, d, "labels").select(F.lit("r").alias("run_name"), F.concat(F.lit("a/"), "doc_id").alias("path"), "quality")
    return contracts.with_trace(segments, traces, "run_name", "path").select("doc_id", "quality")


# -- prompts, runs


@query(f"WITH {_TURNS} SELECT interview_id, 'S' || interview_id AS segment_id, sha256(string_agg('Turn ' || turn_index || ' | ' || speaker_label || CASE WHEN turn_index % 4 = 0 THEN ' [TARGET SEGMENT S' || interview_id || ']' ELSE '' END || ': ' || text, chr(10) ORDER BY turn_index)) AS context_sha256, count(*) FILTER (WHERE turn_index % 4 = 0) AS n_marked FROM turns GROUP BY 1")
def marked_context(spark, d):
    t = _turns(spark, d)
    targets = t.groupBy("interview_id").agg(F.collect_list(F.when(F.col("turn_index") % 4 == 0, F.col("turn_index"))).alias("target_turn_indexes")).withColumn("segment_id", F.concat(F.lit("S"), "interview_id"))
    return prompts.marked_context(t, targets).select("interview_id", "segment_id", F.sha2("context", 256).alias("context_sha256"), "n_marked")


@query(f"""WITH {_TURNS}, n AS (SELECT *, lag(upper(role[1]) || role[2:] || ': ' || text) OVER w AS a, lead(upper(role[1]) || role[2:] || ': ' || text) OVER w AS b FROM turns WINDOW w AS (PARTITION BY interview_id ORDER BY turn_index))
SELECT interview_id, turn_index, sha256('Previous context:' || chr(10) || coalesce(a, '') || chr(10) || chr(10) || 'Next context:' || chr(10) || coalesce(b, '')) AS context_sha256 FROM n WHERE role = 'participant'""")
def immediate_context(spark, d):
    return turns.analysis_context(_turns(spark, d), "immediate").select("interview_id", "turn_index", F.sha2("context", 256).alias("context_sha256"))


@query("""SELECT doc_id, lang AS key, source || '=x' AS value, '["' || source || '?","' || lang || '?"]' AS questions, '{"analysis_context_scope": "turn_window"} ' || lang AS prompt FROM documents""")
def prompt_variables(spark, d):
    rows = read(spark, d, "documents").withColumn("kv", prompts.key_value(F.concat("lang", F.lit("="), "source", F.lit("=x"))))
    asked = F.array(F.concat(F.lit(" "), "source", F.lit("?")), F.lit(" "), F.concat("lang", F.lit("? ")))
    return rows.select("doc_id", "kv.key", "kv.value", prompts.question_list(asked).alias("questions"), prompts.aligned_scope(F.concat(F.lit('{"analysis_context_scope": "full_interview"} '), "lang"), "turn_window").alias("prompt"))


@query("SELECT sha256(string_agg(source || ' ' || lang || ' ' || doc_id || chr(10), '' ORDER BY doc_id)) AS digest FROM documents")
def rolling_digest(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang", "doc_id").alias("line"))
    return spark.createDataFrame([(prompts.rolling_digest(rows, "doc_id", "line"),)], "digest string")


@query(r"""WITH x AS (SELECT doc_id, '<|user|>' || chr(10) || text || '<|end|>' || chr(10) AS p FROM documents), y AS (SELECT doc_id, p || '<|assistant|>' || chr(10) AS prompt, p || '<|assistant|>' || chr(10) || 'Yes, indeed.<|end|>' || chr(10) AS chosen FROM x)
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(prompt, '\s+'), lambda t: t <> '')) AS BIGINT) AS prompt_tokens, CAST(len(list_filter(regexp_split_to_array(chosen, '\s+'), lambda t: t <> '')) AS BIGINT) AS chosen_tokens, 0 AS n_errors FROM y""")
def chat_profile(spark, d):
    rows = read(spark, d, "documents").withColumn("c", pairs.conversation("text", F.lit("Yes, indeed."), F.lit("No."))).select("doc_id", "c.*")
    out = generation.chat_profile(rows)
    return out.select("doc_id", F.col("prompt_text_tokens").cast("long").alias("prompt_tokens"), F.col("chosen_text_tokens").cast("long").alias("chosen_tokens"), F.size("errors").alias("n_errors"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(replace(text, '.', '!'), ' ') AS b FROM documents), p AS (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM w)
SELECT doc_id, min(i) - 1 AS first_mismatch FROM p WHERE a[i] <> b[i] GROUP BY 1""")
def token_mismatches(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("a"), F.split(F.replace("text", F.lit("."), F.lit("!")), " ").alias("b"))
    return generation.token_mismatches(rows, "doc_id", ["a", "b"]).select("doc_id", F.col("first_mismatch").cast("long").alias("first_mismatch"))


@query("SELECT doc_id, source AS value FROM documents")
def message_values(spark, d):
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("Source (x): no").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("Lang: "), "lang", F.lit("\nSource (x): "), "source", F.lit("\nSource (x): again")).alias("content")))
    return read(spark, d, "documents").withColumn("m", messages).select("doc_id", T.last_message_value("m", "Source (x)").alias("value"))


_STATE = "CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'complete' ELSE 'running' END"


@query(f"""WITH s AS (SELECT user_id, ts, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, arg_max(state, (ts, event_id)) AS status, count(*) FILTER (WHERE state = 'running' AND before IN ('failed', 'complete')) AS resume_count,
       count(*) FILTER (WHERE (before = 'running' AND state = 'running') OR (before IN ('failed', 'complete') AND state <> 'running')) AS n_refused FROM s GROUP BY 1""")
def run_states(spark, d):
    return attempts.run_states(_events(spark, d).withColumn("state", F.expr(_STATE)), "user_id", ["ts", "event_id"], "state")


@query("SELECT event_id FROM events WHERE event_id % 7 = 0")
def dead_letters(spark, d):
    line = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return attempts.quarantined(_events(spark, d).select("event_id", line.alias("payload")))[1].select("event_id")


@query(f"WITH {_LAST} SELECT c_custkey AS user_id, coalesce(status = 'success', false) AS kept FROM customer LEFT JOIN c ON c_custkey = user_id")
def resumed_run(spark, d):
    work = lambda todo: todo.select("user_id", F.lit("fresh").alias("status"))
    out = attempts.resumed(read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _checkpoints(spark, d), "user_id", work)
    return out.select("user_id", (F.col("status") == "success").alias("kept"))
