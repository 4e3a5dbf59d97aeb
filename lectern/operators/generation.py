"""Generation contracts: prompts in, parsed samples out, with a pluggable backend per partition.

A backend factory is called once per partition and returns prompt -> text. The dry-run
backend is deterministic, so every strategy can be tested without a model.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import parse_tolerant
from .cuts import written


def dry_run():
    """A backend that answers each prompt with a JSON object derived from it."""

    def generate(prompt: str, seed: int) -> str:
        return json.dumps({"echo": prompt[:40], "digest": hashlib.sha256(f"{seed}\0{prompt}".encode()).hexdigest()[:12], "stop": seed % 2 == 0})

    return generate


def generate(prompts: DataFrame, factory=dry_run, prompt: str = "prompt", seed: str = "seed") -> DataFrame:
    """Prompts with raw_text."""
    # whole texts are long: batches of few rows fit in memory
    batch_rows, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", prompts.sparkSession.conf
    if int(conf.get(batch_rows)) > 500:
        conf.set(batch_rows, "500")

    def run(batches):
        backend = None
        for batch in batches:
            backend = backend or factory()
            p, s = batch.column(batch.schema.get_field_index(prompt)).to_pylist(), batch.column(batch.schema.get_field_index(seed)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([backend(x, y) for x, y in zip(p, s)], pa.string())], names=[*batch.schema.names, "raw_text"])

    from pyspark.sql import types as T

    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, T.StructField("raw_text", T.StringType())]))


def single_pass(records: DataFrame, factory=dry_run, seed: int = 42) -> DataFrame:
    """One sample per record; valid if its text is one JSON object."""
    out = generate(records.withColumn("seed", F.lit(seed)), factory).withColumn("parsed", parse_tolerant("raw_text"))
    return out.withColumns({"status": F.when(F.col("parsed.payload").isNotNull(), "valid").otherwise("invalid"), "payload": F.col("parsed.payload"), "error": F.col("parsed.error")}).drop("parsed")


def self_consistency(records: DataFrame, n: int, factory=dry_run, seed: int = 42) -> DataFrame:
    """N samples per record; sample i has seed + i - 1."""
    many = records.withColumn("sample_index", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("seed", F.lit(seed) + F.col("sample_index") - 1)
    return generate(many, factory).withColumn("parsed", parse_tolerant("raw_text"))


def repair(records: DataFrame, attempts: int, factory=dry_run, seed: int = 42) -> DataFrame:
    """Invalid samples are tried again, up to `attempts` times, with their error in the prompt. Each round is written before it is parted, so a record is generated once a round and ends once."""
    done, todo = None, records
    for k in range(attempts + 1):
        tried = written(single_pass(todo, factory, seed + k).withColumn("attempt", F.lit(k)))
        good = tried if k == attempts else tried.where("status = 'valid'")
        done = good if done is None else done.unionByName(good)
        todo = tried.where("status = 'invalid'").select(*[c for c in records.columns if c != "prompt"], F.concat("prompt", F.lit("\nThe last answer was refused: "), "error").alias("prompt"))
    return done


def self_refine(records: DataFrame, rounds: int, factory=dry_run, seed: int = 42) -> DataFrame:
    """Feedback, stop or revise, at most `rounds` times, over the records that have not stopped. Each round is written once."""
    done, todo = None, written(single_pass(records, factory, seed).withColumn("rounds", F.lit(0)))
    for k in range(1, rounds + 1):
        stop = F.coalesce(F.get_json_object("payload", "$.stop") == "true", F.lit(False))
        ended = todo.where(stop)
        done = ended if done is None else done.unionByName(ended)
        again = todo.where(~stop).select(*[c for c in records.columns if c != "prompt"], F.concat("prompt", F.lit("\nRevise: "), F.coalesce("payload", F.lit(""))).alias("prompt"))
        todo = written(single_pass(again, factory, seed + k).withColumn("rounds", F.lit(k)))
    return todo if done is None else done.unionByName(todo)


def token_lengths(chats: DataFrame, columns: list[str], tokenize=None) -> DataFrame:
    """Token lengths of rendered columns; without a tokenizer, white-space tokens, inside the JVM."""
    if tokenize is None:
        return chats.withColumns({f"{c}_tokens": F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")) for c in columns})
    count = F.pandas_udf(lambda s: s.map(lambda x: len(tokenize(x))), "int")
    return chats.withColumns({f"{c}_tokens": count(c) for c in columns})


def debate(blocks: DataFrame, turns: list[dict], factory=dry_run, retries: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rankings, failures): agents rank a block's candidates in turn, each seeing the turns before; invalid answers are asked again with their errors, and a block whose turn stays invalid fails.

    blocks: record_id, review_block, prompt, labels (array of strings). turns: {"id", "agent", "contributes"}.
    rankings holds a row per block and turn that was valid, of the blocks that no turn failed.
    """
    from .contracts import RANKING, ranking_payload_errors

    key = ["record_id", "review_block"]
    live, valid, failed = blocks.withColumn("seen", F.lit("")), None, None
    for k, turn in enumerate(turns):
        todo, good = live.withColumn("errors", F.array().cast("array<string>")), None
        for attempt in range(retries + 1):
            notes = F.when(F.size("errors") > 0, F.concat(F.lit("\nRefused: "), F.array_join("errors", "; "))).otherwise("")
            asked = todo.withColumn("ask", F.concat(F.lit(f"You are {turn['agent']}.\n"), "prompt", "seen", notes)).drop("errors")
            out = generate(asked.withColumn("seed", F.lit(seed + 10 * k + attempt)), factory, "ask").withColumn("p", F.from_json(parse_tolerant("raw_text")["payload"], RANKING))
            out = written(out.withColumn("errors", ranking_payload_errors("p", "record_id", "review_block", "labels")).drop("ask", "seed"))
            done = out.where(F.size("errors") == 0)
            good = done if good is None else good.unionByName(done)
            todo = out.where(F.size("errors") > 0).select(*live.columns, "errors")
        lost = todo.select(*key, F.lit(turn["id"]).alias("failed_turn_id"), F.lit(turn["agent"]).alias("failed_agent_id"), F.array_join("errors", "; ").alias("failure_reason"))
        failed = lost if failed is None else failed.unionByName(lost)
        said = good.select(*key, F.lit(turn["id"]).alias("turn_id"), F.lit(k + 1).alias("turn_index"), F.lit(turn["agent"]).alias("agent_id"), F.lit(bool(turn.get("contributes", True))).alias("contributes"), F.col("p.ranking").alias("ranking"))
        valid = said if valid is None else valid.unionByName(said)
        line = F.concat("seen", F.lit(f"\n{turn['id']} ({turn['agent']}): "), F.array_join("p.ranking", " > "))
        live = good.withColumn("seen", line).select(*live.columns)
    return valid.join(failed.select(*key), key, "left_anti"), failed


def rendered_chat(messages, opening: str = "<|{role}|>", closing: str = "<|end|>", prompt: bool = False):
    """array<struct<role,content>> as one text, each message between its marks; with `prompt`, the assistant's opening at the end. A prompt's text is a prefix of the text of prompt and answer."""
    head, _, tail = opening.partition("{role}")
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(head), m["role"], F.lit(tail + "\n"), m["content"], F.lit(closing + "\n"))), "")
    return F.concat(text, F.lit(f"{head}assistant{tail}\n")) if prompt else text


def chat_profile(chats: DataFrame, tokenize=None) -> DataFrame:
    """Prompt, chosen and rejected as texts with their token lengths, and the errors of rows whose texts don't go on from the prompt or lack a message's text."""
    rows = chats.withColumns({"prompt_text": rendered_chat(F.col("prompt"), prompt=True), "chosen_text": rendered_chat(F.concat("prompt", "chosen")), "rejected_text": rendered_chat(F.concat("prompt", "rejected"))})
    whole = lambda side: F.forall(F.concat("prompt", side), lambda m: F.contains(F.col(f"{side}_text"), m["content"]))
    errors = [F.when(~F.startswith(F.col(f"{s}_text"), F.col("prompt_text")), f"{s} does not go on from the prompt") for s in ("chosen", "rejected")] + [F.when(~whole(s), f"{s} lacks a text") for s in ("chosen", "rejected")]
    return token_lengths(rows.withColumn("errors", F.array_compact(F.array(*errors))), ["prompt_text", "chosen_text", "rejected_text"], tokenize)


def token_mismatches(sequences: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sequences that several tokenizers encode differently: (key, first place that differs, lengths). columns: arrays of ids."""
    from .records import first_mismatch

    places = [first_mismatch(F.col(columns[0]), F.col(c)) for c in columns[1:]]
    first = F.least(*places) if len(places) > 1 else places[0]
    return sequences.select(key, first.alias("first_mismatch"), F.array(*[F.size(c) for c in columns]).alias("lengths")).where("first_mismatch is not null")
