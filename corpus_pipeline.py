"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), calls one operator on all that the stage before
kept, and returns what it keeps; all but the last return the columns of documents.
"""

import uuid

from lectern.llm import decontamination, line_dedup, ngram_join, piece_transducer, toxicity
from lectern.llm.common import checkpoint_folder, drop_folder, release


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate_lines(spark, docs, sf_dir):
    """All documents, without lines that many sites share."""
    return line_dedup.clean_documents(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark, docs, sf_dir):
    """The documents with their SentencePiece ids, and the text decoded from these."""
    return piece_transducer.tokenized_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate_lines), ("ngram_jaccard_join", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("sentencepiece", tokenize)]

#: A classifier, a transducer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """documents through all stages, each written to the shared checkpoint folder, read again by the next and then deleted; the last stays."""
    folder, last = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if last:
            drop_folder(spark, last)
        release(spark)
        last = written
    return docs
