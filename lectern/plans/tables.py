"""The roles that general tables play for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as interviews: users ask, assistants answer; system turns go; turns count from 1."""
    role = F.when(F.col("role") == "user", "interviewer").when(F.col("role") == "assistant", "participant")
    label = F.when(F.col("role") == "user", "Interviewer").when(F.col("conv_id") % 2 == 0, "Male").otherwise("Female")
    return conversations.where("role in ('user', 'assistant')").select(F.col("conv_id").alias("interview_id"), (F.col("turn") + 1).alias("turn_index"), role.alias("role"), label.alias("speaker_label"), "text", (F.col("role") == "assistant").alias("target_eligible"))


def candidates(lineitem: DataFrame) -> DataFrame:
    """Lines of an order as candidates: label is the place in a total order of the order's lines (1 = A)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return lineitem.withColumn("label", F.row_number().over(w))
