"""The sample tables as instances, pairs and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_SUBMIXTURES = ("en", "de", "fr", "es")

VECTOR_INSTANCES = """
SELECT e.vec_id AS row_idx,
 CASE CAST(e.label AS INT) % 5 WHEN 0 THEN 'flan2021' WHEN 1 THEN 't0' WHEN 2 THEN 'niv2'
      WHEN 3 THEN 'cot' ELSE 'dialog' END AS submixture,
 concat('task', CAST(e.label AS STRING)) AS task_name,
 CASE WHEN e.label = 0 THEN 'zs_noopt' WHEN e.label = 1 THEN 'zs_opt'
      WHEN e.label = 2 THEN CASE WHEN e.vec_id % 2 = 0 THEN 'zs_opt' ELSE 'zs_noopt' END
      WHEN e.label = 3 THEN CASE WHEN e.vec_id % 3 = 0 THEN 'fs_noopt' ELSE 'zs_noopt' END
      WHEN e.label = 4 THEN CASE e.vec_id % 3 WHEN 0 THEN 'zs_opt' WHEN 1 THEN 'fs_opt' ELSE 'fs_noopt' END
      WHEN e.vec_id % 20 = 19 THEN 'other'
      ELSE CASE e.vec_id % 4 WHEN 0 THEN 'zs_opt' WHEN 1 THEN 'zs_noopt'
                           WHEN 2 THEN 'fs_opt' ELSE 'fs_noopt' END END AS template_type,
 e.label AS task_label,
 'embeddings' AS task_source,
 concat('vector ', CAST(e.vec_id AS STRING)) AS inputs,
 concat('label ', CAST(e.label AS STRING)) AS targets,
 e.embedding
FROM {embeddings} e
"""

DOCUMENT_INSTANCES = """
SELECT doc_id AS row_idx, lang AS submixture, source AS task_name,
 CASE doc_id % 4 WHEN 0 THEN 'zs_opt' WHEN 1 THEN 'zs_noopt' WHEN 2 THEN 'fs_opt' ELSE 'fs_noopt' END
   AS template_type,
 'documents' AS task_source, text AS inputs, concat(lang, ' ', source) AS targets
FROM {documents}
"""

BATCH_LOSSES = """
SELECT l_linenumber AS epoch, l_orderkey AS batch_id, CAST(l_quantity AS BIGINT) AS n,
 CAST(l_extendedprice AS DOUBLE) / 10000 AS loss
FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def vector_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 tasks with given vectors, every case of missing templates and one unknown template."""
    return _view(spark, sf_dir, VECTOR_INSTANCES, "embeddings")


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as instances; the same task name occurs in all four submixtures."""
    return _view(spark, sf_dir, DOCUMENT_INSTANCES, "documents")


def conversation_pairs(spark: SparkSession, sf_dir: str, validation: bool | None = None) -> DataFrame:
    """User turns with the assistant's answers; every tenth conversation is for validation.

    Turns are numbered without gaps, so an answer is found by a join on (conv_id, turn), which
    spreads a long conversation, unlike a window over it.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("inputs"))
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("targets")
    )
    pairs = asked.join(answers, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"),
        "inputs",
        "targets",
        F.lit("conversations").alias("submixture"),
        F.lit("conversations").alias("task_source"),
        F.lit("dialog").alias("task_name"),
        F.lit("zs_noopt").alias("template_type"),
    )
    if validation is None:
        return pairs
    return pairs.where("conv_id % 10 = 0" if validation else "conv_id % 10 <> 0")


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BATCH_LOSSES, "lineitem")
