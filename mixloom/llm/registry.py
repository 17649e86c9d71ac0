"""Registered queries of the operators and of the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mixloom.cluster import shared_dir
from mixloom.llm import anchors, bpe, chat, decontaminate, divergence, html, jaccard, language, quality, search
from mixloom.llm import statements, tokens, toxicity, urls

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf, "benchmark").select("item_id", "text"))


def op2_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.digests(docs, public_tokenizers.path(WORD_TOKENIZER))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_chat_formatting(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.chat_digests(chat.format_chat(turns.unionByName(more)))


def op5_quality_rules(spark, sf):
    judged = quality.quality(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op6_toxicity(spark, sf):
    shared_dir(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_url_filter(spark, sf):
    judged = urls.url_verdicts(table(spark, sf, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op8_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path(BYTE_TOKENIZER)).drop("text")


def op9_jaccard_join(spark, sf):
    return jaccard.jaccard_groups(table(spark, sf, "documents").select("doc_id", "text"))


def op10_html_extraction(spark, sf):
    return html.extract(table(spark, sf, "pages").select("page_id", "url", "html")).drop("html")


def op11_simhash_dedup(spark, sf):
    return anchors.simhash_groups(table(spark, sf, "documents").select("doc_id", "text"))


def op12_ranked_search(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return search.search(docs, table(spark, sf, "benchmark").select("item_id", "text"))


def op13_source_divergence(spark, sf):
    return divergence.divergence(table(spark, sf, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_bpe": op2_bpe,
        "op3_language_id": op3_language_id,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_url_filter": op7_url_filter,
        "op8_token_counts": op8_token_counts,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_html_extraction": op10_html_extraction,
        "op11_simhash_dedup": op11_simhash_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": statements.SEARCH, "op13_source_divergence": statements.DIVERGENCE}
