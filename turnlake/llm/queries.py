"""One query per operator over the given tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import (
    archives, conversation_repair, hard_negatives, mixing, parsing_dedup, piece_codec, quality_model, quality_rules, simhash, suffix_dedup, topk_search, toxicity,
    word_codec,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query(mixing.MIX_SQL)
def op7_source_mixing(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"))


@query(quality_rules.RULES_SQL)
def op2_quality_rules(spark, folder):
    return quality_rules.cleaned(table(spark, folder, "documents")).drop("clean_text")


@query()
def op6_sentencepiece(spark, folder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encoded(table(spark, folder, "documents"), path, ids=False)


@query()
def op3_simhash(spark, folder):
    rows = simhash.grouped(table(spark, folder, "documents"))
    return rows.select("doc_id", simhash.hex_of("fingerprint").alias("fingerprint"), "component_id")


@query()
def op1_suffix_array(spark, folder):
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


@query()
def op5_lempel_ziv(spark, folder):
    return parsing_dedup.deduplicated(table(spark, folder, "documents"))


@query(topk_search.SEARCH_SQL)
def op9_topk(spark, folder):
    return topk_search.search(table(spark, folder, "embeddings"))


@query(archives.ARCHIVE_SQL)
def op8_warc(spark, folder):
    return archives.round_trip(table(spark, folder, "pages")).drop("payload", "url")


@query()
def op10_quality(spark, folder):
    return quality_model.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_toxicity(spark, folder):
    rows = toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))


@query()
def op11_word_bpe(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    return word_codec.encoded(table(spark, folder, "documents"), path, ids=False)


@query(hard_negatives.MINED_SQL)
def op12_hard_negatives(spark, folder):
    return hard_negatives.mined(table(spark, folder, "embeddings"))


@query(conversation_repair.REPAIR_SQL)
def op13_conversation_repair(spark, folder):
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, folder, "conversations")))
