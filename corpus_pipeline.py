"""The corpus pipeline: stages over documents, each written and read again by the next.

1. toxicity: documents that the judge rejects go.
2. near duplicates: of texts alike in their five-word shingles (0.8 or more) the smallest doc_id stays.
3. repeated substrings: bytes that a 100-byte string before them repeats go from the texts.
4. mixing: sources are brought to their target weights; a document taken twice comes twice, one not taken goes.
5. tokens: SentencePiece ids of what is left, as digests.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import mixing, piece_codec, simhash, suffix_dedup, toxicity
from turnlake.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted clean. All rows of an id go if one of them is rejected; null ids are one id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = toxicity.scored(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]), "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose doc_id names it. Rows of one id stay or go together."""
    groups = simhash.near_duplicates(docs)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without what they repeat; n_chars is counted again. Documents left empty stay, empty."""
    cut = suffix_dedup.deduplicated(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("clean_text").alias("text"), "lang", "source",
                      F.char_length("clean_text").cast("long").alias("n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its taken words fill its size, rounded; words taken in part count as half or more."""
    taken = mixing.mixed(docs).filter("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    # Rows of an id are one document here, so its rows go on together.
    times = taken.groupBy("doc_id").agg(F.max("_times").alias("_times")).filter("_times > 0")
    return docs.join(times, "doc_id").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return piece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Sketches, scores and tokens have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
