"""Result documents, their index, transcript round trips, and content-keyed skipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake import schema
from turnlake.functions.numbers import round_even
from turnlake.functions.text import strip
from turnlake.sources import runs

# How many hex digits of the content and of the settings a key holds, and the unset setting.
CONTENT_DIGITS, SETTINGS_DIGITS, UNSET = 20, 10, "auto"


# --------------------------------------------------------------------------- results
def write_documents(documents: DataFrame, timeline: DataFrame, path: str, run: str | None = None) -> None:
    """A run of results: JSON lines with one document per session, and with one row per timeline segment.

    A run is a folder of its own, so nothing written before changes; it counts once both tables are written.
    Readers take a session's latest finished run. The number of files follows the data, not the number of sessions.
    """
    spark, run = documents.sparkSession, run or runs.new_run()
    runs.begin(spark, path, run)
    for rows, part in ((documents, "documents"), (timeline, "timeline")):
        rows.withColumn("session_id", F.col("session_id").cast("string")).write.mode("overwrite").option(
            "ignoreNullFields", True).json(f"{path}/{part}/run={run}")
    runs.finish(spark, path, run)


def write_rows(rows: DataFrame, path: str) -> None:
    """Raw report rows as JSON lines, so a report can be rendered again without a re-run."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_rows(spark: SparkSession, path: str, schema_: T.StructType) -> DataFrame:
    """Report rows as they were written."""
    return spark.read.schema(schema_).json(path)


def index_rows(documents: DataFrame) -> DataFrame:
    """Sorted session ids without the index itself, one row each."""
    sid = F.col("session_id").cast("string")
    return documents.select(sid.alias("session_id")).filter(F.col("session_id") != "index").distinct().orderBy("session_id")


def write_index(documents: DataFrame, path: str) -> None:
    index_rows(documents).write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The listed session ids; an index that was never written lists none."""
    return runs.read_or_empty(lambda: spark.read.schema("session_id string").json(path), spark, "session_id string")


def parse_documents(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Documents the index lists; an unreadable one is skipped, an empty index gives nothing.

    ``raw`` has value (JSON text) and maybe columns to carry. The id is the one in the document.
    """
    typed = schema.RESULT.simpleString()[:-1] + ",_bad:string>"
    carried = [c for c in raw.columns if c not in ("session_id", "value")]
    parsed = raw.select(*carried, F.from_json(
        "value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("d"))
    good = parsed.filter(F.col("d").isNotNull() & F.col("d._bad").isNull() & F.col("d.schema_version").isNotNull())
    return good.select(*carried, F.col("d").dropFields("_bad").alias("d")).select(*carried, "d.*").join(
        index.select("session_id"), "session_id", "left_semi")


def read_documents(spark: SparkSession, path: str, index_path: str) -> tuple[DataFrame, DataFrame]:
    """Written documents through their index, and all timeline rows of the documents that were read.

    Of the finished runs the latest that has a readable document of a session counts.
    """
    done = runs.finished(spark, path).select("run")
    raw = runs.read_or_empty(lambda: spark.read.schema("value string, run string").text(f"{path}/documents"), spark, "value string, run string")
    found = parse_documents(raw.join(done, "run", "left_semi").select("value", "run"), read_index(spark, index_path))
    latest = found.groupBy("session_id").agg(F.max("run").alias("run"))
    documents = found.join(latest, ["session_id", "run"], "left_semi").drop("run")
    columns = schema.TIMELINE_ROW.simpleString()[len("struct<"):-1].replace(":", " ") + ", run string"
    rows = runs.read_or_empty(lambda: spark.read.schema(columns).json(f"{path}/timeline"), spark, columns)
    return documents, rows.join(latest, ["session_id", "run"], "left_semi").drop("run")


# --------------------------------------------------------------------------- transcripts
def transcript_heads(transcripts: DataFrame) -> DataFrame:
    """One JSON text per transcript: everything but its segments."""
    return transcripts.select("session_id", F.to_json(F.struct(
        "language", "language_prob", "backend", "model", round_even(F.col("audio_sec"), 3).alias("audio_sec")),
        {"ignoreNullFields": "false"}).alias("value"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """One JSON text per segment, which names its place; times to 3 places. A long transcript is many rows."""
    none = F.lit(None).cast(schema.TRANSCRIPT_LINE["words"].dataType)
    words = none if "words" not in segments.columns else F.when(F.size("words") > 0, F.transform("words", lambda w: F.struct(
        round_even(w["start"], 3).alias("start"), round_even(w["end"], 3).alias("end"), w["word"].alias("word"))))
    return segments.select("session_id", F.to_json(F.struct(
        F.col("seg_ix").cast("long").alias("seg_ix"), round_even(F.col("start"), 3).alias("start"),
        round_even(F.col("end"), 3).alias("end"), "text", "avg_logprob", "no_speech_prob", words.alias("words")),
        {"ignoreNullFields": "false"}).alias("value"))


def transcript_rows(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Segments back from transcript texts; empty word lists are null."""
    head = heads.select("session_id", F.from_json("value", schema.TRANSCRIPT_HEAD).alias("t"))
    rows = lines.select("session_id", F.from_json("value", schema.TRANSCRIPT_LINE).alias("s"))
    return rows.join(head, "session_id").select(
        "session_id", "t.language", "t.backend", "t.model", "t.audio_sec", "s.seg_ix", "s.start", "s.end",
        strip(F.coalesce("s.text", F.lit(""))).alias("text"), "s.avg_logprob", "s.no_speech_prob",
        F.when(F.size("s.words") > 0, F.col("s.words")).alias("words"))


# --------------------------------------------------------------------------- skipping
def content_key(content: Column, *stamp: Column) -> Column:
    """Key of a finished piece of work: what went in, and the settings it ran with."""
    settings = F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit(UNSET)) for s in stamp])
    return F.concat(F.substring(F.sha2(content, 256), 1, CONTENT_DIGITS), F.lit("-"), F.substring(F.sha2(settings, 256), 1, SETTINGS_DIGITS))


def is_readable(value: Column) -> Column:
    """Whether an entry (JSON text with a ``turns`` or ``segments`` array) can be read. An empty result counts, a
    damaged one does not."""
    entry = F.from_json(value, "turns array<struct<start:double,end:double,speaker:string>>, "
                                 "segments array<struct<start:double,end:double,text:string>>")
    return F.coalesce(entry["turns"].isNotNull() | entry["segments"].isNotNull(), F.lit(False))


def pending(work: DataFrame, finished: DataFrame) -> DataFrame:
    """Work whose key has no readable entry among ``finished`` (key, value)."""
    return work.join(finished.filter(is_readable(F.col("value"))).select("key").distinct(), "key", "left_anti")
