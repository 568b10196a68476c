"""Agent transcripts and quiz answers as streams (2.15): the same rows as in batch, late and repeated ones handled by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.sources.patches import parse_transcripts


def stream_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """parse_transcripts of JSONL files as they come into a folder, with their time `at`; seq is null, since a stream has no order but that of time. Rows without a time are left out."""
    raw = spark.readStream.text(folder).select("value", F.input_file_name().alias("session"), F.lit(None).cast("long").alias("seq"))
    return parse_transcripts(raw).withColumn("at", F.try_to_timestamp("ts")).where("at IS NOT NULL")


def activity(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """start, end, session, role, n of each window of time; events that come more than `late` behind the latest are dropped, as a watermark has it."""
    per = events.withWatermark("at", late).groupBy(F.window("at", width), "session", "role").agg(F.count("*").alias("n"))
    return per.select("window.start", "window.end", "session", "role", "n")


def answers_once(answers: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Answers (key, at, ...), each once: the same key again within `late` is the same answer seen on a later run."""
    return answers.withWatermark("at", late).dropDuplicatesWithinWatermark(key)
