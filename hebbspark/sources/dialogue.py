"""Dialogue files: conversations with numbered sessions and question lists, and plain fact lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "dia_id: string, speaker: string, text: string, blip_caption: string"
SAMPLE = "sample_id string, conversation map<string, string>, qa array<struct<question: string, answer: string, evidence: array<string>, category: int>>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation from a JSON array of samples; sessions stay text until their number is known."""
    return spark.read.schema(SAMPLE).json(path, multiLine=True)


def turns(samples: DataFrame) -> DataFrame:
    """(sample_id, session_no, turn_no, dia_id, speaker, text, blip_caption, session_date_time), sessions in numeric order."""
    parts = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "value")).where(F.col("key").rlike(r"^session_\d+$"))
    listed = parts.select(
        "sample_id",
        F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session_no"),
        F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("session_date_time"),
        F.posexplode(F.from_json("value", f"array<struct<{TURN}>>")).alias("pos", "t"),
    )
    return listed.select("sample_id", "session_no", (F.col("pos") + 1).alias("turn_no"), "t.dia_id", "t.speaker", "t.text", "t.blip_caption", "session_date_time")


def questions(samples: DataFrame) -> DataFrame:
    """(sample_id, position, question, answer, evidence, category)."""
    return samples.select("sample_id", F.posexplode("qa").alias("position", "q")).select("sample_id", "position", "q.question", "q.answer", "q.evidence", "q.category")


def facts(spark: SparkSession, path: str, per_tick: int = 6) -> DataFrame:
    """(id, content, writer, tick) from a JSON array of strings; the tick rises every ``per_tick`` facts."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "content"))
    return rows.select((F.col("pos") + 1).cast("long").alias("id"), "content", F.lit(None).cast("string").alias("writer"), F.floor(F.col("pos") / per_tick).alias("tick"))
