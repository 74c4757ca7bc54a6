"""The tables of a folder as the inputs of the operators.

Deliveries are not exactly once: rows that come twice, equal in all columns,
count once.  Rows without their key are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, writer, tick, layer, valid_from, valid_to, supersedes) from memories."""
    m = table(spark, folder, "memories").where("id IS NOT NULL").select("id", "text", "writer", "tick").distinct()
    return m.select(
        "id",
        F.col("text").alias("content"),
        "writer",
        "tick",
        F.lit(0).alias("layer"),
        F.col("tick").alias("valid_from"),
        F.lit(None).cast("long").alias("valid_to"),
        F.lit(None).cast("long").alias("supersedes"),
    )


def record_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, tick) of the records: their texts are neither read nor moved."""
    return table(spark, folder, "memories").where("id IS NOT NULL").select("id", "tick").distinct()


def record_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, tick, bytes): the size is taken where the text is read."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("writer"), F.lit(0))
    return table(spark, folder, "memories").where("id IS NOT NULL").select("id", "tick", size.alias("bytes")).distinct()


def assoc_log(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, a, b, tick) as delivered, repeated rows included."""
    return table(spark, folder, "associations").where("id IS NOT NULL").select(F.col("id").alias("seq"), "a", "b", "tick")


def assoc_events(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, a, b, tick) from associations."""
    return table(spark, folder, "associations").where("id IS NOT NULL").select(F.col("id").alias("seq"), "a", "b", "tick").distinct()


def turn_content(date: Column, speaker: Column, text: Column, caption: Column) -> Column:
    """``[date] speaker: text [Image caption: caption]``; missing parts are left out."""
    part = lambda *c: F.coalesce(F.concat(*c), F.lit(""))
    return F.concat(part(F.lit("["), date, F.lit("] ")), part(speaker, F.lit(": ")), part(text), part(F.lit(" [Image caption: "), caption, F.lit("]")))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus, id, tick, dia_id, speaker, body, content): turns of each conversation, ids from 1 in order of session and turn."""
    t = table(spark, folder, "dialogue_turns").where("sample_id IS NOT NULL AND dia_id IS NOT NULL").distinct()
    order = Window.partitionBy("sample_id").orderBy("session_no", "turn_no", "dia_id")
    return t.select(
        F.col("sample_id").alias("corpus"),
        F.row_number().over(order).cast("long").alias("id"),
        F.col("session_no").cast("long").alias("tick"),
        "dia_id",
        "speaker",
        F.coalesce("text", F.lit("")).alias("body"),
        turn_content(F.col("session_date_time"), F.col("speaker"), F.col("text"), F.col("blip_caption")).alias("content"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, corpus, query, answer, evidence, category)."""
    q = table(spark, folder, "dialogue_questions").where("question_id IS NOT NULL AND sample_id IS NOT NULL")
    return q.select(F.col("question_id").alias("query_id"), F.col("sample_id").alias("corpus"), F.coalesce("question", F.lit("")).alias("query"), "answer", "evidence", "category")


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """(basket, node, tick): the parts of each order, ids from 1, tick the day of the order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, folder, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("tick"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("basket"), (F.col("l_partkey") + 1).alias("node"), "tick").distinct()
