"""Readers of topics: (topic_num, topic_id, text), and ``refine`` where the format has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.sources.collections import read_files

SHORTEST = 5


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(topic_num, value) of the lines of a topic file, which is small: one task numbers them."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("topic_num", "value"))
    return rows.where(F.trim("value") != "")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id text``."""
    parts = F.split("value", " ", 2)
    rows = _lines(spark, path)
    return rows.select("topic_num", parts[0].alias("topic_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id path``: the text is the file's first line, the refining text all of it."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = _lines(spark, path).select("topic_num", parts[0].alias("topic_id"), parts[1].alias("path"))
    whole = read_files(spark, [r["path"] for r in rows.select("path").collect()]).select("path", F.col("text").alias("refine"))
    return rows.join(whole, "path").select("topic_num", "topic_id", F.split("refine", "\n")[0].alias("text"), "refine")


def sentences(text: Column) -> Column:
    """array<struct<begin, text>>: sentences up to each full stop, joined to the next as long as they are shorter than SHORTEST; what
    isn't ASCII counts as one ``?``. begin is the offset in characters; a rest without full stop is left out."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "?")
    return F.aggregate(
        F.regexp_extract_all(plain, F.lit(r"([^.]*\.)"), F.lit(1)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.array().cast("array<struct<begin:int,text:string>>").alias("done")),
        lambda s, x: F.when(
            F.length(F.concat(s["open"], x)) >= SHORTEST,
            F.struct(
                (s["at"] + F.length(F.concat(s["open"], x))).alias("at"),
                F.lit("").alias("open"),
                F.array_append(s["done"], F.struct(s["at"].alias("begin"), F.concat(s["open"], x).alias("text"))).alias("done"),
            ),
        ).otherwise(F.struct(s["at"].alias("at"), F.concat(s["open"], x).alias("open"), s["done"].alias("done"))),
        lambda s: s["done"],
    )


def sentence_topics(texts: DataFrame) -> DataFrame:
    """(topic_num, topic_id, text) of the sentences of running text (value); ids are offsets. Of several rows each has its own."""
    rows = texts.select(F.inline(sentences(F.col("value"))))
    num = F.row_number().over(Window.orderBy("begin")) - 1  # of one text
    return rows.select(num.alias("topic_num"), F.col("begin").cast("string").alias("topic_id"), "text")


def read_running_text(spark: SparkSession, path: str) -> DataFrame:
    return sentence_topics(spark.read.text(path, wholetext=True))


READERS = {"wsj": read_topics, "filelist_rf": read_file_list, "plagdet": read_running_text}


def read(spark: SparkSession, path: str, kind: str = "wsj") -> DataFrame:
    if kind.lower() not in READERS:
        raise ValueError(f"no topic format {kind!r}")
    return READERS[kind.lower()](spark, path)
