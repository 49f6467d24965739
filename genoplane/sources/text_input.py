"""Uploaded text as lines of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed pattern: line breaks of any kind, and commas.
SEPARATORS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|,"


def lines_of(text: Column) -> Column:
    """The lines of a text as an array: split at line breaks and commas, trimmed, without blank lines and comments (#)."""
    return F.filter(F.transform(F.split(text, SEPARATORS), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def normalize_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Adds line, one row for each line of a text."""
    return texts.withColumn("line", F.explode(lines_of(F.col(column))))


def split_text(texts: DataFrame, column: str = "value") -> DataFrame:
    """(line_no, line) of the lines of each text, numbered from 1."""
    return texts.select(F.posexplode(lines_of(F.col(column))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long") + 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of all files under path."""
    return normalize_lines(spark.read.text(path)).select("line")


def checksum(lines: F.Column) -> F.Column:
    """MD5 of an array of lines joined by newlines, in hex without leading zeros."""
    return F.regexp_replace(F.md5(F.concat_ws("\n", lines)), "^0+(?=.)", "")


def store_upload(texts: DataFrame, directory: str, column: str = "value") -> DataFrame:
    """Writes an upload's lines under its checksum, an upload a row of texts; the same text is stored once."""
    made = texts.select(lines_of(F.col(column)).alias("lines")).withColumn("upload_id", checksum(F.col("lines"))).dropDuplicates(["upload_id"])
    made.select("upload_id", F.posexplode("lines").alias("line_no", "line")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(directory)
    return made.select("upload_id", F.size("lines").alias("n_lines"))
