"""Readers and writers: keyed JSON lines, checked CSV, commented lists, content-keyed queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def keyed_json_lines(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """JSON lines with one row per key, the last written (file, then place in it)."""
    rows = spark.read.schema(schema).json(path).withColumn("_f", F.col("_metadata.file_path")).withColumn("_b", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
    last = Window.partitionBy(key).orderBy(F.desc("_f"), F.desc("_b"), F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_f", "_b", "_n", "_r")


def tolerant_json_lines(spark: SparkSession, path: str, schema: StructType | str, labels: list[str] | None = None) -> DataFrame:
    """JSON lines without those that do not parse; with labels, only rows that have one of them."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if labels is None else rows.where(F.col("label").isin(labels))


def checked_csv(spark: SparkSession, path: str, required: list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV of strings with a header that has all required columns; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def decoded_csv(spark: SparkSession, path: str, required: list[str], encoding: str) -> DataFrame:
    """As checked_csv for encodings that Spark's own reader lacks: whole files, decoded and parsed on the executors."""
    import csv

    raw = spark.read.format("binaryFile").load(path).select("content")
    head = F.substring_index(F.decode(F.substring("content", 1, 1 << 16), "ISO-8859-1"), "\n", 1)  # bytes as they are: a line end is one byte in these encodings
    first = raw.select(head.alias("h")).first()[0].encode("latin-1").decode(encoding).rstrip("\r")
    header = [c.lstrip("\ufeff") for c in next(csv.reader([first]))]
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def parse(frames):
        import io

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode(encoding))))[1:]
                yield pd.DataFrame([(r + [None] * len(header))[: len(header)] for r in rows if r], columns=header, dtype=object)

    return raw.mapInPandas(parse, ", ".join(f"`{c}` string" for c in header))


def csv_in_either(spark: SparkSession, path: str, required: list[str], second: str = "cp950") -> DataFrame:
    """checked_csv, or decoded_csv in a second encoding if the header is not right in UTF-8."""
    try:
        return checked_csv(spark, path, required)
    except ValueError:
        return decoded_csv(spark, path, required, second)


def commented_table(spark: SparkSession, path: str, schema: str = "domain string, listed_since string") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def commented_list(spark: SparkSession, path: str, name: str = "domain") -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select(line.alias(name)).where((F.col(name) != "") & ~F.startswith(name, F.lit("#")))


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON documents with their file name; what does not parse is null."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("doc"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_once(df: DataFrame, path: str, format: str = "json") -> None:
    """Fails if the target is there."""
    df.write.mode("errorifexists").format(format).save(path)


def content_key(*columns: str):
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24)


def enqueue(new: DataFrame, queue: str, key_columns: list[str]) -> int:
    """Append the rows whose content key the queue does not have; returns how many there were."""
    spark = new.sparkSession
    keyed = new.withColumn("queue_key", content_key(*key_columns)).dropDuplicates(["queue_key"])
    try:
        keyed = keyed.join(spark.read.parquet(queue).select("queue_key"), "queue_key", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    keyed = keyed.persist()
    n = keyed.count()
    keyed.write.mode("append").parquet(queue)
    keyed.unpersist()
    return n
