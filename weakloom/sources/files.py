"""Readers and writers of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weakloom import schemas

# The CSV dialect of the retrieval table.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def has_suffix(path: Column, suffix: str = ".pdf") -> Column:
    return F.endswith(path, F.lit(suffix))


def list_inputs(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """``(path, length)`` of the files with this suffix; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
            .load(folder).select("path", "length"))


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """``(path, text)``: one row per already extracted document."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.RETRIEVAL, multi_line: bool = True) -> DataFrame:
    """CSV with an explicit schema. The header is skipped; columns are taken by position.

    Quoted fields may hold newlines, which keeps a file from being split. Where none does, ``multi_line=False`` lets one
    big file be read by many tasks.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multi_line, enforceSchema="true").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(
        header="true", quote='"', escape='"', emptyValue='""', nullValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input in few files dealt out to all cores.

    A large input already has more scan partitions than cores and is left as it is, so no
    text is shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Arrays keyed by id."""
    return spark.read.parquet(path)


def write_matrix(df: DataFrame, path: str, key: str, values: str, mode: str = "errorifexists") -> None:
    """``(key, values ARRAY)`` as Parquet; rows are found by key, never by position."""
    df.select(key, values).write.mode(mode).parquet(path)


def write_texts(paragraphs: DataFrame, path: str, doc: str = "doc_id", order: str = "para_id",
                text: str = "text", mode: str = "errorifexists", folders: int | None = None) -> None:
    """One paragraph per line, in paragraph order.

    Without ``folders`` each document has a folder of its own. With it, documents are dealt over so many folders, and a line
    begins with the document's id and a tab, so the number of folders and files does not grow with the documents. Range
    partitioning on document and paragraph splits a very long document over several files, whose names sort in paragraph order.
    """
    if folders is None:
        ordered = paragraphs.repartitionByRange(doc, order).sortWithinPartitions(doc, order)
        ordered.select(doc, F.col(text).alias("value")).write.mode(mode).partitionBy(doc).text(path)
        return
    folder = F.pmod(F.xxhash64(doc), F.lit(folders)).cast("int")
    dealt = paragraphs.withColumn("folder", folder).repartitionByRange("folder", doc, order).sortWithinPartitions("folder", doc, order)
    line = F.concat(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.lit("\t"), F.coalesce(F.col(text), F.lit("")))
    dealt.select("folder", line.alias("value")).write.mode(mode).partitionBy("folder").text(path)


def read_text_folders(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, text)`` of what ``write_texts`` wrote with ``folders``; the id as text, one row per line."""
    lines = spark.read.schema("value string, folder int").text(path)
    place = F.position(F.lit("\t"), "value")
    return lines.select(F.left("value", place - 1).alias("doc"), F.substring("value", place + 1, F.length("value")).alias("text"))


def write_by_country(df: DataFrame, path: str, country: str = "country", mode: str = "errorifexists") -> None:
    """Parquet partitioned by country, so later reads of one country skip the others."""
    df.write.mode(mode).partitionBy(country).parquet(path)
