"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

RETRIEVAL = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("legible", T.StringType()),
    T.StructField("results", T.DoubleType()),
    T.StructField("sentences", T.StringType()),
    T.StructField("page", T.StringType()),
])

GOLD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("policy", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("sentences", T.StringType()),
    T.StructField("class", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
