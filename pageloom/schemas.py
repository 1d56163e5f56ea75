"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("create_subfolders", T.BooleanType()),
        T.StructField("cover", T.StringType()),
        T.StructField("download_media", T.BooleanType()),
        T.StructField("media_format", T.StringType()),
        T.StructField("target_file_size", T.IntegerType()),
    ]
)

MEDIA_LOG = T.StructType(
    [
        T.StructField("download_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("line", T.StringType()),
    ]
)

FORMATS = T.StructType(
    [
        T.StructField("media_url", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("size_mib", T.IntegerType()),
    ]
)

MEDIA_INFO = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("webpage_url", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
