"""Page tables and streams, per-page requests, media logs and infos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import let
from pageloom.operators.lookup import salted_lookup

REQUEST_DEFAULTS = {
    "output": "cast(null as string)",
    "path": "cast(null as string)",
    "create_subfolders": "false",
    "cover": "cast(null as string)",
    "download_media": "false",
    "media_format": "cast(null as string)",
    "target_file_size": "cast(null as int)",
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_requests(pages: DataFrame, requests: DataFrame | None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Add the options of every page: those requested for its address, else the job's defaults (SQL text).

    One address may be crawled very often, so the join salts it. Of several requests for one address the greatest counts, field
    by field in the order of the columns; pages are never multiplied.
    """
    fallback = {**REQUEST_DEFAULTS, **(defaults or {})}
    slim = pages.select("page_id", "url")
    if requests is None:
        return slim.selectExpr("page_id", "url", *[f"{sql} as {name}" for name, sql in fallback.items()])
    fields = [c for c in requests.columns if c != "url"]
    single = requests.filter("url is not null").groupBy("url").agg(F.max(F.struct(*fields)).alias("r")).select("url", "r.*")
    joined = salted_lookup(slim, single, "url", "page_id")
    return joined.selectExpr("page_id", "url", *[f"coalesce({n}, {sql}) as {n}" for n, sql in fallback.items()])


def read_media_log(source, path: str) -> DataFrame:
    """Log files with lines ``download_id TAB attempt TAB ts TAB line``; ``source`` is spark.read or readStream."""
    parts = "split(value, '\\t', 4)"
    return (
        source.option("lineSep", "\n").text(path)
        .selectExpr(f"{parts} as f")
        .filter("size(f) = 4")
        .selectExpr(
            "try_cast(f[0] as bigint) as download_id", "try_cast(f[1] as int) as attempt",
            "try_cast(f[2] as timestamp) as ts", "f[3] as line",
        )
    )


def read_media_info(spark: SparkSession, path: str, whole_files: bool | None = None) -> DataFrame:
    """Media infos of files: each file is one JSON object, else one object per line; bad ones land in ``_corrupt_record``.

    A file is what the tool printed for one address, a value of one row. For large files of lines pass ``whole_files=False``, for
    large objects ``True``: then nothing is tried, and lines are split over tasks.
    """
    if whole_files is None:
        return parse_media_info(spark.read.text(path, wholetext=True), "value").select("info.*")
    return spark.read.schema(schemas.MEDIA_INFO).option("mode", "PERMISSIVE").option("multiLine", whole_files).json(path)


def parse_media_info(rows: DataFrame, column: str = "json") -> DataFrame:
    """The same from a text column: ``info`` for each object of a text.

    A text whose first line is an object by itself has one per line; any other is one object over its lines. Where neither
    can be read, the text lands whole in ``_corrupt_record``. Empty and null texts give no row.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.MEDIA_INFO.fields)
    info = lambda text: f"from_json({text}, '{fields}', map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_corrupt_record'))"
    lines = f"filter(split({column}, '\\r?\\n'), x -> trim(x) != '')"
    return (
        rows.selectExpr("*", f"{lines} as info_lines")
        .filter("size(info_lines) > 0")
        # By a name, or only that field would be read, and nothing can be wrong with it.
        .selectExpr("*", f"trim(info_lines[0]) like '{{%' and {let(info('info_lines[0]'), 'first', 'first._corrupt_record is null')} as by_line")
        .selectExpr("*", f"explode(if(by_line, info_lines, array(trim({column})))) as info_text")
        .selectExpr(*rows.columns, f"{info('info_text')} as info")
    )
