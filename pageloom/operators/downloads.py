"""Choose among download attempts, from their outcomes or from their logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pageloom.functions import logs, text
from pageloom.functions.vocab import FRAME_FORMATS, QUOTE_FORMATS
from pageloom.operators.lookup import salted_lookup
from pageloom.operators.tree import exprs


def built_in_formats(spark: SparkSession, frames: Sequence[str] = FRAME_FORMATS, quotes: Sequence[str] = QUOTE_FORMATS) -> DataFrame:
    """The formats that frames and quotes try where nobody asks for others: ``kind, prio, format``."""
    rows = [(kind, n, f) for kind, formats in (("frame", frames), ("quote", quotes)) for n, f in enumerate(formats)]
    return spark.sql("select * from values " + ", ".join(f"('{k}', {n}, {text(f)})" for k, n, f in rows) + " as t(kind, prio, format)")


def attempts(embeds: DataFrame, preferences: DataFrame | None = None, spread: str = "page_id") -> DataFrame:
    """The formats to try for every embed, in order: one row per attempt with its container.

    They are the formats that ``media_format`` lists, in its order, else those of ``preferences`` (``kind, prio, format``) for the
    embed's kind, in order of ``prio``; by default the built-in lists. A kind without any has no attempts.
    """
    if preferences is None:
        preferences = built_in_formats(embeds.sparkSession)
    lists = preferences.groupBy("kind").agg(*exprs("array_sort(collect_list(struct(prio, format))).format as preferred"))
    asked = salted_lookup(embeds, lists, "kind", spread)
    listed = "coalesce(split(nullif(media_format, ''), '_'), preferred)"
    return (
        asked.selectExpr("*", f"posexplode({listed}) as (attempt, format)")
        .drop("preferred")
        .selectExpr("*", f"{logs.container('format')} as container")
    )


def wish(url: str) -> str:
    """What a page asks of an address, as one key: the address, the formats asked for, else whose list counts, and the size asked for."""
    formats = "nullif(media_format, '')"
    return f"to_json(struct({url} as url, if({formats} is null, kind, null) as kind, {formats} as media_format, target_file_size))"


def requested_attempts(formats: DataFrame, wishes: DataFrame, cap: str = "null", preferences: DataFrame | None = None) -> DataFrame:
    """Attempts of every wish (``wish, kind, media_url, media_format, target_file_size``), to be walked by ``wish``.

    ``formats`` says what came of a format of an address (``media_url, format, status, size_mib``); one of which it says nothing
    is unavailable, and of repeated rows the earliest attempt counts. ``cap`` becomes the size asked for, else that of the table.
    """
    # The cap of an address holds for its last format too, also where another one is missing from the table.
    known = formats.groupBy("media_url", "format").agg(
        *exprs(f"min(struct(attempt, status, size_mib, cast({cap} as int) as known_cap)) as known")
    )
    rows = attempts(wishes, preferences, "wish").join(known, ["media_url", "format"], "left")
    return rows.selectExpr(
        "wish", "attempt", "format", "coalesce(known.status, 'unavailable') as status", "known.size_mib as size_mib",
        "coalesce(target_file_size, known.known_cap) as cap",
    )


def walk_attempts(formats: DataFrame, cap: str = "null", key: str = "media_url") -> DataFrame:
    """Outcome of trying the formats of every address, or other ``key``, in order.

    ``media_url, outcome, attempt, format, container, size_mib``: unavailable and oversized attempts are passed
    over, but the last one has no cap; an error ends the walk. The first stopping row is a minimum, so one
    aggregation with map-side combining does it, however many rows an address has.
    """
    fits = f"(cast({cap} as int) is null or size_mib <= cast({cap} as int))"
    row = "struct(attempt, status, format, size_mib)"
    return (
        formats.groupBy(key)
        .agg(*exprs(
            f"min(if(status = 'error' or (status = 'ok' and {fits}), {row}, null)) as stop",
            f"max({row}) as final",
        ))
        .selectExpr(key, "coalesce(stop, if(final.status != 'unavailable', final, null)) as hit")
        .selectExpr(
            key,
            "if(hit.status = 'ok', 'chosen', 'failed') as outcome",
            "if(hit.status = 'ok', hit.attempt, null) as attempt",
            "if(hit.status = 'ok', hit.format, null) as format",
            f"if(hit.status = 'ok', {logs.container('hit.format')}, null) as container",
            "if(hit.status = 'ok', hit.size_mib, null) as size_mib",
        )
    )


def log_events(log: DataFrame) -> DataFrame:
    """Split raw chunks into lines and parse them: event type and data, and the progress record."""
    return (
        log.selectExpr("download_id", "attempt", "ts", "posexplode_outer(split(line, r'[\\r\\n]')) as (line_no, line)")
        .filter("length(line) > 0")
        .selectExpr(
            "*",
            f"{logs.event_type('line')} as event_type",
            f"{logs.event_data('line')} as event_data",
            f"{logs.progress('line')} as progress",
        )
        .filter("event_type is not null")
    )


def size_peaks(log: DataFrame) -> DataFrame:
    """Largest size each attempt reported, in MiB."""
    return (
        log_events(log)
        .filter("event_type = 'download'")
        .selectExpr("download_id", "attempt", f"{logs.size_mib('event_data')} as size_mib")
        .filter("size_mib is not null")
        .groupBy("download_id", "attempt")
        .agg(*exprs("max(size_mib) as peak_mib", "count(*) as n_reports"))
    )


def oversize_breaches(log: DataFrame, cap: int, last_attempt: int) -> DataFrame:
    """First report over the cap of every attempt but the last: ``download_id, attempt, ts, size_mib``."""
    return (
        log_events(log)
        .filter("event_type = 'download'")
        .selectExpr("download_id", "attempt", "ts", "line", f"{logs.size_mib('event_data')} as size_mib")
        .filter(f"size_mib > {cap} and attempt < {last_attempt}")
        .groupBy("download_id", "attempt")
        .agg(*exprs("min(struct(ts, line, size_mib)) as b"))
        .selectExpr("download_id", "attempt", "b.ts as ts", "b.size_mib as size_mib")
    )
