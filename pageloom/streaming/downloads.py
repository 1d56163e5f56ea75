"""Download logs as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.functions.logs import error_class, size_mib
from pageloom.operators.downloads import log_events

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "download_id bigint, attempt int, status string"
BREACH = "download_id bigint, attempt int, at bigint, size_mib double"
#: An attempt or a download of which nothing is heard for so long is forgotten.
IDLE = "7 days"


def progress_stream(log: DataFrame) -> DataFrame:
    """Parsed events and progress records; the batch operator works on a stream as it is."""
    return log_events(log)


def _idle_ms(rows: DataFrame, idle: str) -> int:
    """Milliseconds of an interval written as Spark writes it."""
    return int(rows.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {idle})").first()[0])


class _Timer:
    """One event-time timer of a key. It fires when the watermark has passed, so what comes for the key later is late and dropped."""

    def __init__(self, handle: StatefulProcessorHandle, idle_ms: int) -> None:
        self.handle, self.idle_ms = handle, idle_ms

    def move(self, seen_ms: int, ended: bool, now_ms: int) -> None:
        """To the last thing seen where that ended it, else to a long silence after it. Small moves are left out."""
        due = max(seen_ms + 1 if ended else seen_ms + self.idle_ms, now_ms + 1)
        held = list(self.handle.listTimers())
        if not ended and held and due - held[0] < self.idle_ms // 8:
            return
        for old in held:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)


class OversizeLatch(StatefulProcessor):
    """Per attempt: whether it has fired, and when it ended. The state goes when the watermark has passed the end, or after silence."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latch", "fired boolean, ended boolean, seen bigint")
        self.timer = _Timer(handle, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired, ended, seen = self.state.get() if self.state.exists() else (False, False, 0)
        first = None
        for frame in rows:
            seen = max(seen, int(frame["at"].max()) // 1000)
            ended = ended or bool((frame["what"] == "end").any())
            breaches = frame[frame["what"] == "breach"]
            if not fired and len(breaches):
                found = breaches.sort_values(["at", "size_mib"]).iloc[0]
                if first is None or found["at"] < first["at"]:
                    first = found
        self.state.update((fired or first is not None, ended, seen))
        self.timer.move(seen, ended, timerValues.getCurrentWatermarkInMs())
        if first is not None:
            yield pd.DataFrame([(key[0], key[1], int(first["at"]), float(first["size_mib"]))], columns=["download_id", "attempt", "at", "size_mib"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def oversize_latch(log: DataFrame, formats: DataFrame, cap: int, delay: str = "1 hour", idle: str = IDLE) -> DataFrame:
    """First report over the cap of every attempt but the last of its download, once per attempt.

    ``formats`` (``download_id, last_attempt``) is static. Only breaches and ends of attempts (``[close]``, ``[error]`` lines) reach the
    shuffle. A running attempt stays latched however long it reports; its state goes once the watermark, ``delay`` behind the
    newest row, has passed its end, since rows from before are late then and dropped. An attempt without an end is forgotten
    after ``idle`` without a breach.
    """
    what = f"case when event_type = 'download' and {size_mib('event_data')} > {cap} then 'breach' when event_type in ('close', 'error') then 'end' end"
    events = (
        log_events(log.withWatermark("ts", delay))
        .selectExpr("download_id", "attempt", "ts", "unix_micros(ts) as at", f"{what} as what", f"{size_mib('event_data')} as size_mib")
        .filter("what is not null")
        .join(formats, "download_id")
        .filter("attempt < last_attempt")
        .select("download_id", "attempt", "ts", "at", "what", "size_mib")
    )
    return (
        events.groupBy("download_id", "attempt")
        .transformWithStateInPandas(
            statefulProcessor=OversizeLatch(_idle_ms(log, idle)), outputStructType=BREACH, outputMode="Append", timeMode="EventTime"
        )
        .selectExpr("download_id", "attempt", "timestamp_micros(at) as ts", "size_mib")
    )


def attempt_events(log: DataFrame, formats: DataFrame, cap: int) -> DataFrame:
    """Rows that can move a download on: breaches of the cap, and the end of an attempt.

    An attempt ends with a line ``[close]`` or ``[error] message``. Plain progress is dropped here, before
    the shuffle.
    """
    events = log_events(log).join(formats, "download_id")
    what = (
        f"case when event_type = 'download' and {size_mib('event_data')} > {cap} and attempt < last_attempt then 'breach'"
        f" when event_type = 'close' then 'close' when event_type = 'error' then {error_class('event_data')} end"
    )
    return events.selectExpr(
        "download_id", "attempt", "last_attempt", "ts", "unix_millis(ts) as at", f"{what} as what"
    ).filter("what is not null")


class AttemptState(StatefulProcessor):
    """Per download: the running attempt, and what is known of it and of later ones.

    What is known of an attempt goes when the download moves on; all state goes once the watermark has passed the last thing
    heard of a finished download, or after a long silence.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "attempt int, status string, seen bigint")
        self.known = handle.getMapState("known", "attempt int", "breach boolean, ended string")
        self.timer = _Timer(handle, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, status, seen = self.current.get() if self.current.exists() else (0, "running", 0)
        last = 0
        news: dict[int, list] = {}
        for frame in rows:
            last, seen = max(last, int(frame["last_attempt"].max())), max(seen, int(frame["at"].max()))
            breached = frame.loc[frame["what"] == "breach", "attempt"].unique()
            for tried in breached:
                news.setdefault(int(tried), [False, None])[0] = True
            for tried, what in frame.loc[frame["what"] != "breach", ["attempt", "what"]].drop_duplicates().itertuples(index=False):
                news.setdefault(int(tried), [False, None])[1] = what
        out = []
        if status == "running":
            for tried, (breach, ended) in news.items():
                if tried < attempt:
                    continue  # It has moved on from there.
                if self.known.containsKey((tried,)):
                    old = self.known.getValue((tried,))
                    breach, ended = breach or old[0], ended or old[1]
                self.known.updateValue((tried,), (breach, ended))
            while status == "running" and self.known.containsKey((attempt,)):
                breach, ended = self.known.getValue((attempt,))
                if not ended:
                    break
                self.known.removeKey((attempt,))
                if (ended == "close" and breach) or ended == "unavailable":
                    status = "running" if attempt < last else "failed"
                    attempt += 1 if attempt < last else 0
                else:
                    status = "done" if ended == "close" else "failed"
                out.append((key[0], attempt, status))
            if status != "running":
                self.known.clear()
        self.current.update((attempt, status, seen))
        self.timer.move(seen, status != "running", timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=["download_id", "attempt", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.current.clear()
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def attempt_status(log: DataFrame, formats: DataFrame, cap: int, delay: str = "1 hour", idle: str = IDLE) -> DataFrame:
    """Changes of every download: next attempt (``running``), ``done`` or ``failed``.

    A finished download is remembered until the watermark (``delay`` behind the newest row) has passed the last row seen of it, a
    silent one for ``idle``; then its state is gone.
    """
    return (
        attempt_events(log.withWatermark("ts", delay), formats, cap)
        .groupBy("download_id")
        .transformWithStateInPandas(
            statefulProcessor=AttemptState(_idle_ms(log, idle)), outputStructType=STATUS, outputMode="Append", timeMode="EventTime"
        )
    )
