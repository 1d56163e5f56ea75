from datetime import datetime, timedelta

import pytest

from pageloom.operators import downloads
from pageloom.plans.corpus import Corpus
from pageloom.sources.pages import parse_media_info, read_media_info, read_media_log, read_pages, stream_pages, with_requests
from pageloom.streaming import downloads as live
from pageloom.streaming import pages as live_pages

RUN_TS = "2025-01-06 00:00:00"
CAP, LAST = 100, 2


def run(stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return stream.sparkSession.table(name)


LINES = {
    # Oversized first attempt, then a good one.
    1: [(0, "[download]  1.0% of 500.00MiB at 1.00MiB/s"), (0, "[download]  2.0% of 501.00MiB"), (0, "[close]"), (1, "[download] 5.0% of 9.00MiB"), (1, "[close]")],
    # Not available twice; the last attempt has no cap.
    2: [(0, "[error] Requested format is not available."), (1, "[error] Requested format is not available."), (2, "[download] 1.0% of 9.00GiB"), (2, "[close]")],
    # Another error.
    3: [(0, "[info] x\r[download] 1.0% of 2.00MiB"), (0, "[error] boom")],
    # Never ends.
    4: [(0, "[download] 1.0% of 2.00MiB"), (0, "plain")],
    5: [(a, "[error] Requested format is not available.") for a in range(3)],
}


@pytest.fixture
def log_folder(tmp_path):
    rows = [(d, a, f"2024-01-01 00:00:{i:02d}", line) for d, lines in LINES.items() for i, (a, line) in enumerate(lines)]
    folder = tmp_path / "log"
    folder.mkdir()
    for part in range(3):
        text = "\n".join("\t".join(map(str, (d, a, ts, line))) for d, a, ts, line in rows[part::3])
        (folder / f"part-{part}.txt").write_bytes((text + "\n").encode())
    return str(folder)


@pytest.fixture
def formats(spark):
    return spark.createDataFrame([(d, LAST) for d in LINES], "download_id long, last_attempt int")


def test_progress_stream_equals_batch(spark, log_folder, tmp_path):
    batch = downloads.log_events(read_media_log(spark.read, log_folder)).collect()
    stream = run(live.progress_stream(read_media_log(spark.readStream, log_folder)), tmp_path, "progress").collect()
    assert len(batch) > 5 and sorted(map(str, batch)) == sorted(map(str, stream))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(live.STATE_STORE, None)
    spark.conf.set(live.STATE_STORE, live.ROCKSDB)
    yield
    if before:
        spark.conf.set(live.STATE_STORE, before)
    else:
        spark.conf.unset(live.STATE_STORE)


def test_oversize_latch_equals_batch(spark, rocks, log_folder, formats, tmp_path):
    latch = live.oversize_latch(read_media_log(spark.readStream.option("maxFilesPerTrigger", 1), log_folder), formats, CAP)
    rows = {(r.download_id, r.attempt, str(r.ts)) for r in run(latch, tmp_path, "latch").collect()}
    batch = downloads.oversize_breaches(read_media_log(spark.read, log_folder), CAP, LAST).collect()
    assert {r[:2] for r in rows} == {(r.download_id, r.attempt) for r in batch} == {(1, 0)}
    assert rows <= {(1, 0, "2024-01-01 00:00:00"), (1, 0, "2024-01-01 00:00:01")}


class Feed:
    """A log folder that grows by one file for each run of a query with one checkpoint."""

    def __init__(self, spark, folder, make, name):
        self.spark, self.folder, self.make, self.name, self.files = spark, folder, make, name, 0
        (folder / "log").mkdir()

    def __call__(self, *lines):
        """Rows that come of more lines (download, attempt, minute, text), and the state rows that stay."""
        text = "".join(f"{d}\t{a}\t{datetime(2024, 1, 1) + timedelta(minutes=m)}\t{line}\n" for d, a, m, line in lines)
        (self.folder / "log" / f"{self.files}.txt").write_text(text)
        self.files += 1
        stream = self.make(read_media_log(self.spark.readStream, str(self.folder / "log")))
        out = str(self.folder / "out")
        query = (
            stream.writeStream.format("parquet").option("path", f"{out}").option("checkpointLocation", str(self.folder / "ckpt"))
            .trigger(availableNow=True).start()
        )
        assert query.awaitTermination(300)
        rows = [tuple(r) for r in self.spark.read.schema(stream.schema).parquet(out).collect()]
        kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return rows, kept[-1]


BIG = "[download] 1.0% of 500.00MiB"


def test_latch_fires_once_however_slow_and_ends(spark, rocks, tmp_path):
    formats = spark.createDataFrame([(d, LAST) for d in range(20)], "download_id long, last_attempt int")
    feed = Feed(spark, tmp_path, lambda log: live.oversize_latch(log, formats, CAP, "10 minutes", "10 hours"), "slow")
    rows, kept = feed((1, 0, 0, BIG), (2, 0, 0, BIG), (3, 0, 1, "[close]"), (4, 2, 0, BIG))
    assert {r[0] for r in rows} == {1, 2} and kept > 0
    # Hours later, the attempt still runs; restarted from its checkpoint the latch holds. A late row of another is dropped.
    rows, _ = feed((1, 0, 300, BIG), (2, 0, 301, "[close]"), (5, 0, 302, "[close]"), (5, 0, 299, BIG))
    assert sorted(r[0] for r in rows) == [1, 2, 5]
    rows, _ = feed((2, 0, 2, BIG), (3, 0, 0, BIG), (1, 0, 330, "[error] x"))
    assert sorted(r[0] for r in rows) == [1, 2, 5]
    # The watermark passes all ends: nothing is left but the attempt that has just begun.
    rows, _ = feed((6, 0, 400, BIG))
    rows, kept = feed((6, 0, 401, "[close]"), (7, 0, 500, "[close]"))
    assert sorted(r[0] for r in rows) == [1, 2, 5, 6]
    rows, kept = feed((8, 0, 900, "[info] x"), (8, 0, 1900, "plain"))
    rows, kept = feed((8, 0, 1901, "[info] x"))
    assert len(rows) == 4 and kept == 0


def test_a_silent_attempt_is_forgotten(spark, rocks, tmp_path):
    formats = spark.createDataFrame([(d, LAST) for d in range(20)], "download_id long, last_attempt int")
    feed = Feed(spark, tmp_path, lambda log: live.oversize_latch(log, formats, CAP, "1 minute", "2 hours"), "silent")
    assert feed((1, 0, 0, BIG))[1] > 0
    feed((2, 0, 300, "[info] x"))
    rows, kept = feed((2, 0, 301, "[info] x"))
    assert [r[0] for r in rows] == [1] and kept == 0


def test_attempt_state(spark, rocks, log_folder, formats, tmp_path):
    status = live.attempt_status(read_media_log(spark.readStream.option("maxFilesPerTrigger", 1), log_folder), formats, CAP)
    rows = [tuple(r) for r in run(status, tmp_path, "attempts").collect()]
    assert sorted(rows) == [
        (1, 1, "done"), (1, 1, "running"), (2, 1, "running"), (2, 2, "done"), (2, 2, "running"), (3, 0, "failed"),
        (5, 1, "running"), (5, 2, "failed"), (5, 2, "running"),
    ]


def test_attempt_state_survives_restarts_and_ends(spark, rocks, tmp_path):
    formats = spark.createDataFrame([(d, LAST) for d in range(20)], "download_id long, last_attempt int")
    feed = Feed(spark, tmp_path, lambda log: live.attempt_status(log, formats, CAP, "10 minutes", "10 hours"), "states")
    assert feed((1, 0, 0, BIG), (2, 0, 0, "[close]"), (3, 1, 0, "[close]"))[0] == [(2, 0, "done")]
    rows, _ = feed((1, 0, 5, "[close]"), (1, 1, 6, BIG), (2, 0, 6, "[error] late"))
    assert sorted(rows) == [(1, 1, "running"), (2, 0, "done")]
    # What was heard of a later attempt before counts when its turn comes.
    rows, kept = feed((1, 1, 7, "[error] Requested format is not available."), (3, 0, 8, "[error] Requested format is not available."))
    assert sorted(rows) == [(1, 1, "running"), (1, 2, "running"), (2, 0, "done"), (3, 1, "done"), (3, 1, "running")] and kept > 0
    rows, _ = feed((1, 2, 20, BIG), (1, 2, 21, "[close]"))
    assert (1, 2, "done") in rows
    feed((9, 0, 1900, "[info] x"))
    rows, kept = feed((9, 0, 1901, "[info] x"))
    assert len(rows) == 6 and kept == 0


@pytest.fixture
def page_folder(spark, tmp_path):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet").limit(6)
    pages.repartition(2, "page_id").write.parquet(str(tmp_path / "pages"))
    return str(tmp_path / "pages")


def test_page_heads(spark, page_folder, tmp_path):
    stream = run(live_pages.page_heads(stream_pages(spark, page_folder)), tmp_path, "heads").collect()
    batch = live_pages.page_heads(read_pages(spark, page_folder)).collect()
    assert len(batch) == 6 and sorted(map(str, batch)) == sorted(map(str, stream))
    attrs = run(live_pages.page_attributes(stream_pages(spark, page_folder)), tmp_path, "attrs")
    assert attrs.count() > 0


@pytest.fixture
def twin_folder(spark, tmp_path):
    """Pages in four files whose titles repeat across files, so that later batches replace earlier articles."""
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet").limit(4).collect()
    made = []
    for part in range(4):
        rows = [(10 * part + i, f"https://s.example/{10 * part + i}", p.html) for i, p in enumerate(pages[: 4 - part])]
        rows += [(10 * part + 9, None, "x")]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        made += rows
    return str(tmp_path / "pages")


def test_two_batches_are_one_run(spark, twin_folder, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    options = dict(defaults={"create_subfolders": "true"})
    query = live_pages.convert_stream(stream_pages(spark, twin_folder, 1), out, ckpt, RUN_TS, compact_every=2, **options)
    assert query.awaitTermination(600) and query.exception() is None
    assert live_pages._batches(spark, f"{out}/winners") == [0, 1, 2, 3] and live_pages._batches(spark, f"{out}/winners_merged") == [1, 3]
    corpus = Corpus(spark, read_pages(spark, twin_folder), RUN_TS, **options)
    for name, rows in corpus.outputs().items():
        live_rows = live_pages.read_converted(spark, out, name)
        columns = sorted(rows.columns)
        assert sorted(map(repr, live_rows.select(columns).collect())) == sorted(map(repr, rows.select(columns).collect())), name
    assert corpus.articles.filter("not is_latest").count() == 6
    before = sorted(map(repr, live_pages.read_converted(spark, out).collect()))
    # A batch that runs again, also one that merges, changes nothing.
    commits = tmp_path / "ckpt" / "commits"
    for file in commits.glob("*3*"):
        file.unlink()
    query = live_pages.convert_stream(stream_pages(spark, twin_folder, 1), out, ckpt, RUN_TS, compact_every=2, **options)
    assert query.awaitTermination(600) and query.exception() is None
    assert sorted(map(repr, live_pages.read_converted(spark, out).collect())) == before
    corpus.release()


def test_convert_stream_equals_batch(spark, page_folder, tmp_path):
    out = str(tmp_path / "out")
    query = live_pages.convert_stream(stream_pages(spark, page_folder), out, str(tmp_path / "ckpt"), RUN_TS)
    assert query.awaitTermination(300)
    columns = ["page_id", "title", "output_path", "content_sha256"]
    live_rows = live_pages.read_converted(spark, out).select(*columns).collect()
    corpus = Corpus(spark, read_pages(spark, page_folder), RUN_TS)
    assert sorted(live_rows) == sorted(corpus.articles.select(*columns).collect())
    corpus.release()
    with pytest.raises(ValueError):
        live_pages.read_converted(spark, str(tmp_path / "none"))


def test_carriage_returns_part_events(spark, log_folder):
    rows = downloads.log_events(read_media_log(spark.read, log_folder)).filter("download_id = 3").orderBy("line_no").collect()
    assert [(r.line, r.event_type) for r in rows if r.event_type != "error"] == [("[info] x", "info"), ("[download] 1.0% of 2.00MiB", "download")]


def test_media_info(spark, tmp_path):
    lines = '{"id": "a", "duration": 1.5, "other": 1}\n{"id": "b"}\nnot json\n'
    (tmp_path / "info.json").write_text(lines)
    rows = read_media_info(spark, str(tmp_path / "info.json"), whole_files=False).collect()
    assert [r.id for r in rows] == ["a", "b", None] and rows[2]["_corrupt_record"] == "not json"
    # One call reads whole objects and lines.
    folder = tmp_path / "infos"
    folder.mkdir()
    (folder / "1.json").write_text(lines)
    (folder / "2.json").write_text('{\n  "id": "c",\n  "formats": [\n    {"format_id": "18"},\n    {"format_id": "22"}\n  ]\n}\n')
    (folder / "3.json").write_text('{"id": "d"}')
    (folder / "4.json").write_text("")
    (folder / "5.json").write_text("oops\n{")
    rows = read_media_info(spark, str(folder)).collect()
    assert sorted(r.id or "" for r in rows) == ["", "", "a", "b", "c", "d"]
    assert sorted(r["_corrupt_record"] for r in rows if r["_corrupt_record"]) == ["not json", "oops\n{"]
    assert {r.id: r.duration for r in rows}["a"] == 1.5
    texts = spark.createDataFrame([(1, '{"id": "a"}\n{"id": "b", "ext": "mp4"}\n'), (2, '{"id": "c"}'), (3, '{\n"id": "d"}'), (4, None)], "n int, json string")
    assert sorted((r.n, r.info.id) for r in parse_media_info(texts).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_requests_override_defaults(spark):
    pages = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "page_id long, url string")
    requests = spark.createDataFrame(
        [("u", None, "p", True, "c.png", None, "best", 5)],
        "url string, output string, path string, create_subfolders boolean, cover string, download_media boolean, media_format string, target_file_size int",
    )
    rows = {r.page_id: r for r in with_requests(pages, requests, {"download_media": "true", "path": "'d'"}).collect()}
    assert (rows[1].path, rows[1].create_subfolders, rows[1].download_media, rows[1].target_file_size) == ("p", True, True, 5)
    assert (rows[2].path, rows[2].create_subfolders, rows[2].cover) == ("d", False, None)
    assert rows[3].path == "d"
