"""Ordinary input that once came out wrong."""

from __future__ import annotations

import pytest

from pageloom.functions import markup, media, naming, urls
from pageloom.operators import clean
from pageloom.operators.lookup import salted_lookup

RUN = "timestamp_ntz'2025-02-02 00:00:00'"


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("2025-01-06T23:30:00-05:00", "2025-01-07 04:30:00"),
        ("Mon, 06 Jan 2025 10:00:00 GMT", "2025-01-06 10:00:00"),
        ("January 6, 2025", "2025-01-06 00:00:00"),
        ("2025-01-06 10:00:00", "2025-01-06 10:00:00"),
    ],
)
def test_published_times(value, given, expected):
    assert str(value(naming.published_at("t", RUN), t=given)) == expected


def test_unreadable_time_is_null(value):
    assert value(naming.published_at("t", RUN), t="soon") is None


@pytest.mark.parametrize("url", ["about:blank", "mailto:a@b.example", "data:text/plain,x"])
def test_addresses_without_a_host_are_valid(value, url):
    assert value(urls.short_host("u"), u=url) == ""


def test_text_that_is_no_address_has_no_host(value):
    assert value(urls.short_host("u"), u="not an address") is None


@pytest.mark.parametrize("address", ["java\tscript:alert(1)", "\x01javascript:alert(1)", "java\nscript:x", " javascript:x"])
def test_scripts_in_disguise_are_not_safe(value, address):
    assert value(clean.is_safe("'area'", "'href'", "v"), v=address) is False


def test_named_references(value):
    assert value(markup.unescape("t"), t="&Uuml;&oacute;&aring;&frac12; &unknown;") == "Üóå½ &unknown;"


@pytest.mark.parametrize(("url", "kind"), [("a/b.tiff", "image/tiff"), ("b.wav?x=1", "audio/wav"), ("c.mov", "video/quicktime")])
def test_media_types(value, url, kind):
    assert value(media.media_type("u"), u=url) == kind


def test_salt_is_in_the_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id as page_id", "if(id % 10 = 0, cast(id as string), 'hot') as url")
        table = spark.createDataFrame([("hot", 1), ("10", 2)], "url string, v int")
        joined = salted_lookup(rows, table, "url", "page_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(salted_key" in plan
        assert joined.filter("v = 1").count() == 900 and joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
