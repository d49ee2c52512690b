"""Revisits by hand, and against SQL in tests/test_oracle.py."""

import pytest
from pyspark.sql import functions as F

from huestrata.llm import catalog, warc
from tests.llm.helpers import SMALL, table

SCHEMA = "record_id long, url string, at long, status int, headers map<string,string>, body string"


def resolved(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slice", F.lit("clash")).repartition(3)
    return {r.record_id: r for r in warc.resolve_revisits(df, **options).collect()}


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://user@WWW.Example.org:80/A/b/?utm_source=x&b=2&a=1#top", "example.org/A/b?a=1&b=2"),
        ("https://example.org", "example.org"),
        ("https://example.org/", "example.org"),
        ("example.org/x?sid=1", "example.org/x"),
        ("http://m.example.org:8080/?q", "m.example.org:8080?q"),
        (None, None),
        ("", ""),
    ],
)
def test_canonical_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(F.col("u")).alias("c")).first().c == want


@pytest.mark.parametrize("seconds", [1, 7, 3600])
def test_latest_earlier_response(spark, seconds):
    tag = {"etag": '"1"'}
    rows = [
        (1, "http://a.org/", 10, 200, {"etag": '"0"'}, "old"),
        (2, "https://www.a.org", 20, 200, {**tag, "server": "s", "content-length": "3"}, "new"),
        (3, "http://a.org", 20, 304, tag, None),  # not strictly later than 2
        (4, "http://a.org", 21, 304, {"etag": 'W/"1"', "content-length": "0", "server": "t"}, None),
        (5, "http://a.org", 5, 304, tag, None),
        (6, "http://a.org", 9000, 304, {"last-modified": "x"}, None),
        (7, None, 30, 304, tag, None),
        (8, "http://a.org", 8000, 500, tag, "error"),
        (9, "http://a.org", 8001, 200, tag, None),  # no body: not a full response
        (10, "http://a.org", None, 304, tag, None),
    ]
    got = resolved(spark, rows + rows[3:4], slice_seconds=seconds)
    assert {i: (r.resolved_id, r.outcome) for i, r in got.items()} == {
        3: (1, "validator_mismatch"),
        4: (2, "resolved"),
        5: (None, "no_response"),
        6: (2, "no_validator"),
        7: (None, "no_response"),
        10: (None, "no_response"),
    }
    assert got[4].body == "new"
    assert got[4].headers == {"etag": 'W/"1"', "server": "t", "content-length": "3"}
    assert got[3].headers is None and got[3].body is None


def test_ties_take_the_larger_id_and_dates_validate(spark):
    date = {"last-modified": "Mon"}
    rows = [
        (1, "u.org/x", 1, 200, date, "a"),
        (2, "u.org/x", 1, 200, date, "b"),
        (2, "u.org/x", 1, 200, date, "b"),
        (3, "u.org/x", 2, 304, date, None),
        (4, "u.org/x", 2, 304, {}, None),
        (5, "u.org/x", 2, 304, None, None),
    ]
    got = resolved(spark, rows)
    assert (got[3].resolved_id, got[3].body) == (2, "b")
    assert got[4].outcome == got[5].outcome == "no_validator"


def test_one_id_with_several_captures(spark):
    """The body is that of the capture found, whatever else has its id."""
    one, two = {"etag": '"1"'}, {"etag": '"2"'}
    rows = [
        (1, "http://a.org", 10, 200, one, "one"), (1, "http://b.org", 10, 200, two, "two"),
        (1, "http://a.org", 30, 200, two, "three"),
        (2, "http://a.org", 20, 304, one, None), (3, "http://b.org", 20, 304, two, None), (4, "http://a.org", 40, 304, two, None),
        # The same id, address and time.
        (5, "http://c.org", 10, 200, one, "x"), (5, "http://c.org", 10, 200, one, "y"), (6, "http://c.org", 20, 304, one, None),
    ]
    got = resolved(spark, rows)
    assert {i: got[i].body for i in (2, 3, 4)} == {2: "one", 3: "two", 4: "three"}
    assert {r.outcome for r in got.values()} == {"resolved"}
    assert got == resolved(spark, rows[::-1])


def test_repeats_stay_and_empty_input_gives_nothing(spark):
    rows = [(1, "u", 1, 200, {"etag": "e"}, "a")] + [(2, "u", 2, 304, {"etag": "e"}, None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert warc.resolve_revisits(df).count() == 3
    assert warc.resolve_revisits(df.filter("false")).collect() == []


def test_every_page_gives_two_revisits(spark):
    rows = catalog.op7_warc_revisits(spark, SMALL).collect()
    assert len(rows) == 2 * table(spark, "pages").count()
    assert {"resolved", "validator_mismatch", "no_response"} <= {r.outcome for r in rows}


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "http://a.org", None), (None, "http://a.org", "y")], "page_id long, url string, html string")
    rows = warc.resolve_revisits(warc.captures(pages)).collect()
    assert {r.outcome for r in rows} == {"no_response"} and len(rows) == 6
