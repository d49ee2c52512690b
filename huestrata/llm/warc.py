"""Not-modified revisits of a web archive, resolved to the full response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that do not name a resource (prefixes and whole names).
TRACKING_PREFIXES = ("utm_",)
TRACKING = ("fbclid", "gclid", "sessionid", "sid", "phpsessid", "jsessionid")

#: Headers of a 304 that never replace those of the stored response: they belong to
#: the connection or describe the body that the 304 does not have.
NOT_PERMITTED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
    "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-md5",
    "content-range", "content-type",
)

#: Seconds of a time slice. A URL's captures are looked through slice by slice.
SLICE = 3600


def canonical_url(url: Column) -> Column:
    """One form for the addresses of a resource.

    Scheme, user, ``www.``, default port, fragment, tracking parameters and a
    final slash are dropped, the host is lower-cased, parameters are sorted.
    Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www[0-9]*\.", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))

    def counts(p: Column) -> Column:
        tracked = name(p).isin(*TRACKING)
        for prefix in TRACKING_PREFIXES:
            tracked = tracked | name(p).startswith(prefix)
        return (p != "") & ~tracked

    kept = F.array_join(F.array_sort(F.filter(params, counts)), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def same_validator(first: Column, second: Column) -> Column:
    """Do two header maps name the same version? By weak comparison of ETags, else by date; null if neither has both."""
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.try_element_at(h, F.lit("last-modified"))
    return F.coalesce(tag(first) == tag(second), date(first) == date(second))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, replaced or completed by those of the revisit that are permitted."""
    allowed = F.map_filter(revisit, lambda k, v: ~k.isin(*NOT_PERMITTED))
    kept = F.map_filter(response, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, *, slice_seconds: int = SLICE) -> DataFrame:
    """One row for each not-modified revisit, with the response it stands for.

    ``records``: ``record_id bigint, url string, at bigint`` (seconds), ``status
    int, headers map<string,string>`` (names in lower case), ``body string``.
    A row with status 304 is a revisit; one with status 200 and a body is a full
    response; others take no part. Returned: ``record_id, canonical_url, at,
    resolved_id, outcome, headers, body``. ``outcome`` is ``resolved`` (headers
    merged, body taken over), ``validator_mismatch``, ``no_validator`` or
    ``no_response``; in the last three headers and body are null.

    The as-of join takes the latest full response of the same canonical URL
    that is strictly earlier (ties: the larger id, then the larger hash of
    headers and body). Only ids, times and hashes are compared. Every URL and slice of time is a group of its own, and a running
    maximum over one row a slice carries the latest response on, so one URL
    with very many captures is spread over its slices. Bodies are joined once,
    to the revisits that have found a response. A revisit with a null URL or
    time finds none; repeated records stay.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", "status", "headers", "body"
    ).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    # Tells captures apart that share id, address and time.
    digest = F.xxhash64(F.to_json(F.array_sort(F.map_entries("headers"))), "body")
    full = (F.col("status") == 200) & F.col("body").isNotNull() & F.col("canonical_url").isNotNull()
    revisit = F.col("status") == 304
    mark = F.when(full & F.col("record_id").isNotNull(), F.struct("at", "record_id", digest.alias("digest")))
    key = ["canonical_url", "slice"]
    lines = rows.select(*key, "at", "record_id", revisit.alias("revisit"), mark.alias("mark"))
    lines = lines.filter((F.col("revisit") | F.col("mark").isNotNull()) & F.col("at").isNotNull())
    within = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = lines.withColumn("near", F.max("mark").over(within)).filter("revisit")
    before = Window.partitionBy("canonical_url").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    slices = (
        lines.groupBy(*key)
        .agg(F.max("mark").alias("last"))
        .withColumn("carried", F.max("last").over(before))
        .select(*key, "carried")
    )
    pairs = (
        found.filter("canonical_url is not null")
        .join(slices, key, "left")
        .withColumn("mark", F.coalesce("near", "carried"))
        .select(
            "record_id", "canonical_url", "at", F.col("mark.record_id").alias("resolved_id"),
            F.col("mark.at").alias("resolved_at"), F.col("mark.digest").alias("digest"),
        )
        .distinct()
    )
    # Equal ids in one place resolve alike, so one row for each is enough on the right side.
    revisits = rows.filter(revisit).select("record_id", "canonical_url", "at", F.col("headers").alias("own"))
    same = [revisits[c].eqNullSafe(pairs[c]) for c in ("record_id", "canonical_url", "at")]
    asked = revisits.join(pairs, same, "left").select(
        revisits["record_id"], revisits["canonical_url"], revisits["at"], "own", "resolved_id", "resolved_at", "digest"
    )
    responses = rows.filter(full).select(
        F.col("record_id").alias("resolved_id"), F.col("at").alias("resolved_at"), digest.alias("digest"),
        "canonical_url", F.col("headers").alias("theirs"), "body",
    )
    # A repeated response counts once; one id may have several.
    capture = ["resolved_id", "canonical_url", "resolved_at", "digest"]
    one = responses.dropDuplicates(capture).withColumn("spread", F.lit(0).cast("bigint"))
    # Revisits that have found nothing match nothing; a hash keeps them from meeting in one task.
    lone = F.when(F.col("resolved_id").isNull(), F.xxhash64("record_id", "canonical_url", "at"))
    spread = asked.withColumn("spread", F.coalesce(lone, F.lit(0).cast("bigint")))
    joined = spread.join(one, [*capture, "spread"], "left")
    same_version = same_validator(F.col("own"), F.col("theirs"))
    outcome = (
        F.when(F.col("resolved_id").isNull(), "no_response")
        .when(same_version.isNull(), "no_validator")
        .when(same_version, "resolved")
        .otherwise("validator_mismatch")
    )
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "at",
        "resolved_id",
        "outcome",
        F.when(F.col("outcome") == "resolved", merged_headers(F.col("theirs"), F.col("own"))).alias("headers"),
        F.when(F.col("outcome") == "resolved", F.col("body")).alias("body"),
    )


#: Time of the first capture that ``captures`` derives, and seconds from one page to the next.
FIRST_CAPTURE, PAGE_SECONDS = 1_700_000_000, 60


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from ``page_id, url, html``: a response and two revisits for each page.

    The response is captured a minute after that of the page before it. One
    revisit comes half a minute earlier, so it can only find another page with
    the same canonical URL; one comes two hours later, to another spelling of
    the address. By the length of the URL that one carries the response's ETag,
    the same as a weak one, only the date, or the ETag of another version.
    """
    base = F.lit(FIRST_CAPTURE) + F.col("page_id") * PAGE_SECONDS
    stamp = lambda at: F.date_format(
        F.timestamp_add("SECOND", at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"
    )
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    modified = F.concat(stamp(base - 86400), F.lit(" GMT"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))

    def headers(*pairs: Column) -> Column:
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))

    kind = F.length("url") % 4
    response = headers(
        pair("content-type", F.lit("text/html; charset=utf-8")),
        pair("content-length", F.octet_length("html")),
        pair("date", F.concat(stamp(base), F.lit(" GMT"))),
        pair("etag", tag),
        pair("last-modified", modified),
        pair("server", F.lit("archive")),
    )

    def not_modified(at: Column) -> Column:
        return headers(
            pair("cache-control", F.lit("max-age=600")),
            pair("connection", F.lit("close")),
            pair("content-length", F.lit(0)),
            pair("date", F.concat(stamp(at), F.lit(" GMT"))),
            pair("etag", F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 3, F.lit('"0"'))),
            pair("last-modified", F.when(kind == 2, modified)),
        )

    early, late = base - 30, base + 7200
    respelt = F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("#revisit"))
    record = lambda n, url, at, status, own, body: F.struct(
        (F.col("page_id") * 4 + n).cast("bigint").alias("record_id"),
        url.alias("url"),
        at.cast("bigint").alias("at"),
        F.lit(status).alias("status"),
        own.alias("headers"),
        body.alias("body"),
    )
    nothing = F.lit(None).cast("string")
    return pages.select(
        F.inline(
            F.array(
                record(0, F.col("url"), base, 200, response, F.col("html")),
                record(1, F.col("url"), early, 304, not_modified(early), nothing),
                record(2, respelt, late, 304, not_modified(late), nothing),
            )
        )
    )
