"""Resolution of not-modified revisits in crawl records.

A revisit (a 304 answer) has no body; it stands for the latest earlier full response of the same
canonical URL. This is an as-of join: within a (URL, time chunk) the last response before a row is
a running value; what earlier chunks end with is a small row per chunk. A URL that holds a third of
all records is therefore spread over its chunks, and nothing is paired. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query fields that name a visitor's way, not a page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
CHUNK_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port in lower case, path without end slash, sorted query.

    Scheme, fragment and tracking fields are dropped; a text without ``scheme://host`` stays as it is.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    tail = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(host == "", url).otherwise(F.concat(host, path, tail))


def merged_headers(response: Column, revisit: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The response's fields, with the permitted ones of the revisit in place of its own.

    Field names are compared in lower case and given so; of equal names in one map any stays.
    """

    def lowered(headers: Column) -> Column:
        return F.transform(
            F.coalesce(F.map_entries(headers), F.array()),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )

    newer = F.filter(lowered(revisit), lambda e: e["key"].isin(*permitted) & e["value"].isNotNull())
    names = F.transform(newer, lambda e: e["key"])
    older = F.filter(lowered(response), lambda e: ~F.array_contains(names, e["key"]))
    both = F.concat(newer, older)
    unique = F.filter(
        both, lambda e, i: F.array_position(F.transform(both, lambda x: x["key"]), e["key"]) == i + 1
    )
    return F.map_from_entries(unique)


def resolve_revisits(records: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One row per revisit of ``records`` with the response it stands for.

    ``records``: record_id, url, ts timestamp, kind (``response`` or ``revisit``), etag, last_modified,
    digest, length, headers map<string,string>. Result: record_id, canonical_url, ts, outcome,
    response_id, response_ts, digest, length, headers.

    outcome is ``resolved`` if the entity tags agree (weak comparison) or, where one is missing, the
    modification dates; ``unchecked`` if the two share no kind of validator; ``mismatch`` if they
    disagree, and ``no_response`` if no response is strictly earlier: these two have null response
    columns and the revisit's own headers. Responses of one time count by the larger record_id.
    A null url or time never meets a response; responses without a time are never met. Repeated
    rows are resolved each, other columns are ignored, other kinds of record are neither.
    """
    answer = F.struct("record_id", "ts", "etag", "last_modified", "digest", "length", "headers")
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = (
        records.filter(F.col("kind").isin("response", "revisit"))
        .select(
            "record_id",
            canonical_url(F.col("url")).alias("canonical_url"),
            "ts",
            (F.col("kind") == "response").alias("full"),
            "etag",
            "last_modified",
            "digest",
            "length",
            "headers",
        )
        .withColumn(
            "chunk",
            # Rows that meet nothing are spread by their id.
            F.when(usable, F.floor(seconds / chunk_seconds)).otherwise(
                F.pmod(F.xxhash64("record_id"), F.lit(4096))
            ),
        )
        .withColumn("response", F.when(F.col("full") & usable, answer))
    )
    inside = (
        Window.partitionBy("canonical_url", "chunk")
        .orderBy("ts", "full", "record_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = (
        rows.filter("response is not null")
        .groupBy("canonical_url", "chunk")
        .agg(F.max_by("response", F.struct("ts", "record_id")).alias("end"))
        .select(F.col("canonical_url").alias("u"), F.col("chunk").alias("c"), "end")
    )
    # Chunks of a URL that hold any row, each with what the chunks before it end with.
    chunks = rows.filter(usable).select(
        F.col("canonical_url").alias("u"), F.col("chunk").alias("c")
    ).distinct().join(ends, ["u", "c"], "left")
    earlier = Window.partitionBy("u").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("u", "c", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    found = (
        rows.withColumn("own", F.last("response", ignorenulls=True).over(inside))
        .filter(~F.col("full"))
        .join(
            carried,
            (F.col("canonical_url") == F.col("u")) & (F.col("chunk") == F.col("c")) & usable,
            "left",
        )
        .withColumn("r", F.when(usable, F.coalesce("own", "before")))
    )
    tag = F.regexp_replace(F.col("etag"), "^W/", "")
    both_tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    agrees = F.when(both_tags, tag == F.regexp_replace(F.col("r.etag"), "^W/", "")).when(
        both_dates, F.col("last_modified") == F.col("r.last_modified")
    )
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(agrees.isNull(), "unchecked")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    taken = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "ts",
        "outcome",
        F.when(taken, F.col("r.record_id")).alias("response_id"),
        F.when(taken, F.col("r.ts")).alias("response_ts"),
        F.when(taken, F.col("r.digest")).alias("digest"),
        F.when(taken, F.col("r.length")).alias("length"),
        F.when(taken, merged_headers(F.col("r.headers"), F.col("headers")))
        .otherwise(F.col("headers"))
        .alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records derived from ``pages`` (page_id, url, html): up to five visits of each page.

    The first visit of most pages is a full response, the fourth one of even pages a changed response, the
    others are revisits; validators agree, disagree or are missing by the page_id.
    """
    p, i = F.col("page_id"), F.col("visit")
    # Bodies are hashed and measured once a page; no visit carries one.
    pages = pages.select(
        "page_id",
        "url",
        F.md5("html").alias("first_digest"),
        F.octet_length("html").alias("first_size"),
        F.md5(F.concat("html", F.lit("<!-- 2 -->"))).alias("changed_digest"),
        (F.octet_length("html") + len("<!-- 2 -->")).alias("changed_size"),
    )
    visits = pages.withColumn("visit", F.explode(F.sequence(F.lit(0), (p % 4 + 1).cast("int"))))
    full = ((i == 0) & (p % 7 != 0)) | ((i == 3) & (p % 2 == 0))
    size = F.when(i == 3, F.col("changed_size")).otherwise(F.col("first_size"))
    first = F.timestamp_seconds(F.lit(1_700_000_000) + (p % 1000) * 60)
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + (p % 1000) * 60 + i * 25_200)
    digest = F.when(full & (i == 3), F.col("changed_digest")).otherwise(F.col("first_digest"))
    quoted = F.concat(F.lit('"'), digest, F.lit('"'))
    etag = (
        F.when(p % 3 == 0, F.lit(None).cast("string"))
        .when(~full & (p % 11 == 0), F.lit('"stale"'))
        .when(~full & (p % 5 == 1), F.concat(F.lit("W/"), quoted))
        .otherwise(quoted)
    )
    modified = F.when(full, ts).when(p % 13 == 0, F.lit(None)).otherwise(first)
    date = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    headers = F.map_from_arrays(
        F.when(
            full, F.array(*map(F.lit, ("Content-Type", "Content-Length", "Date", "ETag", "Server")))
        ).otherwise(F.array(*map(F.lit, ("Cache-Control", "Content-Length", "Date", "ETag", "Server")))),
        F.when(full, F.array(F.lit("text/html"), size.cast("string"), date, etag, F.lit("a"))).otherwise(
            F.array(F.lit("max-age=60"), F.lit("0"), date, etag, F.lit("b"))
        ),
    )
    return visits.select(
        (p * 8 + i).alias("record_id"),
        "url",
        ts.alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"),
        modified.alias("last_modified"),
        digest.alias("digest"),
        F.when(full, size).cast("long").alias("length"),
        headers.alias("headers"),
    )
