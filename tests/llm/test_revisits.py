import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.llm import queries, revisits
from tests.compare import difference, duckdb_on

KIND = (
    "record_id long, url string, ts timestamp, kind string, etag string, last_modified long,"
    " digest string, length long, headers map<string,string>, chunk string"
)


def test_canonical_url(spark):
    cases = {
        "http://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#top": "example.com/a/b?a=1&b=2",
        "https://example.com": "example.com",
        "https://example.com/?ref=x": "example.com",
        "https://m.example.com/A/?x=": "m.example.com/A?x=",
        "no url": "no url",
        "": "",
    }
    table = spark.createDataFrame([(u,) for u in [*cases, None]], "url string")
    got = [r[0] for r in table.select(revisits.canonical_url(F.col("url"))).collect()]
    assert got == [*cases.values(), None]


def brute(rows):
    out = []
    canon = lambda u: u.lower().replace("http://", "").split("#")[0] if u else None
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [
            x for x in rows
            if x[3] == "response" and r[1] and canon(x[1]) == canon(r[1])
            and x[2] is not None and r[2] is not None and x[2] < r[2]
        ]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        bare = lambda t: t.removeprefix("W/")
        if best is None:
            outcome = "no_response"
        elif r[4] and best[4]:
            outcome = "resolved" if bare(r[4]) == bare(best[4]) else "mismatch"
        elif r[5] is None or best[5] is None:
            outcome = "unchecked"
        else:
            outcome = "resolved" if r[5] == best[5] else "mismatch"
        taken = outcome in ("resolved", "unchecked")
        own = {k.lower(): v for k, v in (r[8] or {}).items()}
        headers = r[8]
        if taken:
            headers = {k.lower(): v for k, v in (best[8] or {}).items()}
            headers |= {k: v for k, v in own.items() if k in revisits.PERMITTED and v is not None}
        out.append((r[0], outcome, best[0] if taken else None, best[6] if taken else None,
                    None if headers is None else tuple(sorted(headers.items()))))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    start = datetime(2024, 3, 1)
    rows = []
    for i in range(900):
        url = rng.choice(["http://hot.example/x"] * 3 + [f"http://e{rng.randint(0, 40)}.example/p", None])
        full = rng.random() < 0.3
        rows.append((
            i if i % 97 else None, url,
            rng.choice([None, *[start + timedelta(hours=rng.randint(0, 400))] * 12]),
            "response" if full else rng.choice(["revisit"] * 6 + ["request"]),
            rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, 1, 1, 2]),
            f"d{i}", i, rng.choice([None, {}, {"ETag": "n", "Content-Type": "t", "Date": None}, {"date": "d", "Server": "s"}]),
            "x",
        ))
    # Record ids decide ties, so leave rows without one out of ties.
    rows = [r for r in rows if r[0] is not None] + [(None, "http://e1.example/p", None, "revisit", None, None, "d", 1, None, "x")]
    rows += rows[-40:]
    table = spark.createDataFrame(rows, KIND)
    found = revisits.resolve_revisits(table.repartition(5), chunk_seconds=86_400).collect()
    got = sorted(
        ((r["record_id"], r["outcome"], r["response_id"], r["digest"],
          None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in found), key=repr,
    )
    assert got == brute(rows)
    assert {r["outcome"] for r in found} == {"resolved", "unchecked", "mismatch", "no_response"}
    assert revisits.resolve_revisits(table.limit(0)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op4_revisits"](spark, folder)
    assert difference(found, duckdb_on(folder), queries.ORACLES["op4_revisits"]) is None
