import random

from helpers import SMALL
from oracle import compare, duck
from pyspark.sql import functions as F

from gradeflow.llm import queries, warc

SCHEMA = "record_id long, warc_type string, target_uri string, at long, status int, headers map<string,string>, digest string, u string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def run(spark, rows):
    return {r["record_id"]: r for r in warc.resolve_revisits(frame(spark, rows)).collect()}


def test_query_against_duckdb(spark):
    got = queries.QUERIES["op10_revisits"](spark, "/root/testdata/sf0.01").toPandas()
    ok, why = compare(got, duck(queries.ORACLE_SQL["op10_revisits"], "/root/testdata/sf0.01"))
    assert ok, why
    assert set(got["resolution"]) == {"resolved", "validator_mismatch", "no_response"}


def test_canonical_urls(spark):
    same = ["http://www.Example.org:80/a/", "https://example.org/a", "example.org/a#top", "HTTPS://m.example.org:443/a/index.html",
            " http://example.org/a?utm_source=x&ref=y "]
    other = ["http://example.org/A", "http://example.org/a?b=1", "http://example.org"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None, ""]], "v string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("v"))).collect()]
    assert set(got[:5]) == {"example.org/a"}
    assert got[5:] == ["example.org/A", "example.org/a?b=1", "example.org", None, ""]
    two = spark.createDataFrame([("http://x.org/p?b=2&a=1",), ("x.org/p?a=1&utm_medium=z&b=2",)], "v string")
    assert len({r[0] for r in two.select(warc.canonical_url(F.col("v"))).collect()}) == 1


def test_validators_and_headers(spark):
    full = {"ETag": '"v1"', "Last-Modified": "d1", "Content-Type": "text/html", "X-Old": "1", "Server": "a"}
    got = run(spark, [
        (1, "response", "http://a.org/x", 100, 200, full, "sha"),
        (2, "revisit", "https://www.a.org/x/", 200, 304, {"etag": 'W/"v1"', "content-type": "no", "SERVER": "b", "Date": "t"}, None),
        (3, "revisit", "http://a.org/x", 200, 304, {"ETag": '"v2"', "Last-Modified": "d1"}, None),
        (4, "revisit", "http://a.org/x", 200, 304, {"Last-Modified": "d1"}, None),
        (5, "revisit", "http://a.org/x", 200, 304, {"Last-Modified": "d2"}, None),
        (6, "revisit", "http://a.org/x", 200, 304, {}, "sha"),
        (7, "revisit", "http://a.org/x", 200, 304, {"ETag": '"v1"'}, "other"),
        (8, "revisit", "http://a.org/x", 200, 304, None, None),
        (9, "revisit", "http://a.org/x", 50, 304, {"ETag": '"v1"'}, None),
        (10, "revisit", None, 200, 304, {"ETag": '"v1"'}, None),
        (11, "response", "http://a.org/y", 10, 404, full, "sha"),
        (12, "revisit", "http://a.org/y", 20, 304, {"ETag": '"v1"'}, None),
        (13, None, "http://a.org/x", 150, 200, full, "z"), (14, "revisit", "http://a.org/x", None, 304, {"ETag": '"v1"'}, None)])
    assert {k: r["resolution"] for k, r in got.items()} == {
        2: "resolved", 3: "validator_mismatch", 4: "resolved", 5: "validator_mismatch", 6: "resolved",
        7: "validator_mismatch", 8: "validator_mismatch", 9: "no_response", 10: "no_response", 12: "no_response", 14: "no_response"}
    assert got[2]["resolved_id"] == 1 and got[2]["digest"] == "sha"
    assert got[2]["merged_headers"] == {"etag": 'W/"v1"', "last-modified": "d1", "content-type": "text/html", "x-old": "1",
                                        "server": "b", "date": "t"}
    assert got[3]["merged_headers"] is None and got[3]["resolved_id"] is None


def test_latest_earlier_response_against_a_loop(spark):
    rnd = random.Random(5)
    rows, tag = [], {"ETag": '"a"'}
    for k in range(600):
        kind = rnd.choice(["response", "revisit"])
        rows.append((k, kind, f"http://h.org/{rnd.randrange(4) if k % 3 else 0}", rnd.randrange(0, 9000), 200 if rnd.random() < 0.8 else 500,
                     tag, None))
    got = run(spark, rows)
    for k, kind, url, at, _, _, _ in rows:
        if kind == "revisit":
            best = max(((a, i) for i, kd, u, a, s, _, _ in rows if kd == "response" and s == 200 and u == url and (a, i) < (at, k)),
                       default=(None, None))
            assert got[k]["resolved_id"] == best[1]


def test_empty_table(spark):
    assert warc.resolve_revisits(frame(spark, []).limit(0)).collect() == []
    assert warc.revisits_of_pages(spark.read.parquet(f"{SMALL}/pages.parquet").limit(0)).collect() == []
