"""Not-modified revisit resolution for web-archive records (operator 10).

A ``revisit`` record says that a page was unchanged (HTTP 304) and holds no
body.  It is resolved to the latest earlier full response of the same canonical
URL by an as-of join, its validators are checked, and the headers that a 304
may update are merged into those of the stored response.

The as-of join never sorts all records of a URL together: the last response of
each (URL, time block) is an aggregate, a window over these few rows carries it
into later blocks, and only inside a block are single records ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_SECONDS = 3600

# Header fields a 304 must not change (body, framing, connection),
# and query parameters that only track a visit.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
              "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Scheme, www/m prefix, default port, fragment, tracking parameters, index
    page and trailing slash go; the host is lower case; parameters are sorted.
    Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r":(80|443)$", ""),
                            r"^(www|m)\.", "")
    path = F.regexp_extract(bare, r"^[^/?]*(/[^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
                      lambda p: (p != "") & ~p.rlike(f"^({TRACKING})=?"))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that differ in case only,
    the first counts."""
    e = F.map_entries(headers)
    names = F.transform(e, lambda x: F.lower(x["key"]))
    firsts = F.filter(F.transform(e, lambda x, i: F.struct(
        F.lower(x["key"]).alias("key"), x["value"].alias("value"), (F.array_position(names, F.lower(x["key"])) == i + 1).alias("first"))),
        lambda x: x["first"])
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["key"], x["value"])))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_response(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(id, match): for each revisit the id of the latest full response of its
    URL (column u) that is earlier; at equal times the smaller id is earlier.
    Records without a URL or a time match nothing."""
    r = records.where("u IS NOT NULL AND at IS NOT NULL").select(
        "u", "at", "id", "full", "revisit", F.floor(F.col("at") / block_seconds).alias("block"))
    mine = F.when(F.col("full"), F.struct("at", "id"))
    last = r.groupBy("u", "block").agg(F.max(mine).alias("last"), F.max("revisit").alias("asked"))
    carried = last.selectExpr("u", "block", "asked", "last(last, true) OVER (PARTITION BY u ORDER BY block "
                              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried").where("asked")
    inside = r.withColumn("mine", mine).selectExpr(
        "u", "block", "id", "revisit", "last(mine, true) OVER (PARTITION BY u, block ORDER BY at, id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near").where("revisit")
    return inside.join(carried, ["u", "block"], "left").select(
        "id", F.coalesce("near", "carried")["id"].alias("match"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve every revisit of (record_id, warc_type, target_uri, at, status,
    headers, digest): at in seconds, headers a map.

    Returns record_id, canonical, resolution, resolved_id, digest (of the
    response), merged_headers (a map with lower-case names).  resolution is
    ``resolved``, ``validator_mismatch`` (an earlier response is there, but
    entity tag, modification date or digest disagree, or no validator is
    shared) or ``no_response``.  Where it is not resolved, resolved_id, digest
    and merged_headers are null.  Full responses have status 200 and type
    ``response``; record ids are distinct; null ids, types and statuses make a
    record neither; other columns are ignored."""
    r = records.select(F.col("record_id").alias("id"), F.col("warc_type").alias("kind"),
                       canonical_url(F.col("target_uri")).alias("u"), F.col("at").cast("long").alias("at"),
                       F.col("status").cast("int").alias("status"),
                       lower_names(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"),
                                                                           F.array().cast("array<string>")))).alias("headers"),
                       "digest").withColumns({
        "full": F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("id").isNotNull(), F.lit(False)),
        "revisit": F.coalesce((F.col("kind") == "revisit") & F.col("id").isNotNull(), F.lit(False))})
    match = latest_response(r)
    asked = r.where("revisit").select("id", "u", F.col("headers").alias("new"), F.col("digest").alias("own"))
    stored = r.where("full").select(F.col("id").alias("match"), F.col("headers").alias("old"), "digest")
    j = asked.join(match, "id", "left").join(stored, "match", "left")
    tag_n, tag_o = _weak(F.col("new")["etag"]), _weak(F.col("old")["etag"])
    date_n, date_o = F.col("new")["last-modified"], F.col("old")["last-modified"]
    # an entity tag on both sides decides; only else the dates; a digest must agree too
    valid = F.when(tag_n.isNotNull() & tag_o.isNotNull(), tag_n == tag_o).when(
        date_n.isNotNull() & date_o.isNotNull(), date_n == date_o).otherwise(
        F.col("own").isNotNull() & F.col("digest").isNotNull())
    valid = valid & F.coalesce(F.col("own") == F.col("digest"), F.lit(True))
    how = (F.when(F.col("match").isNull(), "no_response").when(valid, "resolved").otherwise("validator_mismatch"))
    permitted = F.map_filter("new", lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    ok = F.col("resolution") == "resolved"
    return j.withColumn("resolution", how).select(
        F.col("id").alias("record_id"), F.col("u").alias("canonical"), "resolution",
        F.when(ok, F.col("match")).alias("resolved_id"), F.when(ok, F.col("digest")).alias("digest"),
        F.when(ok, merged).alias("merged_headers"))


# -- records from the pages table -------------------------------------------------
def capture_records(pages: DataFrame) -> DataFrame:
    """Two captures of every page: its response and a later revisit.

    The table holds no crawl log, so times, statuses and validators follow from
    the page: id and content by plain rules, the same for any engine.  Revisits
    ask for another spelling of the URL; some carry an outdated entity tag, some
    only a date."""
    p = pages.where("page_id IS NOT NULL").select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("d"))
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.left("d", F.lit(16)), F.lit('"'))
    modified = (F.lit(1_600_000_000) + i * 131).cast("string")
    response = p.select(
        (i * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"),
        (F.lit(1_700_000_000) + (i * 7919) % 864_000).alias("at"),
        F.when(i % 11 == 0, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
                     F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("d").alias("digest"))
    revisit = p.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&utm_source=again").otherwise("?utm_source=again"),
                 F.lit("#seen")).alias("target_uri"),
        (F.lit(1_700_000_000) + (i * 7919) % 864_000 + 3600 + (i * 104_729) % 500_000).alias("at"), F.lit(304).alias("status"),
        F.when(i % 5 == 0, F.create_map(F.lit("Last-Modified"), modified, F.lit("Date"), i.cast("string"),
                                        F.lit("Content-Type"), F.lit("text/plain")))
        .otherwise(F.create_map(F.lit("ETag"), F.when(i % 7 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), tag)),
                                F.lit("Cache-Control"), F.lit("max-age=90"), F.lit("Date"), i.cast("string"),
                                F.lit("Content-Length"), F.lit("0"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


def revisits_of_pages(pages: DataFrame) -> DataFrame:
    """record_id, canonical, resolution, resolved_id, digest and the merged
    headers as sorted lines."""
    out = resolve_revisits(capture_records(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(
        e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "canonical", "resolution", "resolved_id", "digest", lines.alias("merged_headers"))
