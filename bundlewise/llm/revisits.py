"""Web archive revisits: a not-modified capture gets the latest earlier full response of its canonical URL.

An as-of join on DataFrame functions. Captures are dealt out in sorted ranges, so a URL captured very often spans many
tasks; what the end of one range knows of a URL is handed to the next as one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlewise.llm.common import frozen, table

# fixed values: header fields of one connection, never stored (RFC 9110), and fields a 304 cannot change (RFC 9111, 3.2)
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
OF_THE_BODY = ("content-encoding", "content-length", "content-range", "content-type")


def canonical_url(url: Column) -> Column:
    """One spelling of an address: no scheme, user, `www` or default port, lower-case host, `/` for an empty path, sorted
    query, no fragment. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    asked = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of a name given twice the last spelling in order counts."""
    entries = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    named = F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(named, lambda e, i: F.coalesce(F.get(named, i + 1)["key"] != e["key"], F.lit(True)))
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Headers of the stored response updated by those of the 304: every field the 304 may change replaces the stored one."""
    kept = F.map_filter(stored, lambda k, v: ~k.isin(*HOP_BY_HOP))
    new = F.map_filter(fresh, lambda k, v: ~k.isin(*HOP_BY_HOP, *OF_THE_BODY))
    old = F.map_filter(kept, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve(captures: DataFrame, record_id: str = "record_id", url: str = "url", at: str = "at", status: str = "status", headers: str = "headers") -> DataFrame:
    """One row per revisit (status 304): record_id, url_key, at, state, response_id, response_at, headers.

    The candidate is the latest full response (status 200) of the same canonical URL at an earlier time; at equal times
    the higher record id is the later one. It is taken (`resolved`) if the revisit's ETag equals its ETag by weak
    comparison, or, where the revisit has none, if Last-Modified is equal, or if the revisit names no validator. Else the
    state is `validator mismatch`; without a candidate it is `no earlier response`. Only a resolved revisit gets headers:
    the response's, updated by the fields a 304 may change. The body stays with `response_id`.

    Nulls: a capture without URL or time is in no order; such a revisit has `no earlier response`, such a response is never
    a candidate. Null headers are no headers; a null record id comes first among ties. Repeated rows are each resolved.
    An empty table gives an empty result.
    """
    given = captures.select(
        captures[record_id].alias("record_id"), canonical_url(captures[url]).alias("url_key"), captures[at].cast("timestamp").alias("at"),
        captures[status].cast("int").alias("status"), _lower_keys(captures[headers]).alias("headers"),
    ).where("status in (200, 304)")
    placed = given.where("url_key is not null and at is not null")
    # revisits come before responses of their own instant: only earlier ones count
    order = ["url_key", "at", "turn", "record_id"]
    keyed = placed.withColumn("turn", (F.col("status") == 200).cast("int")).withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    fixed = frozen(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    full = F.when(F.col("status") == 200, F.struct(F.col("at").alias("at"), F.col("record_id").alias("record_id"), F.col("headers").alias("headers")))
    here = Window.partitionBy("_part", "url_key").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = fixed.withColumn("_near", F.last(full, ignorenulls=True).over(here))
    # what each range hands on: its last URL and that URL's last response there; as many rows as ranges
    ends = fixed.groupBy("_part").agg(F.max_by("url_key", "_id").alias("url_key"))
    last = fixed.where("status = 200").join(F.broadcast(ends), ["_part", "url_key"]).groupBy("_part", "url_key").agg(F.max_by(F.struct("at", "record_id", "headers"), "_id").alias("_given"))
    first = fixed.groupBy("_part").agg(F.min_by("url_key", "_id").alias("url_key")).withColumn("_given", F.lit(None).cast(last.schema["_given"].dataType))
    sides = first.withColumn("_asks", F.lit(True)).unionByName(last.withColumn("_asks", F.lit(False)))
    earlier = Window.partitionBy("url_key").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    handed = sides.withColumn("_far", F.last("_given", ignorenulls=True).over(earlier)).where("_asks").select("_part", "url_key", "_far")
    known = local.where("status = 304").join(F.broadcast(handed), ["_part", "url_key"], "left").withColumn("r", F.coalesce("_near", "_far"))
    rows = known.select("record_id", "url_key", "at", "headers", "r").unionByName(
        given.where("status = 304 and (url_key is null or at is null)").select("record_id", "url_key", "at", "headers", F.lit(None).cast(known.schema["r"].dataType).alias("r"))
    )
    own, theirs = F.col("headers"), F.col("r.headers")
    fits = F.when(own["etag"].isNotNull(), F.coalesce(_weak(own["etag"]) == _weak(theirs["etag"]), F.lit(False))).when(
        own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == theirs["last-modified"], F.lit(False))
    ).otherwise(True)
    state = F.when(F.col("r").isNull(), "no earlier response").when(fits, "resolved").otherwise("validator mismatch")
    return rows.withColumn("state", state).select(
        "record_id", "url_key", "at", "state", F.when(F.col("state") == "resolved", F.col("r.record_id")).alias("response_id"),
        F.when(F.col("state") == "resolved", F.col("r.at")).alias("response_at"),
        F.when(F.col("state") == "resolved", merged_headers(theirs, own)).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures as an archive would hold them, from all pages: a full response of each page at its own second, and two
    later revisits under another spelling of the address. Validators come from the page; every fifth page changed in
    between, every seventh is revisited before its response too, every third revisit names Last-Modified only."""
    p = pages.where("page_id is not null").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"), F.coalesce(F.length("html"), F.lit(0)).alias("n"))
    stamp = lambda s: f"timestamp_seconds(1700000000 + {s})"
    modified = "concat('day ', cast(page_id % 28 as string))"
    other = "regexp_replace(url, '^https?://', 'HTTP://')"
    tag = "concat('\"', tag, '\"')"
    changed = "case when page_id % 5 = 0 then '\"changed\"' else concat('W/\"', tag, '\"') end"
    fresh = f"case when page_id % 3 = 0 then map('Last-Modified', {modified}) else map('ETag', {changed}) end"
    return p.selectExpr(
        "inline(array("
        f"named_struct('record_id', page_id * 4, 'url', url, 'at', {stamp('page_id')}, 'status', 200, 'headers', map('ETag', {tag}, 'Last-Modified', {modified}, "
        "'Content-Type', 'text/html', 'Content-Length', cast(n as string), 'Transfer-Encoding', 'chunked', 'Cache-Control', 'max-age=60')),"
        f"named_struct('record_id', page_id * 4 + 1, 'url', concat({other}, '#top'), 'at', {stamp('page_id + 3600')}, 'status', 304, 'headers', "
        f"map_concat(map('Content-Length', '0', 'Cache-Control', 'max-age=600', 'Connection', 'close'), {fresh})),"
        f"named_struct('record_id', page_id * 4 + 2, 'url', {other}, 'at', {stamp('page_id + 7200')}, 'status', case when page_id % 11 = 0 then 404 else 304 end, 'headers', map('Server', 's')),"
        f"named_struct('record_id', page_id * 4 + 3, 'url', url, 'at', {stamp('page_id - 1')}, 'status', case when page_id % 7 = 0 then 304 else 500 end, 'headers', map('ETag', {tag}))"
        "))"
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(captures_of(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return done.select("record_id", "url_key", "state", "response_id", F.array_join(lines, "\n").alias("headers"))


OP2_SQL = r"""
with p as (
  select page_id, url, md5(coalesce(html, '')) as tag, coalesce(length(html), 0) as n, 'day ' || cast(page_id % 28 as varchar) as day,
    regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest from pages where page_id is not null
), q as (
  select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') as host,
    regexp_extract(rest, '^[^/?]*(/[^?]*)', 1) as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '')), '&') as asked from p
), u as (
  select *, host || case when path = '' then '/' else path end || case when asked <> '' then '?' || asked else '' end as url_key from q
), r as (
  select page_id * 4 as response_id, page_id as at, url_key, tag, day, n from u where url_key is not null
), v as (
  select page_id * 4 + 1 as record_id, page_id + 3600 as at, url_key, 1 as kind,
    case when page_id % 3 = 0 then null when page_id % 5 = 0 then 'changed' else tag end as etag, case when page_id % 3 = 0 then day end as lm from u
  union all select page_id * 4 + 2, page_id + 7200, url_key, 2, null, null from u where page_id % 11 <> 0
  union all select page_id * 4 + 3, page_id - 1, url_key, 3, tag, null from u where page_id % 7 = 0
), j as (
  select v.*, r.response_id, r.tag, r.day, r.n from v asof left join r on v.url_key = r.url_key and v.at > r.at
), s as (
  select *, case when response_id is null then 'no earlier response' when (etag is not null and etag <> tag) or (etag is null and lm is not null and lm <> day)
    then 'validator mismatch' else 'resolved' end as state from j
)
select record_id, url_key, state, case when state = 'resolved' then response_id end as response_id,
  case when state = 'resolved' then concat('cache-control: max-age=', case when kind = 1 then '600' else '60' end, chr(10), 'content-length: ', n, chr(10),
    'content-type: text/html', chr(10), 'etag: ', case when kind = 1 and etag is not null then 'W/' else '' end, '"', tag, '"', chr(10), 'last-modified: ', day,
    case when kind = 2 then chr(10) || 'server: s' else '' end) end as headers
from s
"""
