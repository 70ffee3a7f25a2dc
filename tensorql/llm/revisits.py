"""WARC: resolution of not-modified revisits.

A revisit record says that a server answered 304 Not Modified; it has headers but no body. It
is resolved by an as-of join: by canonical URL, the latest full response before it. The
validators (ETag, Last-Modified) that the revisit carries must agree with that response; then
its permitted headers replace those of the response, and the body is the response's.

The as-of join is laid out so that no URL's records meet in one task, whatever their number:
records are cut into buckets of time, the last response of each bucket is one aggregated row,
and only those rows are ordered for a whole URL; the records of a bucket are ordered within it.
A URL so busy that one bucket is large calls for a smaller `bucket`.

Defined results: a full response is one of status 200; where the status is null or there is no
such column, any response. An unreadable URL is a URL of its own text; a revisit without a URL
is 'unresolved', and a response without one answers nothing. A revisit without an earlier full
response is 'unresolved'; with validators that differ, 'changed'; without validators on both
sides, 'unchecked' (it takes the body, as there is nothing to hold against it); else 'resolved'.
A null date is before all others. Responses at the same second as the revisit count as earlier
if their record id is smaller (null is the smallest). Of responses with the same date and id
the one that was numbered last answers, with its own headers and body. Repeated rows are
repeated in the result. Other columns are not read.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Fields of a 304 that replace those of the stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only say where a visitor came from.
TRACKING = r"(utm_[a-z]+|ref|gclid|fbclid|sessionid)"
BUCKET = 86_400


def canonical(url: str) -> Column:
    """Lower-case scheme and host, http for https, no www., default port, fragment, tracking parameters or final slash; parameters sorted."""
    u = f"coalesce(trim({url}), '')"
    bare = f"regexp_replace({u}, '#.*$', '')"
    scheme = f"regexp_replace(lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '^https$', 'http')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"
    query = f"array_sort(filter(split(regexp_extract({bare}, '[?](.*)$', 1), '&'), p -> p <> '' and not rlike(p, '^{TRACKING}(=|$)')))"
    joined = f"concat({scheme}, '://', {host}, {path}, if(size({query}) > 0, concat('?', array_join({query}, '&')), ''))"
    return F.expr(f"if(rlike({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]'), {joined}, {u})")


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """records: record_id, kind ('response' or 'revisit'), url, date (seconds, long), headers map<string, string> (lower-case names), payload, and maybe status (int).

    One row per revisit: record_id, canonical_url, response_id, state, headers (merged), payload.
    """
    at = F.coalesce("date", F.lit(-(1 << 60)).cast("long"))
    status = F.col("status") if "status" in records.columns else F.lit(None)
    full = (F.col("kind") == "response") & F.coalesce(status == 200, F.lit(True))
    own = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id", "kind", canonical("url").alias("canonical_url"), at.alias("at"), "headers", "payload", F.monotonically_increasing_id().alias("row")
    )
    own, _ = C.materialize(own, "captures")
    narrow = own.where("canonical_url <> ''").select(
        "row", "record_id", "kind", "canonical_url", "at", F.expr(f"(at - pmod(at, {bucket})) div {bucket}").alias("slot"),
        F.when(F.col("kind") == "response", F.struct("at", "record_id", "row")).alias("full"),
    )
    # The last response of each bucket, and by that the last one of all buckets before it.
    slots = narrow.groupBy("canonical_url", "slot").agg(F.max("full").alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("canonical_url", "slot", F.max("last").over(before).alias("earlier"))
    within = Window.partitionBy("canonical_url", "slot").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = narrow.withColumn("here", F.max("full").over(within)).where("kind = 'revisit'").join(slots, ["canonical_url", "slot"])
    found = found.select("row", F.coalesce("here", "earlier").alias("of")).where("of is not null").select("row", F.col("of.row").alias("of"))
    stored = own.select(F.col("row").alias("of"), F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    joined = own.where("kind = 'revisit'").drop("kind", "at", "payload").join(found.join(stored, "of"), "row", "left")
    field = lambda c, k: F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))[k]
    weak = lambda c: F.regexp_replace(field(c, "etag"), "^W/", "")
    tag = F.when(field("headers", "etag").isNotNull() & field("stored", "etag").isNotNull(), weak("headers") == weak("stored"))
    day = F.when(
        field("headers", "last-modified").isNotNull() & field("stored", "last-modified").isNotNull(), field("headers", "last-modified") == field("stored", "last-modified")
    )
    agree = F.coalesce(tag, day)  # the ETag is the stronger validator
    state = F.when(F.col("of").isNull(), "unresolved").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    taken = F.col("state").isin("resolved", "unchecked")
    permitted = "array(" + ", ".join(f"'{k}'" for k in PERMITTED) + ")"
    merged = F.expr(
        f"map_from_entries(array_sort(map_entries(map_concat(map_filter(coalesce(stored, map()), (k, v) -> not (array_contains({permitted}, k) and map_contains_key(coalesce(headers, map()), k))), "
        f"map_filter(coalesce(headers, map()), (k, v) -> array_contains({permitted}, k))))))"
    )
    out = joined.withColumn("state", state).select(
        "record_id", "canonical_url", "response_id", "state", F.when(taken, merged).otherwise(F.col("headers")).alias("headers"), F.when(taken, F.col("of")).alias("body_of")
    )
    bodies = own.where("kind = 'response'").select(F.col("row").alias("body_of"), "payload")
    return out.join(bodies, "body_of", "left").drop("body_of")


#: Records of a file end with two line breaks; what follows is the next one's version.
BETWEEN = "\r\n\r\nWARC/1."


def records_of(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(file, what lies between two separators), in order, to (named fields in lower case, block).

    A block that has the separator in it is put together by its length. A record that its file
    ends in, or whose length is no number, is left out.
    """
    held, of = b"", None
    for file, chunk in chunks:
        held = held + BETWEEN.encode() + chunk if held and file == of else chunk.removeprefix(b"WARC/1.")
        of = file
        head, _, block = held.partition(b"\r\n\r\n")
        fields = _fields(head)
        length = fields.get("content-length", "")
        if not length.isdecimal():
            held = b""
        elif len(block) >= int(length):
            yield fields, block[: int(length)]
            held = b""


def _fields(head: bytes) -> dict[str, str]:
    """Named fields after the first line, in lower case; values of a repeated name are one list."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _record(fields: dict[str, str], block: bytes) -> tuple | None:
    """What resolve() takes. A revisit by payload digest is of kind 'digest': it is no answer of a server."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\S+ +(\d{3})", head)
    status = int(status[1]) if status else None
    if kind == "revisit" and not ("not-modified" in fields["warc-profile"] if "warc-profile" in fields else status == 304):
        kind = "digest"
    try:
        date = int(datetime.datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).timestamp())
    except (KeyError, ValueError, OverflowError):
        date = None
    url = re.sub("^<|>$", "", fields.get("warc-target-uri", ""))
    return fields.get("warc-record-id"), kind, url, date, list(_fields(head).items()), body if kind == "response" else None, status


def read_warc(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """The records that resolve() takes, from WARC files under a path, plain or gzip by record. Record ids are WARC-Record-ID.

    Files are read as streams, plain ones in splits; a batch has records of about `most` bytes.
    What can be read of a damaged file is.
    """
    C.ship(spark)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int32()]
    names = ["record_id", "kind", "url", "date", "headers", "payload", "status"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        rows, size = [], 0
        for fields, block in records_of(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if row := _record(fields, block):
                rows.append(row)
                size += len(block)
            if size >= most:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    chunks = spark.read.option("lineSep", BETWEEN).option("ignoreCorruptFiles", "true").text(path)
    chunks = chunks.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk"))
    return chunks.mapInArrow(run, "record_id string, kind string, url string, date long, headers map<string,string>, payload binary, status int")


#: The tables have pages, not captures. Every page stands for a response, and for a later revisit of its URL.
HOURS = 36


def captures(pages: DataFrame) -> DataFrame:
    """Of each page a response, an hour after the page before it by id, and a revisit HOURS hours later with the page's own validators."""
    own = pages.select(
        "page_id", "url", "html",
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("tag"), (F.col("page_id") * 3600).alias("date"),
    )
    text = lambda c: F.col(c).cast("string")
    response = own.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", "date",
        F.create_map(F.lit("etag"), F.col("tag"), F.lit("date"), text("date"), F.lit("content-length"), F.length("html").cast("string")).alias("headers"),
        F.col("html").alias("payload"),
    )
    later = F.col("date") + HOURS * 3600 + 1
    revisit = own.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("date"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "tag"), F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return found.select(
        "record_id", "canonical_url", "response_id", "state",
        F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"), F.col("headers")["etag"].alias("etag"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


OP4_SQL = f"""
with p as (
  select page_id, html, sha256(coalesce(html, '')) as tag, regexp_replace(coalesce(trim(url), ''), '#.*$', '') as u, coalesce(trim(url), '') as whole from pages
), c as (
  select page_id, html, tag, whole, u,
    regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '^https$', 'http') as scheme,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^{TRACKING}(=|$)'))) as query
  from p
), k as (
  select page_id, html, tag, case when regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]')
    then scheme || '://' || host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end else whole end as url from c
), j as (
  select r.page_id * 2 + 1 as record_id, r.url as canonical_url, r.tag as own_tag, r.page_id as own, s.page_id as found, s.tag, s.html
  from k r asof left join k s on r.url = s.url and s.url <> '' and r.page_id * 3600 + {HOURS} * 3600 + 1 > s.page_id * 3600
)
select record_id, canonical_url, found * 2 as response_id, case when found is null then 'unresolved' when tag = own_tag then 'resolved' else 'changed' end as state,
  cast(own * 3600 + {HOURS} * 3600 + 1 as varchar) as date,
  case when tag = own_tag then cast(length(html) as varchar) else '0' end as content_length,
  'W/' || own_tag as etag, case when tag = own_tag then sha256(html) end as payload_sha256
from j
"""
