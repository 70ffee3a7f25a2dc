"""Revisit resolution against a plain version and its SQL; WARC files; the pipeline's stages."""

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorql.llm import queries, revisits, secrets, toxicity

SCHEMA = "record_id long, kind string, url string, date long, headers map<string,string>, payload string"
R = [
    (1, "response", "http://www.A.com/x/?b=2&a=1#f", 100, {"etag": '"v1"', "content-type": "text/html", "date": "d1"}, "one"),
    (2, "revisit", "https://a.com/x?a=1&b=2&utm_source=q", 200, {"etag": 'W/"v1"', "content-length": "0", "date": "d2"}, None),
    (3, "response", "http://a.com:80/x?a=1&b=2", 200_000, {"etag": '"v2"'}, "two"),
    (4, "revisit", "http://a.com/x?a=1&b=2", 300_000, {"etag": '"v1"'}, None),
    (5, "revisit", "http://a.com/x?a=1&b=2", 50, {"etag": '"v1"'}, None),
    (6, "revisit", "http://a.com/x?a=1&b=2", 300_001, None, None),
    (7, "response", None, None, None, "none"),
    (8, "revisit", None, 5, {"last-modified": "m"}, None),
    (9, "response", "http://b.org", 10, {"last-modified": "m"}, "bee"),
    (10, "revisit", "http://b.org/", 10, {"last-modified": "m", "server": "s"}, None),
    (10, "revisit", "http://b.org/", 10, {"last-modified": "m", "server": "s"}, None),
]


@pytest.mark.parametrize("bucket", [1, 1000, revisits.BUCKET, 10**9])
def test_resolve(spark, bucket):
    df = spark.createDataFrame(R, SCHEMA).withColumn("state", F.lit("clash")).repartition(3)
    got = sorted(((r["record_id"], r["response_id"], r["state"], r["payload"]) for r in revisits.resolve(df, bucket).collect()), key=lambda x: x[0])
    assert got == [
        (2, 1, "resolved", "one"), (4, 3, "changed", None), (5, None, "unresolved", None), (6, 3, "unchecked", "two"), (8, None, "unresolved", None),
        (10, 9, "resolved", "bee"), (10, 9, "resolved", "bee"),
    ]
    one = revisits.resolve(df, bucket).where("record_id = 2").first()
    assert one["headers"] == {"etag": 'W/"v1"', "content-type": "text/html", "date": "d2"} and one["canonical_url"] == "http://a.com/x?a=1&b=2"
    assert revisits.resolve(df.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [1000, revisits.BUCKET])
def test_null_ids_dates_and_partial_responses(spark, bucket):
    """A response without an id answers; null dates are before all, negative ones too; only status 200 is a full response; a repeated id keeps headers and body together."""
    rows = [
        (1, "response", "http://a/", 10, {"etag": "1"}, "old", 200),
        (None, "response", "http://a/", 20, {"etag": "2"}, "new", None),
        (2, "revisit", "http://a/", 30, {"etag": "2"}, None, 304),
        (3, "response", "http://b/", -200_000, {"etag": "b"}, "b", 200),
        (4, "revisit", "http://b/", None, {"etag": "b"}, None, 304),
        (5, "response", "http://c/", None, {"etag": "c"}, "c", 200),
        (6, "revisit", "http://c/", -300_000, {"etag": "c"}, None, 304),
        (7, "response", "http://c/", -250_000, {"etag": "c"}, "gone", 404),
        (8, "revisit", "http://c/", -200_000, {"etag": "c"}, None, 304),
        (9, "response", "http://d/", 5, {"etag": "d1"}, "d1", 200),
        (9, "response", "http://d/", 5, {"etag": "d2"}, "d2", 200),
        (10, "revisit", "http://d/", 6, {"server": "s"}, None, 304),
        (11, "revisit", "", 9, {"etag": "d1"}, None, 304),
        (12, "digest", "http://d/", 9, {"etag": "d1"}, None, 304),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", status int").repartition(2)
    got = {r["record_id"]: (r["response_id"], r["state"], r["payload"], (r["headers"] or {}).get("etag")) for r in revisits.resolve(df, bucket).collect()}
    assert got.pop(10) in ((9, "unchecked", "d1", "d1"), (9, "unchecked", "d2", "d2"))
    assert got == {
        2: (None, "resolved", "new", "2"), 4: (None, "unresolved", None, "b"), 6: (5, "resolved", "c", "c"), 8: (5, "resolved", "c", "c"), 11: (None, "unresolved", None, "d1"),
    }


def test_damaged_warc_files(spark, tmp_path):
    def record(kind, rid, http, length=None, more=""):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: <http://x.org/{rid}>\r\n{more}Content-Length: {len(http) if length is None else length}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    tricky = b"HTTP/1.1 200 OK\r\nVary: a\r\nVary: b\r\n\r\nhas\r\n\r\nWARC/1.0\r\nin it, and \xff\x00 bytes"
    plain = record("response", "one", tricky) + record("response", "bad", b"x", "abc") + record("revisit", "same", b"", more="WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    plain += record("response", "two", b"HTTP/1.1 404 Not Found\r\n\r\nno") + record("response", "cut", b"HTTP/1.1 200 OK\r\n\r\nshort", 5000)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "empty.warc").write_bytes(b"")
    whole = gzip.compress(record("response", "three", b"HTTP/1.1 200 OK\r\n\r\nyes"))
    (tmp_path / "b.warc.gz").write_bytes(whole + gzip.compress(record("response", "four", random.randbytes(50_000)))[:20_000])
    got = {r["record_id"]: r for r in revisits.read_warc(spark, str(tmp_path)).collect()}
    assert {"one", "same", "two", "three"} <= got.keys() <= {"one", "same", "two", "three"}
    assert bytes(got["one"]["payload"]) == tricky.partition(b"\r\n\r\n")[2] and got["one"]["headers"] == {"vary": "a, b"}
    assert (got["same"]["kind"], got["two"]["status"], got["three"]["status"], got["one"]["url"]) == ("digest", 404, 200, "http://x.org/one")


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    got = revisits.op4_warc_revisits(spark, sf).toPandas()
    want = con.sql(revisits.OP4_SQL).df()[list(got.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_warc_file(spark, tmp_path):
    def record(kind, rid, date, http):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Target-URI: http://x.org/a\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n"
        return gzip.compress(head.encode() + http + b"\r\n\r\n")

    body = b"HTTP/1.1 200 OK\r\nETag: \"q\"\r\nContent-Type: text/plain\r\n\r\nhello"
    data = record("warcinfo", "i", "2024-01-01T00:00:00Z", b"x") + record("response", "r", "2024-01-01T00:00:00Z", body)
    data += record("revisit", "v", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"q\"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = revisits.resolve(revisits.read_warc(spark, str(tmp_path))).collect()
    assert [(r["record_id"], r["response_id"], r["state"], bytes(r["payload"])) for r in got] == [("<v>", "<r>", "resolved", b"hello")]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_removed", F.lit("clash")).withColumn("a.b", F.lit(1))
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.schema.simpleString() == before.schema.simpleString(), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert None in texts and len(texts) > 20
    assert not any(x["spans"] for x in secrets.scan(docs, rules=secrets.BASE).collect())
    packed = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == texts.keys()
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_toxic_documents_go(spark, sf):
    net = toxicity.Network(1)
    net.constant = 0.5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert toxicity.drop_toxic(docs, net, threshold=0.4).count() == 0 and toxicity.drop_toxic(docs, net, threshold=0.6).count() == docs.count()
