"""WARC archives: write pages as response, revisit and continuation records, read them back and reassemble segments.

Archives are written and read by Spark's own file sources, so they can lie wherever Spark can write.
A block is an HTTP response with chunked transfer framing; a block longer than a segment goes on in
continuation records, which are put together again by their origin's identifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.llm.shared import cut, fresh, partitions

CRLF = b"\r\n"
SEGMENT, CHUNK, PER_FILE = 32 << 10, 8 << 10, 500
ID = "<urn:page:%d:%s:%d>"
_ID = re.compile(rb"<urn:page:(-?\d+):([0-9a-f]{40}):(\d+)>")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


class Dechunker:
    """Decodes chunked transfer framing fed in pieces of any size; `feed` returns the payload bytes so far unseen."""

    def __init__(self):
        self.rest, self.left, self.done = b"", 0, False

    def feed(self, data: bytes) -> bytes:
        buf, at, out = self.rest + data, 0, []
        while not self.done:
            if self.left > 2:
                take = buf[at : at + self.left - 2]
                if not take:
                    break
                out.append(take)
                at += len(take)
                self.left -= len(take)
                continue
            if self.left:  # the line end after a chunk
                if len(buf) - at < self.left:
                    break
                at += self.left
                self.left = 0
            end = buf.find(CRLF, at)
            if end < 0:
                break
            size = int(buf[at:end].split(b";")[0], 16)
            at = end + 2
            if size == 0:
                self.done = True
            self.left = size + 2
        self.rest = b"" if self.done else buf[at:]
        return b"".join(out)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def records(page_id: int, copy: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The records of one page, without the blank lines after each. They are named by page, payload digest and the rank among equal rows."""
    rid = ID % (page_id, digest, copy)
    head = [("WARC-Record-ID", rid), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *head, ("WARC-Refers-To", ID % (refers_to, digest, 0)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")], http + CRLF)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    more = len(block) > SEGMENT
    yield _record([("WARC-Type", "response"), *head, ("Content-Type", "application/http; msgtype=response"), *([("WARC-Segment-Number", "1")] if more else [])], block[:SEGMENT])
    for n, i in enumerate(range(SEGMENT, len(block), SEGMENT), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i + SEGMENT >= len(block) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{n}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(n)), *last], block[i : i + SEGMENT])


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write pages (page_id, url, html) as WARC files under path.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response and the
    others revisit it. A null html is an empty payload, a null url an empty one. Rows that repeat a page_id with an
    equal payload: each gets its record (all of the largest page_id are responses), with a rank that tells them apart; a
    revisit refers to rank 0, which always exists. A null page_id is written as -1. Extra columns are ignored.
    """
    spark = pages.sparkSession
    p = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    narrow = p.where(F.col("size") >= least).select("page_id", "digest", "size")
    many = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(narrow.join(many, ["digest", "size"]).where("page_id < refers_to").distinct().select("page_id", F.col("digest").alias("d"), "refers_to"), "revisits")
    # equal rows of one page, as a rule none: counted before they are dealt, then written out again by rank
    twice = cut(p.groupBy("page_id", "digest").count().where("count > 1").select(F.col("page_id").alias("pid"), F.col("digest").alias("d")), "twice")
    ranked = p.withColumn("copy", F.lit(0))
    if not twice.isEmpty():
        same = (p["page_id"] == twice["pid"]) & (p["digest"] == twice["d"])
        alike = p.join(twice, same, "left_semi").groupBy("page_id", "digest", "size", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("page_id", "digest").orderBy("url").rowsBetween(Window.unboundedPreceding, -1))
        runs = alike.withColumn("upto", F.coalesce(upto, F.lit(0))).withColumn("begin", F.explode(F.expr("sequence(upto, upto + n - 1, 1000)")))
        runs = runs.repartition(partitions(spark), "page_id", "digest", "begin")  # copies of one row are written by many tasks
        copies = runs.select(*p.columns, F.explode(F.expr("sequence(begin, least(begin + 999, upto + n - 1))").cast("array<int>")).alias("copy"))
        ranked = p.join(twice, same, "left_anti").withColumn("copy", F.lit(0)).unionByName(copies)
    joined = ranked.join(again.withColumnRenamed("page_id", "pid"), (F.col("page_id") == F.col("pid")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for page, url, payload, digest, ref, copy in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for r in records(page, copy, url, payload, digest, ref):
                    rows.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(rows, pa.binary())], names=["value"])
                    rows, size = [], 0
            yield pa.record_batch([pa.array(rows, pa.binary())], names=["value"])

    made = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", PER_FILE).text(path)


RAW = pa.schema([("origin", pa.string()), ("seg", pa.int64()), ("type", pa.string()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("block", pa.binary())])
RAW_DDL = "origin string, seg long, type string, total long, refers_to string, digest string, size long, block binary"


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, framed by Content-Length; a truncated or malformed record raises."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].split(CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(h[b"content-length"])
        begin = head_end + 4
        block = data[begin : begin + n]
        if len(block) < n:
            raise ValueError("a record is cut off")
        if data[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        at = begin + n + 4
        kind = h[b"warc-type"].decode()
        yield {
            "origin": h[b"warc-segment-origin-id" if kind == "continuation" else b"warc-record-id"].decode(), "seg": int(h.get(b"warc-segment-number", b"0")), "type": kind, "total": int(h.get(b"warc-segment-total-length", b"-1")),
            "refers_to": h[b"warc-refers-to"].decode() if b"warc-refers-to" in h else None, "digest": h.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:"), "size": int(h.get(b"x-payload-length", b"-1")), "block": block,
        }


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From records in order of origin and segment to a row a page, block by block: no page is held whole."""
    out, cur = [], None

    def end():
        if cur["type"] == "revisit":
            out.append((cur["page"], cur["size"], cur["digest"], "revisit", cur["origin"], cur["refers_to"]))
            return
        if not cur["chunks"].done:
            raise ValueError(f"{cur['origin']}: the chunked body does not end")
        if cur["seg"] and cur["total"] != cur["length"]:
            raise ValueError(f"{cur['origin']}: {cur['length']} bytes in segments, {cur['total']} announced")
        if cur["hash"].hexdigest() != cur["digest"] or cur["n"] != cur["size"]:
            raise ValueError(f"{cur['origin']}: the payload does not match its digest")
        out.append((cur["page"], cur["n"], cur["hash"].hexdigest(), "response", cur["origin"], None))

    for b in batches:
        for r in b.to_pylist():
            if cur is None or r["origin"] != cur["origin"]:
                if cur:
                    end()
                if r["type"] == "continuation":
                    raise ValueError(f"{r['origin']}: the first segment is missing")
                cur = r | {"page": int(_ID.search(r["origin"].encode())[1]), "chunks": Dechunker(), "hash": hashlib.sha1(), "n": 0, "length": 0, "head": b"", "body": False}
                if r["type"] == "revisit":
                    continue
            elif r["seg"] != cur["seg"] + 1:
                raise ValueError(f"{r['origin']}: segment {r['seg']} after {cur['seg']}")
            cur["seg"], cur["total"] = r["seg"], max(cur["total"], r["total"])
            cur["length"] += len(r["block"])
            data = r["block"]
            if not cur["body"]:
                cur["head"] += data
                head, sep, data = cur["head"].partition(b"\r\n\r\n")
                if not sep:
                    continue
                if b"transfer-encoding: chunked" not in head.lower():
                    raise ValueError(f"{r['origin']}: the body is not chunked")
                cur["body"], cur["head"] = True, b""
            got = cur["chunks"].feed(data)
            cur["n"] += len(got)
            cur["hash"].update(got)
        if len(out) > 2000:
            yield _rows(out)
            out = []
    if cur:
        end()
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "record", "target"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives under path.

    Records in one piece are decoded where they are read; segments are dealt by origin and sorted by number. Missing
    or repeated segments, a wrong total length, broken framing, digests that do not match and revisits of records that
    are not there raise.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for r in parse_archive(data.as_py()):
                    rows.append(r)
                    size += len(r["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=RAW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RAW)

    raw = files.mapInArrow(run, RAW_DDL)
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, record string, target string"
    whole = raw.where("seg = 0").mapInArrow(_digests, ddl)
    parts = raw.where("seg > 0").repartition(partitions(spark), "origin").sortWithinPartitions("origin", "seg")
    got = cut(whole.unionByName(parts.mapInArrow(_digests, ddl)), "records")
    # the targets that are asked for, each once, before they meet the responses; then every revisit has its target's page
    asked = got.where("target is not null").groupBy(F.col("target").alias("t")).count().select("t")
    there = got.where("record_type = 'response'").join(asked, F.col("record") == F.col("t"), "left_semi").select(F.col("record").alias("at"), F.col("page_id").alias("to"))
    out = got.join(there, F.col("target") == F.col("at"), "left")
    lost = F.raise_error(F.concat(F.col("record"), F.lit(" revisits a record that is not there: "), F.col("target"))).cast("long")
    refers = F.when(F.col("target").isNull(), F.lit(None).cast("long")).when(F.col("at").isNull(), lost).otherwise(F.col("to"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read them back. An empty table gives an empty result."""
    path = fresh(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
