"""WARC archives: writing with segmentation and chunked framing, splittable reading, reassembly."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, prepare_python, saved, sent_if_small, thrifty

SEGMENT_BYTES, CHUNK_BYTES = 32_768, 8_192
#: Revisits whose ids are sent to all executors; more are joined by a shuffle.
BROADCAST_REVISITS = 500_000
VERSION = b"WARC/1.1\r\n"
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target string, segment int, origin string, total long, refers_to string, digest string, content binary, problem string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk also ends inside each version line in the payload, so that none stands in the archive."""
    cuts = set(range(chunk_bytes, len(payload), chunk_bytes))
    at = payload.find(VERSION)
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(VERSION, at + 1)
    out, start = [], 0
    for end in [*sorted(cuts), len(payload)]:
        if end > start:
            out += [b"%x\r\n" % (end - start), payload[start:end], b"\r\n"]
            start = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing, extensions and trailers included. Raises ValueError if it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end of a chunk's size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its head, without transfer framing."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP head")
    fields = _fields(head)
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unchunked(body)
    if "content-length" in fields and int(fields["content-length"]) != len(body):
        raise ValueError("the body does not have its stated length")
    return body


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, copy: str = "0") -> Iterator[bytes]:
    """The records of a page: a revisit; or a response, cut into a first segment and continuations if its block is long.

    A record's id has the page's id, the payload's digest and `copy`, which tells rows with the same id and payload apart;
    a revisit refers to the id and digest of its response, whichever copy of it.
    """
    own = digest_of(payload)
    name, digest = f"{URN}{page_id}:{own}:{copy}", f"sha1:{own}"
    target = "".join((url or "").split()) or None
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", name, block, WARC_Target_URI=target, WARC_Profile=PROFILE, WARC_Payload_Digest=digest, WARC_Refers_To=f"<{URN}{refers_to}:{own}>", Content_Type="application/http;msgtype=response")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield _record("response", name, parts[0], WARC_Target_URI=target, WARC_Payload_Digest=digest, WARC_Segment_Number=1 if several else None, Content_Type="application/http;msgtype=response")
    for n, part in enumerate(parts[1:], 2):
        yield _record("continuation", f"{name}:{n}", part, WARC_Target_URI=target, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def first_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, key, bytes, refers_to) of the payloads, of at least `min_bytes`, that a page with a lesser id has as well.

    Only ids, digests and lengths are shuffled; a large group is aggregated before its shuffle, and the join back to
    its rows is one that adaptive execution splits. Rows that repeat a page_id are told apart by their payloads.
    """
    keys = pages.select("page_id", _key().alias("key"), F.length("payload").alias("bytes")).where(F.col("bytes") >= min_bytes)
    firsts = keys.groupBy("key", "bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return keys.join(firsts, ["key", "bytes"]).where("page_id > refers_to").select("page_id", "key", "bytes", "refers_to").distinct()


def _key():
    return F.sha2("payload", 256)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a WARC record for each row of pages (page_id, url, payload), with Spark's committed text writer.

    Rows without a page_id have no record. Every other row has one with an id of its own: rows that share an id and a
    payload as well, which are all responses if no lesser page has that payload.
    """
    spark = pages.sparkSession
    prepare_python(spark)
    pages = pages.where("page_id is not null")
    revisits = sent_if_small(saved(first_pages(pages, min_bytes), "warc-revisits"), BROADCAST_REVISITS)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for frame in batches:
            out = []
            for page_id, url, payload, refers_to in zip(frame["page_id"], frame["url"], frame["payload"], frame["refers_to"], strict=True):
                of = None if pd.isna(refers_to) else int(refers_to)
                # the writer ends a row with a line feed, which is the last byte of a record
                out += [r[:-1] for r in page_records(int(page_id), url, payload, of, segment_bytes, chunk_bytes, f"{part}.{row}")]
                row += 1
            yield pd.DataFrame({"record": out})

    keyed = pages.withColumn("key", _key()).withColumn("bytes", F.length("payload"))
    rows = keyed.join(revisits, ["page_id", "key", "bytes"], "left").select("page_id", "url", "payload", "refers_to")
    rows.mapInPandas(thrifty(records), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def parse_record(raw: bytes) -> dict:
    """A record from its version line (or what follows it) on; what follows its stated length is left out."""
    head, gap, rest = raw.removeprefix(VERSION).partition(b"\r\n\r\n")
    fields = _fields(b"\r\n" + head)
    length = int(fields.get("content-length", "-1"))
    problem = None if gap and 0 <= length <= len(rest) else "the block does not have its stated length"
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target": fields.get("warc-target-uri"),
        "segment": number("warc-segment-number"), "origin": bare("warc-segment-origin-id"), "total": number("warc-segment-total-length"),
        "refers_to": bare("warc-refers-to"), "digest": fields.get("warc-payload-digest"),
        "content": rest[: max(length, 0)], "problem": problem,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed archives. Files are split at version lines, so one of any size is read by many tasks."""
    prepare_python(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = pd.DataFrame([parse_record(x) for x in frame["raw"]], columns=[c.split()[0] for c in RECORD.split(", ")])
            yield rows.astype({"segment": "Int32", "total": "Int64"})

    lines = spark.read.option("lineSep", "\n" + VERSION.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("raw")).where(F.length("raw") > 0).mapInPandas(thrifty(parse), RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: (record_id, record_type, target, refers_to, digest, content, problem).

    Only segmented records are shuffled: grouped by the identifier of their origin, ordered by segment number. Segments
    must be numbered 1 to n without gaps, and their lengths must add up to the total that the last states; else
    `problem` says what is wrong and the content is null. A segment that is there twice counts once (the least content).
    """
    plain = ["record_id", "record_type", "target", "refers_to", "digest", "content", "problem"]
    whole = records.where("segment is null").select(*plain)
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    once = parts.groupBy("origin", "segment").agg(F.min_by(F.struct("record_type", "target", "refers_to", "digest", "total", "content", "problem"), F.col("content")).alias("s"))
    groups = once.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "s"))).alias("parts"))
    first = F.col("parts")[0]
    content = F.array_join(F.transform("parts", lambda p: p["s"]["content"].cast("string")), "").cast("binary")
    total = F.array_max(F.transform("parts", lambda p: p["s"]["total"]))
    numbers = F.transform("parts", lambda p: p["segment"])
    wrong = F.array_max(F.transform("parts", lambda p: p["s"]["problem"]))
    joined = groups.select(
        F.col("origin").alias("record_id"), first["s"]["record_type"].alias("record_type"), first["s"]["target"].alias("target"),
        first["s"]["refers_to"].alias("refers_to"), first["s"]["digest"].alias("digest"), content.alias("content"),
        F.when(wrong.isNotNull(), wrong)
        .when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments are missing")
        .when(total.isNull() | (total != F.length(content)), "the segments do not have the stated total length")
        .alias("problem"),
    )
    return whole.unionByName(joined.withColumn("content", F.when(F.col("problem").isNull(), F.col("content"))))


def page_of(record_id: str) -> int:
    """The page's id that a record's id has."""
    return int(record_id.removeprefix(URN).split(":")[0])


def payloads(whole: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload, problem) of whole response and revisit records.

    A response's figures come from its decoded payload and must agree with the digest that it states; a revisit has
    none, so its own head states them.
    """
    prepare_python(whole.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                page, refers = page_of(r.record_id), None if r.refers_to is None else page_of(r.refers_to)
                size, digest, payload, problem = None, None, None, r.problem
                try:
                    if problem is None and r.record_type == "revisit":
                        size, digest = int(_fields(r.content)["content-length"]), r.digest.removeprefix("sha1:")
                    elif problem is None:
                        payload = http_payload(r.content)
                        size, digest = len(payload), digest_of(payload)
                        if r.digest not in (None, f"sha1:{digest}"):
                            problem = "the payload does not have its stated digest"
                except (ValueError, KeyError) as e:
                    problem = str(e)
                out.append((page, size, digest, r.record_type, refers, payload, problem))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"]).astype({"payload_bytes": "Int64", "refers_to": "Int64"})

    return whole.where("record_type in ('response', 'revisit')").mapInPandas(thrifty(decode), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write an archive of pages (page_id, url, html) and return what reading it back gives, one row a page.

    Null html is an empty payload, a null url a record without a target; rows without a page_id have no record. Rows that
    repeat a page_id, with the same payload or another, are one row each; payloads of any length are segmented. Nothing is
    lost or guessed: a record that can't be read back has its `problem` stated. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    to = path or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    write_archives(rows, to, min_bytes)
    return payloads(reassemble(read_archives(spark, to)))
