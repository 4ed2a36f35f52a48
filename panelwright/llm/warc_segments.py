"""WARC archives: writing with revisits and segments, reading with reassembly.

Archives are written by Spark's text writer with CRLF CRLF between records, so any store
that Spark writes to will do; they are gzip files of at most `records_per_file` records of
at most `segment_bytes` each, so a reader task's memory has a bound. HTTP bodies go out
in chunked transfer framing. A block longer than a segment is cut: the first record
keeps its type, the rest are continuation records, which may land in other archives.

Reading frames records by Content-Length, in files of one gzip member or of a member a
record, groups segments by origin id (only those of segmented records are shuffled), orders
them by number, verifies that none is missing and that the bytes add up to the stated
total, decodes the chunks and compares the payload with its digest header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_scan, row_number, shared_folder, text_of, written

CHUNK_BYTES, SEGMENT_BYTES, RECORDS_PER_FILE = 4096, 16_384, 4096
#: Payloads below this are always stored, never revisited.
LEAST_REVISIT = 100
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD = "record_id string, record_type string, page_id string, segment_number int, origin_id string, total_length long, refers_to string, stated string, block binary, payload_bytes long, payload_digest string, payload binary"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        start = end + 2
        if body[start + n : start + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[start : start + n])
        at = start + n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, name: str, block: bytes, **fields) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(row, segment_bytes: int) -> Iterator[bytes]:
    name, page = f"urn:page:{row.row}", None if row.page_id is None else quote(row.page_id)
    uri = (row.url or "").replace("\r", "%0D").replace("\n", "%0A") or None
    fields = {"WARC_Target_URI": uri, "WARC_Page_Id": page, "WARC_Payload_Digest": f"sha256:{row.digest}", "Content_Type": "application/http; msgtype=response"}
    if not pd.isna(row.refers_row):
        yield record("revisit", name, HTTP + b"\r\n", WARC_Refers_To=f"<urn:page:{int(row.refers_row)}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **fields)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row.html.encode())
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", name, block, **fields)
        return
    yield record("response", name, parts[0], WARC_Segment_Number=1, **fields)
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield record("continuation", f"{name}:{n}", part, WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=total, WARC_Target_URI=uri)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """row -> refers_row (as text, since pandas makes floats of numbers with nulls) of the pages whose payload, of LEAST_REVISIT bytes or more, a smaller id has."""
    html = text_of(html_col)
    pages = as_scan(pages)
    rows = written(
        pages.select(row_number(pages).alias("row"), F.col(id_col).alias("id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
        .filter(F.col("n") >= LEAST_REVISIT).drop("n"),
        "payloads",
    )
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, "digest").filter(F.col("first.row") != F.col("row")).select("row", F.col("first.row").cast("string").alias("refers_row"))


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write a record per page; returns the archives' folder (by default one in the shared folder).

    A null payload is empty. Of equal payloads of LEAST_REVISIT bytes or more the page
    of the smallest id (null last) is the response, repeated rows of one id included. Ids
    may be of any type that has a text form. An empty table gives an empty folder.
    """
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = text_of(html_col)
    pages = as_scan(pages)
    rows = pages.select(
        row_number(pages).alias("row"), F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    ).join(plan_revisits(pages, id_col, html_col), "row", "left")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"record": [x for row in batch.itertuples(index=False) for x in records_of(row, segment_bytes)]})

    records = rows.mapInPandas(build, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def unzipped(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file one after the other, or a plain file as it is; of a broken member what can be read."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        try:
            yield member.decompress(data)
        except zlib.error:
            return
        data = member.unused_data.lstrip(b"\0")


def parse(members: Iterator[bytes]) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """Header fields (lower case) and block of each record, framed by Content-Length; None for fields, once, where a file breaks off or isn't framed.

    A record may go over members; those read are dropped, so that no more than a member
    and a record are held.
    """
    data, at = b"", 0
    for member in chain(members, [None]):
        data, at = data[at:] + (member or b""), 0
        while at < len(data):
            begin = at + (4 if data[at : at + 4] == b"\r\n\r\n" else 0)  # the end of the record before
            if begin == len(data):
                at = begin
                break
            end = data.find(b"\r\n\r\n", begin)
            if end >= 0:
                version, *lines = data[begin:end].decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                length = fields.get("content-length", "")
                if not version.startswith("WARC/") or not length.isdecimal() or not {"warc-type", "warc-record-id"} <= set(fields):
                    yield None, data[begin:end]
                    return
                if end + 4 + int(length) <= len(data):
                    at = end + 4 + int(length)
                    yield fields, data[end + 4 : at]
                    continue
            if member is None:
                if data[begin:].strip():
                    yield None, data[begin:]
                return
            break


def as_stated(payload: bytes, stated: str | None) -> bool:
    """Whether a payload has the digest of its header, algorithm:value; others than SHA-256 and SHA-1 (in hex or base 32) are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return True
    digest = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == digest.hex() or value.upper() == base64.b32encode(digest).decode()


def judged(block: bytes, stated: str | None, keep: bool) -> tuple:
    try:
        payload = payload_of(block)
    except ValueError:
        return None, None, None
    if not as_stated(payload, stated):
        return None, None, None
    return len(payload), hashlib.sha256(payload).hexdigest(), payload if keep else None


def bare(x: str | None) -> str | None:
    return x.strip("<>") if x else None


def read_archives(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """One row per logical record: record_id, record_type, page_id (of id_type), refers_to, complete, payload_bytes, payload_digest (and payload).

    complete is false, and the payload null, where a segment is missing or repeated, the
    lengths don't add up, a chunk is broken or the payload is not what its digest header
    says; such records stay in the result. A file that breaks off, or can't be framed
    from some place on, adds one record of type broken, with the file as its id, beside
    those before that place. A revisit takes bytes and digest from the response it
    refers to. A task holds one file at a time, as it is stored, and a record of it.
    """
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number_of = lambda x: int(x) if (x or "").isdecimal() else None
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for f, block in parse(unzipped(content)):
                    if f is None:
                        out.append((file, "broken", None, None, file, None, None, None, None, None, None, None))
                        continue
                    kind, number, stated = f["warc-type"], number_of(f.get("warc-segment-number")), f.get("warc-payload-digest")
                    name, page = bare(f["warc-record-id"]), f.get("warc-page-id")
                    whole = number is None and kind != "revisit"
                    got = judged(block, stated, payloads) if whole else (None, None, None)
                    out.append((name, kind, unquote(page) if page else None, number, bare(f.get("warc-segment-origin-id")) or name, number_of(f.get("warc-segment-total-length")), bare(f.get("warc-refers-to")), stated, None if whole or kind == "revisit" else block, *got))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
                yield frame.astype({"segment_number": "Int64", "total_length": "Int64", "payload_bytes": "Int64"})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [judged(x, stated, payloads) if x is not None else (None, None, None) for x, stated in zip(batch["block"], batch["stated"], strict=True)]
            frame = batch[["record_id", "record_type", "page_id", "refers_to"]].copy()
            frame[["payload_bytes", "payload_digest", "payload"]] = pd.DataFrame(got, columns=["a", "b", "c"], index=batch.index)
            yield frame.astype({"payload_bytes": "Int64"})

    records = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, RECORD)
    records = written(records, "records")
    plain = ["record_id", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"]
    first = F.col("segment_number") == 1
    parts = (
        records.filter("segment_number is not null")
        .groupBy("origin_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment_number", "block"))).alias("parts"),
            F.max("total_length").alias("total_length"),
            *(F.max(F.when(first, F.col(c))).alias(c) for c in ("record_type", "page_id", "refers_to", "stated")),
        )
        .withColumn("whole", F.array_join(F.transform("parts", lambda p: p.block.cast("string")), "").cast("binary"))
        .withColumn("in_order", F.transform("parts", lambda p: p.segment_number) == F.sequence(F.lit(1), F.size("parts")))
        .select(
            F.col("origin_id").alias("record_id"), "record_type", "page_id", "refers_to", "stated",
            F.when(F.col("in_order") & (F.octet_length("whole") == F.col("total_length")), F.col("whole")).alias("block"),
        )
        .mapInPandas(decode, "record_id string, record_type string, page_id string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    )
    whole = records.filter("segment_number is null").select(*plain).unionByName(parts)
    stored = whole.filter("record_type != 'revisit'").select(F.col("record_id").alias("target"), *(F.col(c).alias(f"of_{c}") for c in ("page_id", "payload_bytes", "payload_digest", "payload")))
    # records that refer to nothing stay out of the join, where their nulls would be one hot key
    alone, refers = whole.filter("refers_to is null"), whole.filter("refers_to is not null")
    joined = refers.join(stored, F.col("refers_to") == F.col("target"), "left").select(
        "record_id", "record_type", "page_id", F.col("of_page_id").alias("refers_to"),
        *(F.coalesce(c, f"of_{c}").alias(c) for c in ("payload_bytes", "payload_digest", "payload")),
    )
    out = alone.unionByName(joined).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")}).withColumn("complete", F.col("payload_digest").isNotNull())
    return out if payloads else out.drop("payload")
