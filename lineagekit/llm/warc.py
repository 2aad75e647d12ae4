"""WARC: a converter for legacy ARC archives, a writer and a reader, all on DataFrames.

* :func:`pack_arc` writes rows as ARC archives (version 1 or 2) in a binary column.
* :func:`read_arc` parses archives: the version block names the header fields of all records, each
  header line is read by those fields, and the body is cut by its declared length.
* :func:`arc_to_warc` synthesises what WARC asks for: record ids, dates, types and digests.
* :func:`mark_revisits` makes records of equal payloads revisits of one response.
* :func:`write_warc` lets Spark write WARC files, a gzip member a record. :func:`read_warc` reads them by
  Content-Length.

Nulls and edges: a null URL is ``-`` in ARC and has no WARC-Target-URI; white space in URLs is
percent-encoded; null payloads are empty; a null id stays null. A declared length beyond the end of
its archive gives the bytes that are there and ``truncated``. Malformed header lines raise
ValueError. Rows with the same id and payload as the response are responses too. Of null and other
ids in a group the smallest other id is the response; a group of null ids only has responses.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integers, new_path, prepare, table, written

# fixed values: the header fields of either ARC version
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
MEMBER = (16 << 20) - 1
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_RECORD = "url string, ip string, date string, content_type string, result_code string, filename string, block binary, truncated boolean"
WARC_PARTS = "source_id long, record_id string, warc_type string, head string, http_head binary, payload binary, payload_digest string"
WARC_RECORD = "page_id long, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, intact boolean, payload binary"


def _token(value) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) if value else "-"


def _line(version: int, url: str, ip: str, date: str, kind: str, code: str, offset: int, name: str, length: int) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lineagekit\n{' '.join(FIELDS[version])}\n".encode()
    return _line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", "200", 0, name, len(body)) + body


def arc_record(version: int, offset: int, url: str, ip: str, date: str, kind: str, code: str, name: str, block: bytes) -> bytes:
    return b"\n" + _line(version, url, ip, date, kind, code, offset, name, len(block)) + block


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one archive, without its version block."""
    at, fields = 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        parts = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if fields is None and not parts[0].startswith("filedesc:"):
            raise ValueError("no version block")
        names = fields or FIELDS[1 if len(parts) == len(FIELDS[1]) else 2]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"malformed header line at byte {at}: {parts[:3]}")
        record, length = dict(zip(names, parts)), int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if fields is None:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = tuple(lines[1].split(" ")) if len(lines) > 1 else FIELDS[version]
            continue
        yield {
            "url": record["URL"], "ip": record["IP-address"], "date": record["Archive-date"], "content_type": record["Content-type"],
            "result_code": record.get("Result-code"), "filename": record.get("Filename"), "block": block, "truncated": len(block) < length,
        }


def pack_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, date: str = "20000101000000", archive_bytes: int = 4 << 20, version: int = 2) -> DataFrame:
    """ARC archives (archive, content) of about ``archive_bytes`` each; the id is the record's file name."""

    def pack(frames):
        task, made, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            for i, url, html in zip(frame["i"], frame["url"], frame["html"]):
                if not parts:
                    name = f"part-{task:05d}-{made:05d}.arc"
                    parts = [arc_start(version, name, date)]
                    size = len(parts[0])
                payload = (html or "").encode("utf-8", "surrogatepass") if not isinstance(html, (bytes, bytearray)) else bytes(html)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                parts.append(arc_record(version, size, _token(url), "0.0.0.0", date, "text/html", "200", f"id:{i if i is not None else ''}", block))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [name], "content": [b"".join(parts)]})
                    parts, made = [], made + 1
        if parts:
            yield pd.DataFrame({"archive": [name], "content": [b"".join(parts)]})

    rows = pages.select(F.col(id_col).cast("string").alias("i"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    return rows.mapInPandas(pack, "archive string, content binary")


def read_arc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """Records of ARC archives held in a binary column (as Spark's ``binaryFile`` source gives them)."""

    def parse(frames):
        for frame in frames:
            for content in frame["content"]:
                batch, size = [], 0
                for record in parse_arc(bytes(content or b"")):
                    batch.append(record)
                    size += len(record["block"])
                    if size > 8 << 20:
                        yield pd.DataFrame(batch)
                        batch, size = [], 0
                if batch:
                    yield pd.DataFrame(batch)

    return archives.select(F.col(content_col).alias("content")).mapInPandas(parse, ARC_RECORD)


def _stamp(date: str) -> str:
    d = (re.sub(r"\D", "", date or "") + "00000101000000"[len(re.sub(r"\D", "", date or "")) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(record: dict) -> dict:
    """What WARC asks for, of one ARC record."""
    block, head = record["block"], b""
    is_http = block[:5] == b"HTTP/"
    if is_http:
        cut = block.find(b"\r\n\r\n")
        cut = cut + 4 if cut >= 0 else len(block)
        head, block = block[:cut], block[cut:]
    digest = hashlib.sha256(block).hexdigest()
    name, stamp = record["filename"] or "", _stamp(record["date"])
    record_id = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([record["url"], stamp, name, digest]))
    lines = [f"WARC-Date: {stamp}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: {'application/http; msgtype=response' if is_http else record['content_type']}"]
    lines += [f"WARC-Target-URI: {record['url']}"] * (record["url"] != "-") + [f"WARC-IP-Address: {record['ip']}"] * (record["ip"] not in ("-", "0.0.0.0"))
    lines += ["WARC-Truncated: length"] * bool(record["truncated"])
    source = int(name[3:]) if re.fullmatch(r"id:-?\d+", name) else None
    if source is not None:
        lines.append(f"X-Source-Id: {source}")
    return {"source_id": source, "record_id": f"<urn:uuid:{record_id}>", "warc_type": "response" if is_http else "resource", "head": "\r\n".join(lines) + "\r\n", "http_head": head, "payload": block, "payload_digest": digest}


def arc_to_warc(records: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = pd.DataFrame([convert(r) for r in frame.to_dict("records")], columns=[c.split()[0] for c in WARC_PARTS.split(", ")])
            yield out.assign(source_id=integers(out["source_id"]))

    return records.mapInPandas(run, WARC_PARTS)


def mark_revisits(parts: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds refers_to, refers_to_id: of records with equal payloads of at least ``least_bytes`` all but that with
    the smallest source id (null ids last) refer to it.

    The first record of each payload comes of an aggregate of digests; records join it by their digest,
    one row a payload, which Spark can split. Rows that repeat the smallest id are all responses.
    """
    large = parts.where(F.octet_length("payload") >= least_bytes)
    first = F.min(F.struct(F.col("source_id").isNull().alias("none"), "source_id", "record_id")).alias("first")
    firsts = large.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").select("payload_digest", F.col("first.source_id").alias("first_id"), F.col("first.record_id").alias("first_record"))
    joined = parts.join(firsts, "payload_digest", "left")
    later = F.col("first_record").isNotNull() & (F.col("record_id") != F.col("first_record")) & ~F.coalesce(F.col("source_id") == F.col("first_id"), F.lit(False))
    return joined.withColumn("refers_to", F.when(later, F.col("first_id"))).withColumn("refers_to_id", F.when(later, F.col("first_record"))).drop("first_id", "first_record")


def members(data: bytes) -> bytes:
    """Gzip members of some data, each of less than ``MEMBER`` bytes uncompressed, so that they end with a zero byte."""
    out = []
    for at in range(0, max(1, len(data)), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(data[at : at + MEMBER]) + z.flush())
    return b"".join(out)


def write_warc(parts: DataFrame, path: str) -> None:
    """Records as WARC/1.1 files, a gzip member a record (several from 16 MB on), a warcinfo record first.

    Revisits keep the HTTP head only and name the record they refer to. Files are written by Spark's text
    writer, one a task, so they are as large as its partitions. The last byte of a member is the highest of
    its uncompressed length, zero below 16 MB: that byte is the line separator.
    """
    revisit = F.col("refers_to_id").isNotNull()
    block = F.when(revisit, F.col("http_head")).otherwise(F.concat("http_head", "payload"))
    known = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("X-Refers-To-Source: "), F.col("refers_to").cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.col("warc_type")), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\n"), F.col("head"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {IDENTICAL}\r\nWARC-Refers-To: "), F.col("refers_to_id"), F.lit("\r\n"), known)).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )

    def compress(batches):
        first = True
        for batch in batches:
            made = [members(h.encode("utf-8", "surrogateescape") + b + b"\r\n\r\n")[:-1] for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if first and made:
                made.insert(0, members(warcinfo(f"part-{TaskContext.get().partitionId():05d}"))[:-1])
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    rows = parts.select(head.alias("head"), block.alias("block")).mapInArrow(compress, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def warcinfo(name: str) -> bytes:
    fields = b"software: lineagekit\r\nformat: WARC File Format 1.1\r\n"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n".encode() + fields + b"\r\n\r\n"


class _Stream:
    """Inflates a gzip file bit by bit (members may follow one another)."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.z = memoryview(data), 0, bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        if self.z.eof:
            rest = self.z.unused_data
            self.at -= len(rest)
            self.z = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 14)]
        self.at += len(piece)
        self.buffer += self.z.decompress(piece)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_warc(data: bytes) -> Iterator[dict]:
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC version line: {first[:40]}")
        names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(names["content-length"]))
        if len(block) < int(names["content-length"]) or stream.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        http, payload = b"", block
        if names.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n") + 4
            http, payload = block[:cut], block[cut:]
        kind = names["warc-type"]
        if kind == "warcinfo":
            continue
        digest = names["warc-payload-digest"].partition(":")[2]
        if kind == "revisit":  # the payload isn't here, so nothing was compared
            length, intact = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1]), None
        else:
            length, intact = len(payload), hashlib.sha256(payload).hexdigest() == digest
        number = lambda k: int(names[k]) if k in names else None
        yield {
            "page_id": number("x-source-id"), "record_id": names["warc-record-id"], "record_type": kind, "target_uri": names.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": digest, "refers_to": number("x-refers-to-source"), "refers_to_id": names.get("warc-refers-to"), "intact": intact, "payload": payload if kind != "revisit" else None,
        }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the gzipped WARC files under ``path``; with ``payloads`` false their column is null."""

    def run(frames):
        def made(batch: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(batch).assign(**{c: integers([r[c] for r in batch]) for c in ("page_id", "refers_to")})

        for frame in frames:
            for content in frame["content"]:
                batch, size = [], 0
                for record in parse_warc(content):
                    size += 500 + len(record["payload"] or b"") * payloads
                    batch.append(record if payloads else record | {"payload": None})
                    if size > 8 << 20:
                        yield made(batch)
                        batch, size = [], 0
                if batch:
                    yield made(batch)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, WARC_RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    parts = written(arc_to_warc(read_arc(pack_arc(pages))), "records")
    path = new_path(spark, "warc")
    write_warc(mark_revisits(parts), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to, CASE WHEN f.first_id <> p.page_id THEN NULL ELSE true END AS intact
FROM p LEFT JOIN f USING (payload_digest)
"""
}
