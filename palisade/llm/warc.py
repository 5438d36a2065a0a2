"""WARC archives with a two-level capture index.

Writing: each task writes gzip members, one per record, to files of its own in the shared folder, and returns where
they are. A file of a failed attempt is in no result, so nothing refers to it. Of records with equal payloads of at
least `min_bytes`, that with the smallest id is a response and the others are revisits of it, found by a count over
payload digests before writing.

Index: captures are sorted by key (reversed host and path, capture time, id) and written as blocks of LINES lines, each
a gzip member. The first level is a sparse directory beside each index file, with the first key, offset and length of
each block; above it is one line per index file. A look-up finds the file in the top level and the block in the
directory by binary search, then reads just that block's range and just the records' ranges.

Defined cases: a null payload is empty; a null url has the key "-"; null ids are written as null and never are
revisited; rows that share the smallest id of a digest are all responses; an empty table gives an empty index. White
space and control characters of urls are percent-encoded in keys. Only the named columns are used.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import os
import re
import uuid
import zlib
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import by_value, materialise, shared_dir

by_value(__name__)
LINES, FILE_BYTES, READ_BYTES = 3000, 1 << 30, 1 << 22
CAPTURED = "2020-01-01T00:00:00Z"
CAPTURE = "key string, id long, file string, offset long, length long"


def sort_key(url: str | None, captured: str, page_id: int | None) -> str:
    """Reversed host, path and query; capture time; id. Spaces only part these three."""
    if url is None:
        surt = "-"
    else:
        m = re.match(r"(?:[^:/?#]*:)?(?://)?([^/?#]*)([^#]*)", url, re.S)
        name, _, port = m[1].lower().rpartition("@")[2].partition(":")
        surt = ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")
        surt = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", surt)
    number = "null" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{surt} {re.sub('[^0-9]', '', captured)} {number}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, captured: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {captured}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:])
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class Ranges:
    """Range reads of the files of the shared folder; neighbouring ranges share a read."""

    def __init__(self) -> None:
        self.name, self.file, self.start, self.held = None, None, 0, b""

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            system, path = fs.FileSystem.from_uri(name)
            self.name, self.file, self.start, self.held = name, system.open_input_file(path), 0, b""
        if not self.start <= offset <= offset + length <= self.start + len(self.held):
            self.file.seek(offset)
            self.start, self.held = offset, self.file.read(max(length, READ_BYTES))
        return self.held[offset - self.start : offset - self.start + length]


class Members:
    """Writes gzip members to a new file and tells where they are."""

    def __init__(self, folder: str, kind: str) -> None:
        self.name, self.at = f"{folder}/{kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz", 0
        system, path = fs.FileSystem.from_uri(self.name)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.file = system.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        member = gzip.compress(data, 6, mtime=0)
        self.file.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, captured: str = CAPTURED, folder: str | None = None) -> DataFrame:
    """Write all rows as records; returns their captures (CAPTURE)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body"), F.unhex(F.sha1(body)).alias("digest"))
    long_enough = F.octet_length("body") >= min_bytes
    firsts = pages.filter(long_enough & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = materialise(firsts, "warc-firsts")
    # found without the bodies, so that copies of one payload don't meet in one task with them
    copies = pages.filter(long_enough).select("id", "digest").distinct().join(firsts, "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
    copies = copies.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    rows = pages.join(copies, same, "left").select("id", "url", "body", "refers")

    def save(batches):
        out = None
        for pdf in batches:
            found = []
            for i, u, b, r in zip(pdf["id"], pdf["url"], pdf["body"], pdf["refers"], strict=True):
                i, r = (None if pd.isna(x) else int(x) for x in (i, r))
                if out is None or out.at >= FILE_BYTES:
                    if out:
                        out.file.close()
                    out = Members(folder, "pages.warc")
                found.append((sort_key(u, captured, i), i, out.name, *out.add(record(i, u, b.encode(), captured, r))))
            yield captures(found)
        if out:
            out.file.close()

    return materialise(rows.mapInPandas(save, CAPTURE), "warc-captures")


def captures(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["key", "id", "file", "offset", "length"]).astype({"id": "Int64"})


@dataclass
class Index:
    """The top level: the first key of each index file, as bytes, with the file and its directory."""

    first: list[bytes]
    files: list[tuple[str, str]]


def build(found: DataFrame, lines: int = LINES, folder: str | None = None) -> Index:
    """Sort the captures and write the index files; there is one per partition, so the top level fits any driver."""
    folder = folder or f"{shared_dir(found.sparkSession)}/index-{uuid.uuid4().hex}"

    def save(batches):
        out, block, directory = None, [], []

        def flush():
            if block:
                at, n = out.add("".join(f"{k}\t{i}\t{f}\t{o}\t{z}\n" for k, i, f, o, z in block).encode())
                directory.append(f"{block[0][0]}\t{at}\t{n}\n")
                block.clear()

        for pdf in batches:
            out = out or Members(folder, "captures.cdx")
            for row in zip(pdf["key"], pdf["id"].astype("Int64").astype("string").fillna(""), pdf["file"], pdf["offset"], pdf["length"], strict=True):
                block.append(row)
                if len(block) == lines:
                    flush()
        if out:
            flush()
            out.file.close()
            sparse = Members(folder, "directory")
            sparse.add("".join(directory).encode())
            sparse.file.close()
            yield pd.DataFrame({"first": [directory[0].split("\t")[0]], "file": [out.name], "directory": [sparse.name]})

    sorted_ = found.repartitionByRange("key").sortWithinPartitions("key")
    top = materialise(sorted_.mapInPandas(save, "first string, file string, directory string"), "warc-index").collect()
    top = sorted((r["first"].encode(), r["file"], r["directory"]) for r in top)
    return Index([x[0] for x in top], [x[1:] for x in top])


def keys(pages: DataFrame, key: str = "page_id", url: str = "url", captured: str = CAPTURED) -> DataFrame:
    @F.pandas_udf("string")
    def of(urls: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([sort_key(u, captured, None if i == "" else int(i)) for u, i in zip(urls, ids, strict=True)])

    return pages.select(of(F.col(url), F.coalesce(F.col(key).cast("long").cast("string"), F.lit(""))).alias("key"))


def lookup(wanted: DataFrame, index: Index) -> DataFrame:
    """Captures (CAPTURE) of the wanted keys."""
    first, files = index.first, index.files

    @F.pandas_udf("int")
    def place(ks: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(first, k.encode()) - 1 for k in ks])

    def search(batches):
        at, ranges, directory, starts, held = -1, Ranges(), [], [], (-1, [])
        for pdf in batches:
            found = []
            for part, k in zip(pdf["part"], pdf["key"], strict=True):
                if part < 0:
                    continue
                file, listing = files[part]
                if part != at:
                    system, path = fs.FileSystem.from_uri(listing)
                    with system.open_input_stream(path, compression=None) as f:
                        directory = [x.split("\t") for x in gzip.decompress(f.read()).decode().split("\n")[:-1]]
                    at, starts, held = part, [x[0].encode() for x in directory], (-1, [])
                b = k.encode()
                block = max(0, bisect.bisect_left(starts, b) - 1)  # the key may begin at the end of the block before
                while block < len(starts) and starts[block] <= b:
                    if held[0] != block:
                        data = zlib.decompress(ranges.read(file, int(directory[block][1]), int(directory[block][2])), 31)
                        held = (block, [x.split(b"\t") for x in data.split(b"\n")[:-1]])
                    rows = held[1]
                    i = bisect.bisect_left(rows, b, key=lambda x: x[0])
                    while i < len(rows) and rows[i][0] == b:
                        _, n, f, o, z = rows[i]
                        found.append((k, int(n) if n else None, f.decode(), int(o), int(z)))
                        i += 1
                    block += 1
            yield captures(found)

    placed = wanted.select("key").distinct().withColumn("part", place("key"))
    return placed.repartition(max(1, len(files)), "part").sortWithinPartitions("part", "key").mapInPandas(search, CAPTURE)


def read(found: DataFrame) -> DataFrame:
    """The records of captures: id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).
    The digest and length of each payload that is there are computed anew and compared with the headers."""
    number = lambda x: None if x.endswith(":null>") else int(x[:-1].rpartition(":")[2])

    def fetch(batches):
        ranges = Ranges()
        for pdf in batches:
            out = []
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"], strict=True):
                warc, http, payload = parsed(zlib.decompress(ranges.read(file, int(offset), int(length)), 31))
                size, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = warc["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or digest32(payload) != digest):
                    raise ValueError(f"{file} at {offset}: the payload doesn't match its header")
                out.append((number(warc["WARC-Record-ID"]), size, digest, warc["WARC-Type"], number(warc["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
            yield pd.DataFrame(out, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"id": "Int64", "refers_to": "Int64"})

    near = F.expr(f"offset div {1 << 26}")
    parted = found.repartition("file", near).sortWithinPartitions("file", "offset")
    return parted.mapInPandas(fetch, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
