"""WARC archives: writing pages, and the normaliser of monolithic gzip files.

write() puts pages into archives that are one gzip stream each, as some crawlers leave them. normalize() inflates such
a stream once, record by record, rewrites every record as a gzip member of its own, and writes a sidecar index with the
offset and length of each member. read() then takes any record alone: it seeks, inflates one member and parses it.

normalize() and read() take archives of other writers too: records of every type, header names in any case and folded
lines, responses without an HTTP length, records without a digest or address. The payload is what follows the HTTP head
of an application/http block, as it was sent, and the whole block of other records. Only the record at hand is held in
memory, once raw and once packed; a stream that ends within a member or record, or a record without a length, raises.

Files are written under a temporary name and moved, so a task that is run again leaves no partial archive. All paths
are URIs of the shared file system.

Defined results: null html is an empty payload; records of equal payloads of at least REVISIT_BYTES bytes refer to
the one with the largest page_id, and if several rows have that id each of them is a response; a null page_id counts as
smaller than any; a url is read back as it was, with its line feeds, null or empty; a very long page is one record;
repeated rows are a record each; an empty table writes no archives and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES, ARCHIVE_BYTES, LEVEL = 1000, 64 << 20, 4
_URN = "urn:sievemill:page:"
#: Fixed values of the WARC 1.1 format.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A field of write()'s own, for an address that is not plain printable ASCII.
_EXACT = "Sievemill-Target-URI-Base64"


#: Up to so many kept payloads (some 100 bytes each) are broadcast to the pages; beyond, they meet by a shuffle.
BROADCAST_KEPT = 100_000
_GAP = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, revisit: bool) -> bytes:
    """One WARC record; digest: hex SHA-1 of the payload, which a revisit leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
        if head["WARC-Target-URI"] != url:
            head[_EXACT] = base64.b64encode(url.encode()).decode()
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_URN}{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + _GAP


def fields(head: bytes) -> dict[str, str]:
    """The header fields after the first line, by lower-case name; of a repeated one the first."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        name, mark, value = line.decode("utf-8", "replace").partition(":")
        if mark:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _length(named: dict[str, str]) -> int | None:
    value = named.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else None


def _sha1(value: str) -> str | None:
    """The hex digits of a digest field, if it is a SHA-1."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return None
    return text.lower() if re.fullmatch("[0-9a-fA-F]{40}", text) else base64.b32decode(text.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", text) else None


def parse(raw: bytes) -> dict:
    """One record: type, record_id, page_id and refers_to (of pages that write() wrote), url, payload, payload_bytes and digest, which are those of the full payload or null if a revisit does not state them."""
    head, _, block = raw.partition(_GAP)
    named = fields(head)
    block = block[: _length(named)]
    kind = named.get("warc-type", "").lower()
    payload, stated = block, None
    if named.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(_GAP)
        stated = _length(fields(http))
    number = lambda x: int(m[1]) if (m := re.fullmatch(f"<{_URN}(-?[0-9]+)>", x)) else None
    url = base64.b64decode(named[_EXACT.lower()]).decode() if _EXACT.lower() in named else named.get("warc-target-uri")
    size, digest = (stated, _sha1(named.get("warc-payload-digest", ""))) if kind == "revisit" else (len(payload), hashlib.sha1(payload).hexdigest())
    return {"type": kind, "record_id": named.get("warc-record-id"), "page_id": number(named.get("warc-record-id", "")), "refers_to": number(named.get("warc-refers-to", "")), "url": url, "digest": digest, "payload": payload, "payload_bytes": size}


#: The longest header that a record may have; a stream without a blank line is no archive, and isn't held whole.
HEADER_BYTES = 8 << 20


def split_records(chunks):
    """The raw records of an uncompressed WARC stream, which comes in chunks; only one record is held."""
    held, at, seen, need = bytearray(), 0, 0, None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                while at < len(held) and held[at] in b"\r\n":
                    at += 1
                # What has been searched once is not searched again, but for a mark that was cut.
                end = held.find(_GAP, max(at, seen - 3))
                if end < 0:
                    if len(held) - at > HEADER_BYTES:
                        raise ValueError(f"no WARC record: a header of more than {HEADER_BYTES} bytes")
                    seen = len(held)
                    break
                head = bytes(held[at:end])
                length = _length(fields(head))
                if not head.startswith(b"WARC/") or length is None:
                    raise ValueError(f"no WARC record with a length: {head[:80]!r}")
                need = end + len(_GAP) + length
            if len(held) < need:
                break
            yield bytes(held[at:need]) + _GAP
            at, seen, need = need, need, None
        del held[:at]
        at, seen, need = 0, max(0, seen - at), None if need is None else need - at
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflate(stream, size: int = 1 << 20):
    """Chunks of at most `size` bytes of a gzip stream of one or more members."""
    z, begun = zlib.decompressobj(31), False
    while raw := stream.read(size):
        while raw:
            if not begun and not raw.strip(b"\0"):  # padding after the last member
                break
            begun = True
            yield z.decompress(raw, size)
            raw = z.unconsumed_tail
            if z.eof:
                raw, z, begun = z.unused_data, zlib.decompressobj(31), False
        while begun and (more := z.decompress(b"", size)):
            yield more
    if begun:
        raise ValueError("the gzip stream is cut off")


class _Target:
    """A file that appears under its name only when it is whole."""

    def __init__(self, base: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root)
        self.path = f"{root}/{name}"
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.temporary, compression=None)

    def done(self) -> None:
        self.file.close()
        self.fs.move(self.temporary, self.path)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each row of pages(page_id, url, html); refers_to only for revisits.

    Payloads are not shuffled unless many of them occur more than once, and never those under REVISIT_BYTES.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= REVISIT_BYTES
    kept = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = common.written(kept.withColumnRenamed("digest", "twin"), "kept-payloads")
    if kept.count() <= BROADCAST_KEPT:
        joined = rows.join(F.broadcast(kept), F.when(large, F.col("digest")) == F.col("twin"), "left")
    else:
        keyed = rows.where(large).withColumn("twin", F.col("digest"))
        unique = keyed.join(kept, "twin", "left_anti").withColumns({"kept": F.lit(None).cast("long"), "n": F.lit(1).cast("long")})
        joined = common.split_join(keyed, kept, "twin", "n", rows.count()).unionByName(unique).unionByName(rows.where(~large), allowMissingColumns=True)
    return joined.select("page_id", "url", "payload", "digest", F.when(F.coalesce(F.col("page_id") != F.col("kept"), F.col("kept").isNotNull()), F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, base: str) -> DataFrame:
    """Write pages as monolithic archives under base: (archive, records) of each."""
    common.prepare(pages.sparkSession)

    def run(batches):
        part, no, records, size, target, z = TaskContext.get().partitionId(), 0, 0, 0, None, None
        done = []

        def close():
            nonlocal target, no, records, size
            if target:
                target.file.write(z.flush())
                target.done()
                done.append((f"part-{part:05d}-{no:03d}", records))
                target, no, records, size = None, no + 1, 0, 0

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not target:
                    target, z = _Target(base, f"part-{part:05d}-{no:03d}.mono.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(page_id, url, payload, refers_to, digest, refers_to is not None)
                target.file.write(z.compress(raw))
                records, size = records + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    return common.written(plan_revisits(pages).mapInArrow(run, "archive string, records long"), "archives")


def _dealt(archives: DataFrame) -> DataFrame:
    """One task for each archive, or for a few: their names are small, their files are not."""
    return archives.select("archive").repartition(min(10_000, max(1, archives.count())), "archive")


def normalize(archives: DataFrame, base: str) -> DataFrame:
    """Rewrite monolithic archives (archive: the name of base/NAME.mono.warc.gz) with one gzip member a record and a sidecar index: (archive, records, bytes)."""

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(base)
                out, index = _Target(base, f"{archive}.warc.gz"), _Target(base, f"{archive}.idx")
                at = n = 0
                with fs.open_input_stream(f"{root}/{archive}.mono.warc.gz", compression=None) as f:
                    for raw in split_records(inflate(f)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.file.write(member)
                        r = parse(raw)
                        index.file.write(f"{at}\t{len(member)}\t{r['type']}\t{r['record_id'] or '-'}\t{r['digest'] or '-'}\n".encode())
                        at, n = at + len(member), n + 1
                out.done()
                index.done()
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["archive", "records", "bytes"])

    return common.written(_dealt(archives).mapInArrow(run, "archive string, records long, bytes long"), "normalized")


READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read(archives: DataFrame, base: str) -> DataFrame:
    """Every record of normalised archives, each taken by its offset: the columns of READ.

    A revisit has no payload of its own; its size and digest are those of the full payload.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(base)
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{archive}.idx") as index, fs.open_input_file(f"{root}/{archive}.warc.gz") as f:
                    # Only a line feed ends a line; a record id may hold any other character.
                    for line in filter(None, index.read().split(b"\n")):
                        at, length = map(int, line.split(b"\t")[:2])
                        r = parse(zlib.decompress(f.read_at(length, at), 31))
                        rows.append((r["record_id"], r["page_id"], r["url"], r["type"], r["refers_to"], None if r["type"] == "revisit" else r["payload"], r["payload_bytes"], r["digest"]))
                        size += len(r["payload"])
                        if size > common.BATCH_BYTES // 2:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return _dealt(archives).mapInArrow(run, READ)


def round_trip(pages: DataFrame, base: str) -> DataFrame:
    """Write, normalise and read back."""
    return read(normalize(write(pages, base), base), base)
