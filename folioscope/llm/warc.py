"""WARC archives: a deterministic sharded writer and a reader.

The writer sorts records by range of page_id, gives each range to one task and rolls its files by
compressed size. Headers and digests are made anew from the payload; equal payloads are stored
once, the others as revisits. Files are written under temporary names and moved; the manifest
comes last and names every file, so a reader takes whole archives only and a repeated task
rewrites the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import fresh_folder, ship, slots, tidy
from folioscope.llm.files import LEAST, commit_file, even_bounds, read_file, read_slices

ROWS_A_PART, MOST_PARTS = 1024, 4096
_SPACE = uuid.UUID("7c1b5f0e-52cf-5d1b-9a53-0f7f6a3e9f11")
_BREAK = b"\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _clean(url: str | None, page_id) -> str:
    """A target URI of one line; a page without URL gets a urn."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    return url or f"urn:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, compressed as a gzip member of its own (no time stamp: the same bytes each time)."""
    digest = sha1_base32(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    text = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _BREAK + block + 2 * _BREAK
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(text) + pack.flush()


def records(slices: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, given in slices; one gzip member a record.

    Only the record at hand is held, and what follows it is copied within its slice only.
    """
    for text in _members(slices):
        head, _, rest = text.partition(2 * _BREAK)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(fields["Content-Length"])]
        if f"sha1:{sha1_base32(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != 2 * _BREAK:
            raise ValueError("a damaged record")
        yield fields, block


def _members(slices: Iterable[bytes]) -> Iterator[bytes]:
    held: list[bytes] = []
    unpack = None
    for some in slices:
        while some:
            unpack = unpack or zlib.decompressobj(31)
            held.append(unpack.decompress(some))
            some = unpack.unused_data
            if unpack.eof:
                yield b"".join(held)
                held, unpack = [], None
    if unpack:
        raise ValueError("a cut-off record")


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = 64 << 20, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Archive ``pages`` (page_id, url, html) and return the folder with its ``manifest.json``.

    Payload: the html in UTF-8, empty if null. Of the rows with one payload of ``revisit_from``
    bytes at least, those of the smallest page_id (null ids aside) are responses and the others
    revisits of it; smaller payloads are always responses. Rows with a null page_id come first and
    carry no id. Repeated rows give repeated records. Files end once they hold ``roll_bytes``. The
    order is that of page_id, then of the payload's hash, and is cut by both: null or repeated ids
    are dealt out over parts. A payload of any size is one record, held in one task's memory. An
    empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_folder(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("tie", F.xxhash64("sha"))
    first = rows.where(F.col("size") >= revisit_from).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    parts = max(1, min(MOST_PARTS, -(-pages.count() // ROWS_A_PART)))
    bounds = even_bounds(rows, "page_id", "tie", parts)
    ids = rows.select("page_id", "sha", "tie", "size").distinct().join(first, ["sha", "size"]).where("page_id is null or page_id <> first")
    # decisions go to the writer's tasks beside the payloads, ahead of the rows they are for: payloads move once
    order = ["part", "page_id", "tie", "kind", "sha", "url", "payload", "refers_to"]
    decided = ids.select(_part(bounds).alias("part"), "page_id", "tie", F.lit(0).alias("kind"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("first").alias("refers_to"))
    written = rows.select(_part(bounds).alias("part"), "page_id", "tie", F.lit(1).alias("kind"), "sha", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    dealt = decided.select(*order).unionAll(written.select(*order))
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("page_id").asc_nulls_first(), "tie", "kind", "sha", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, part, number, size, count = [], [], None, 0, 0, 0
        page, first = None, {}  # what is decided for the page at hand, by payload

        def flush():
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            data = b"".join(held)
            commit_file(f"{folder}/{name}", data)
            done.append((part, number, name, count, len(data), zlib.crc32(data)))

        for batch in batches:
            for own, page_id, tie, kind, sha, url, payload, refers_to in _rows(batch):
                if page != (own, page_id, tie):
                    page, first = (own, page_id, tie), {}
                if not kind:
                    first[sha] = refers_to
                    continue
                if held and (own != part or size >= roll_bytes):
                    flush()
                    number = 0 if own != part else number + 1
                    held, size, count = [], 0, 0
                part = own
                held.append(record(page_id, url, payload, first.get(sha), date))
                size += len(held[-1])
                count += 1
        if held:
            flush()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["part", "number", "name", "records", "bytes", "crc"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 6, kinds)], names=names)

    made = sorted(tuple(r) for r in dealt.mapInArrow(tidy(write), "part int, number int, name string, records long, bytes long, crc long").collect())  # a row per file
    files = [dict(zip(("name", "records", "bytes", "crc32"), r[2:])) for r in made]
    commit_file(f"{folder}/manifest.json", json.dumps({"format": "WARC/1.1", "files": files}).encode())
    return folder


def _part(bounds: list) -> F.Column:
    """The number of bounds (page_id, tie) that are not above a row's (few for a part of fixed size; searched by halves)."""
    own = F.coalesce("page_id", F.lit(LEAST))

    def between(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        first, second = bounds[mid]
        return F.when((own > first) | ((own == first) & (F.col("tie") >= second)), between(mid + 1, high)).otherwise(between(low, mid))

    return between(0, len(bounds)).cast("int")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch one after the other, so that only one payload is held twice."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record.

    ``payload`` is null for revisits; length and digest are those of the full payload: computed
    from the payload of responses, from the headers of revisits. Files are read in slices, in time
    proportional to their size; a file that isn't that of the manifest is an error. Without files
    there are no rows.
    """
    ship(spark)
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def rows(slices: Iterable[bytes]) -> Iterator[tuple]:
        for fields, block in records(slices):
            digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), None
            if fields["WARC-Type"] == "response":
                payload = block.partition(2 * _BREAK)[2]
                if (sha1_base32(payload), len(payload)) != (digest, size):
                    raise ValueError("a payload that isn't that of its header")
            ids = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
            yield ids[0], fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, ids[1], payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for name, crc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for row in rows(read_slices(f"{folder}/{name}", crc)):
                    held.append(row)
                    size += len(row[6] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    files = spark.createDataFrame([(f["name"], f["crc32"]) for f in manifest["files"]], "name string, crc long")
    return files.repartition(max(1, min(len(manifest["files"]), 8 * slots(spark)))).mapInArrow(tidy(run), schema)


def oracle(revisit_from: int = 0) -> str:
    """DuckDB's sha1 is hexadecimal: its bits are cut into fives for the base32 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, payload, strlen(payload) as payload_bytes, sha1(payload) as x from p),
b as (select *, array_to_string([lpad(bin(('0x' || x[i * 5 + 1 : i * 5 + 5])::bigint), 20, '0') for i in range(8)], '') as bits from h),
d as (select page_id, payload_bytes, payload,
    array_to_string(['{letters}'[1 + list_sum([(bits[i * 5 + j]::int) << (5 - j) for j in range(1, 6)])::int] for i in range(32)], '') as payload_digest from b),
f as (select *, min(page_id) over (partition by payload) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {revisit_from} and first is distinct from page_id and first is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {revisit_from} and first is distinct from page_id then first end as refers_to
from f"""
