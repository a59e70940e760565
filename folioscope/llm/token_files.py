"""Writing a corpus' token ids to files in document order, and reading them back (format: rans)."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import rans
from folioscope.llm.chunked_encoding import encoder
from folioscope.llm.common import fresh_folder, materialize, ship, sliced, slots, tidy
from folioscope.llm.files import LEAST, commit_file, even_bounds, read_file

ROWS_A_PART, MOST_PARTS, IDS_A_FILE = 4096, 20_000, 1 << 24


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Write all documents' ids (no special tokens, then ``end_id``) in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id stand in the order of their text's hash, and the
    range is cut by both, so null or repeated ids are dealt out. Each part of the range is one
    task's; it rolls files at ``IDS_A_FILE`` ids. Null and empty texts have the end id alone;
    repeated rows are written each; a text of any length is one task's; an empty table gives a
    manifest without files. Files and the manifest appear by a
    move, the manifest last, so a repeated task or a second run leaves whole files only. Returns
    the folder: ``table`` (frequencies), ``part-*.ids`` and ``manifest.json``.
    """
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "token-files")
    parts = min(MOST_PARTS, -(-docs.count() // ROWS_A_PART))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    bounds = even_bounds(rows, "doc_id", "tie", parts)
    end = int(end_id).to_bytes(4, "little")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, counts = encoder(tokenizer_path), np.zeros(0, np.int64)
        names = ["part", "doc_id", "tie", "ids"]
        for batch in batches:
            for some in sliced(batch, 8 << 20):
                own, tie = some.column("doc_id").to_pylist(), some.column("tie").to_pylist()
                part = [bisect_right(bounds, (LEAST if d is None else d, t)) for d, t in zip(own, tie)]
                ids = [x + end for x in to_ids.encode(some.column("text"))]
                more = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
                if len(more) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(more) - len(counts), np.int64)])
                counts[: len(more)] += more
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own, pa.int64()), pa.array(tie, pa.int64()), pa.array(map(_narrow, ids), pa.binary())], names=names)
        if len(counts):  # the task's counts, as a row of no part
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    ship(spark)
    encoded = materialize(rows.mapInArrow(tidy(convert, keeps=tokenizer_path), "part int, doc_id long, tie long, ids binary"), "ids")
    sums = encoded.where("part < 0").select("ids").mapInArrow(tidy(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row per token at most
    counts = np.zeros(int(sums["id"].max()) + 1 if len(sums) else 0, np.int64)
    counts[sums["id"]] = sums["n"]
    freq = rans.quantized(counts)
    table = rans.table_bytes(freq)
    crc = zlib.crc32(table)
    commit_file(f"{folder}/table", table)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = rans.Coder(freq), []
        part, number, held, docs_, size = None, 0, [], [], 0

        def flush():
            name = f"part-{part:05d}-{number:05d}.ids"
            ids = np.concatenate(held)
            commit_file(f"{folder}/{name}", rans.file_bytes(coder, crc, docs_, ids))
            done.append((part, number, name, len(docs_), len(ids)))

        for batch in batches:
            for p, d, _, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (p != part or size >= IDS_A_FILE):
                    flush()
                    number, held, docs_, size = (0 if p != part else number + 1), [], [], 0
                part = p
                held.append(_wide(raw))
                docs_.append((d, len(held[-1])))
                size += len(held[-1])
        if held:
            flush()
        columns = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "number", "name", "docs", "ids"]
        )

    dealt = encoded.where("part >= 0").select("part", "doc_id", "tie", "ids").repartitionById(max(1, len(bounds) + 1), "part").sortWithinPartitions("part", "doc_id", "tie", "ids")
    files = sorted(tuple(r) for r in dealt.mapInArrow(tidy(write), "part int, number int, name string, docs long, ids long").collect())  # a row per file
    start, listed = 0, []
    for _, _, name, n_docs, n_ids in files:
        listed.append({"name": name, "docs": n_docs, "ids": n_ids, "start": start})
        start += n_ids
    commit_file(f"{folder}/manifest.json", json.dumps({"table": crc, "files": listed}).encode())
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``; none without files.

    A document may lie in many blocks; one block at a time is decoded.
    """
    ship(spark)
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    freq = read_file(f"{folder}/table")
    if zlib.crc32(freq) != manifest["table"]:
        raise ValueError("the frequency table isn't that of the manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(rans.table_from(freq))
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = read_file(f"{folder}/{name}")
                index = rans.read_index(data)
                blocks = iter(index["blocks"])
                rows, rest = [], np.zeros(0, np.uint32)
                for doc, n in index["docs"]:
                    crc, need = 0, n
                    while need:
                        if not len(rest):
                            rest = rans.read_block(coder, data, next(blocks))
                        crc = zlib.crc32(rest[:need].astype("<u4").tobytes(), crc)
                        need, rest = need - min(need, len(rest)), rest[need:]
                    rows.append((doc, start, n, crc))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f["name"], f["start"]) for f in manifest["files"]], "name string, start long")
    files = files.repartition(max(1, min(len(manifest["files"]), 8 * slots(spark))))
    return files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _narrow(ids: bytes) -> bytes:
    """Ids as 16-bit numbers after a mark of that, where they all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + ids


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) of the counts that tasks have left."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = np.frombuffer(raw, "<i8")
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])
