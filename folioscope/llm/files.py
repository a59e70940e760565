"""Files in any store that pyarrow knows: written under a temporary name, then moved."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)  # stands for a null id: before all others
_SLICE = 16 << 10


def filesystem(uri: str):
    """The store and the path in it of a URI (or a plain local path).

    Spark's names of stores are put in pyarrow's: s3a and s3n are s3, dbfs is its mount. Hadoop's
    own file system needs libhdfs on the workers.
    """
    from pyarrow import fs

    uri = re.sub(r"^dbfs:/+", "/dbfs/", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def commit_file(uri: str, data: bytes) -> None:
    """Write ``data`` so that readers see the whole file or none; repeating it changes nothing."""
    store, path = filesystem(uri)
    folder = path.rsplit("/", 1)[0]
    store.create_dir(f"{folder}/_tmp", recursive=True)
    held = f"{folder}/_tmp/{uuid.uuid4().hex}"
    with store.open_output_stream(held) as out:
        out.write(data)
    store.move(held, path)


def read_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read()


def read_slices(uri: str, crc: int) -> Iterator[bytes]:
    """The file in slices; raises at its end where its crc32 is another."""
    store, path = filesystem(uri)
    seen = 0
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
        while some := f.read(_SLICE):
            seen = zlib.crc32(some, seen)
            yield some
    if seen != crc:
        raise ValueError(f"{uri} isn't the file of the manifest")


def even_bounds(rows: DataFrame, column: str, tie: str, parts: int) -> list[tuple[int, int]]:
    """Pairs that cut rows, in the order of a long column and a hash, into about equal shares: the same for the same rows.

    Nulls of the column are ``LEAST``. The sample holds about 100 pairs a part (2,000 at least),
    chosen by their hash, equal ones once. The hash is looked at only where one id has the rows of
    more than two parts: then these are cut by it.
    """
    if parts < 2:
        return []
    own = F.coalesce(F.col(column).cast("long"), F.lit(LEAST))
    total = max(1, rows.count())
    crowded = rows.groupBy(own).count().where(F.col("count") > 2 * total // parts).limit(1).collect()
    pairs = rows.select(own.alias("a"), (F.col(tie) if crowded else F.lit(LEAST)).alias("b"))
    share = min(1.0, max(2_000, 100 * parts) / total)
    kept = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)) < int(share * (1 << 40)))
    values = sorted(tuple(r) for r in kept.distinct().collect())
    return sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []
