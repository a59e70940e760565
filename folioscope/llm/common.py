"""What the operators share: the shared work folder, materialised tables, cleaned inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset in a local session (tests), a fresh temporary folder becomes the checkpoint
    folder of the session; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="folioscope-code-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    return f"{shared_root(spark)}/folioscope/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts the lineage in a place that survives lost executors; the table is kept, since results
    that are read lazily depend on it (``purge`` deletes the tables of a session).
    """
    spark = df.sparkSession
    ship(spark)
    path = path or fresh_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds more than this share of all rows is dealt out over as many tasks as ``_SALTS``.
_HOT, _SALTS = 1000, 64


def meet(rows: DataFrame, key: list[str], keys: DataFrame, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``keys``, which has one row a key and its count ``n`` among the rows.

    A key with over a thousandth of all rows isn't one task's: its rows are dealt out by a salt from
    their own hash, and its row of ``keys`` is repeated for each salt. There are fewer than a
    thousand such keys, so they are known by broadcast.
    """
    keys = materialize(keys, "keys")
    hot = F.col("n") * _HOT > total
    salt, flag = free_names(rows, 2)
    own = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "<" not in kind]), F.lit(_SALTS)).cast("int")
    known = F.broadcast(keys.where(hot).select(*key, F.lit(True).alias(flag)))  # fewer than _HOT rows
    dealt = rows.join(known, key, "left").withColumn(salt, F.when(F.col(flag), own).otherwise(0)).drop(flag)
    every = F.when(hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keys.withColumn(salt, F.explode(every)).drop("n"), [*key, salt]).drop(salt)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def purge(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` has left in the shared folder."""
    delete_folder(spark, f"{shared_root(spark)}/folioscope")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` doesn't have."""
    taken, made, n = {c.lower() for c in df.columns}, [], 0
    while len(made) < count:
        if f"own_{n}" not in taken:
            made.append(f"own_{n}")
        n += 1
    return made


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slots(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for, 8 at least."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int) -> tuple[list[str], np.ndarray]:
    """Whole texts and their labels 0 and 1, of a bounded sample of (doc_id, text) with (doc_id, ``label``).

    At most about ``sample`` documents with ``sample_bytes`` of text in all are used, chosen by a
    hash of their id; texts longer than a 16th of the bytes come last, so that they can't displace
    the rest; they are weighed before any text is moved. Rows without a text, an id or a label teach
    nothing; a document with several labels is used with each, repeated labels and rows count once.
    Where an id has so many rows that over four times ``sample`` are drawn, a hash of id and text
    thins them out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("mark")).distinct()
    share = min(1.0, sample / max(1, known.count()))
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))  # about ``sample`` rows
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = texts.join(drawn, "doc_id").select("doc_id", "mark", F.xxhash64("text").alias("th"), F.octet_length("text").alias("n"))
    found = docs.select("doc_id").join(drawn, "doc_id").count()
    if found > 4 * sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 30)) < int(4 * sample / found * (1 << 30)))
    order = [F.xxhash64("doc_id"), "mark", "th"]
    line = Window.orderBy(F.col("n") > sample_bytes // 16, *order).rowsBetween(Window.unboundedPreceding, 0)  # of the bounded sample, without texts
    fits = rows.distinct().withColumn("at", F.sum("n").over(line)).where(F.col("at") <= sample_bytes)
    wanted = F.broadcast(fits.select("doc_id", "mark", "th"))  # about four times ``sample`` rows at most
    used = texts.withColumn("th", F.xxhash64("text")).join(wanted, ["doc_id", "th"]).groupBy("doc_id", "mark", "th").agg(F.first("text").alias("text"))
    got = used.orderBy(*order).select("text", "mark").toPandas()  # ``sample_bytes`` of text at most
    return got["text"].tolist(), got["mark"].to_numpy()


#: What a worker keeps from task to task (caches of encoded words), by name; maps drop what others have left.
RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]):
    if name not in RESIDENT:
        RESIDENT[name] = make()
    return RESIDENT[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as an Arrow map that gives unused memory back at its end: workers idle on beside the next stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [x for x in RESIDENT if x != keeps]:
            del RESIDENT[name]
        try:
            yield from run(batches)
        finally:
            if not keeps:  # else more of the same follows; what comes after it drops and returns all
                pa.default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim:
                    trim(0)

    return wrapped


def map_texts(df: DataFrame, schema: str, keep: list[str], make: Callable[[], Callable[[list, dict], dict]], keeps: str = "") -> DataFrame:
    """Arrow map over rows in slices of bounded text size.

    ``keep`` lists the columns that are passed to the function; ``make()`` runs once a task and
    returns a function of (texts, {column: list}) to {column: list}. The text column is ``text``.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in sliced(batch):
                got = work(part.column("text").to_pylist(), {k: part.column(k).to_pylist() for k in keep})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run, keeps), schema)


def sliced(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of memory each (one row at least)."""
    if not batch.num_rows:
        return
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
