"""Indexes as tables: bucketed generations and posting segments of Parquet behind numbered pointers, with a guard on their settings; JSON artifacts."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import keywords, retrieval, seams
from folioscope.sources.work import kept

_TRIES = 5


class Conflict(RuntimeError):
    """Another writer has published a change since this one read the pointer."""


class SettingsMismatch(ValueError):
    """An index was opened with other settings than it was made with."""


class Stored:
    """A folder whose contents are what its last pointer names.

    Pointers are numbered. A writer publishes the one after that which it has read, and fails if
    another writer has done so before; then the change is made again from what is there now. Readers
    see the old contents or the new ones, and a lost job leaves the old. ``settings`` (the model,
    dimension and index version) must be those of the first writer; ``rebuild`` may change them.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        pointer = self.pointer()
        if pointer and pointer["settings"] != settings:
            raise SettingsMismatch(f"made with {pointer['settings']}, opened with {settings}")

    def pointer(self) -> dict | None:
        """What the folder holds now, with the pointer's number."""
        names = [n for n in self._names() if re.fullmatch(r"pointer-\d+\.json", n)]
        return json.loads(self.spark.read.text(f"{self.path}/{max(names)}", wholetext=True).first()[0]) if names else None

    def vacuum(self) -> None:
        """Deletes all that the last pointer doesn't name, earlier pointers too. Not beside a writer."""
        fs, root, pointer = *self._fs(), self.pointer()
        used = self._used(pointer) | {f"pointer-{pointer['number']:012d}.json"} if pointer else set()
        for name in self._names():
            if name.startswith(("generation-", "pointer-")) and name not in used:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, name), True)

    def _used(self, pointer: dict) -> set[str]:
        raise NotImplementedError

    def _change(self, change: Callable[[dict | None], dict | None]) -> None:
        """Publish what ``change`` makes of the pointer (None: nothing), again from the new one where another writer was faster."""
        for left in reversed(range(_TRIES)):
            pointer = self.pointer()
            made = change(pointer)
            if made is None:
                return
            number = (pointer or {"number": 0})["number"] + 1
            try:
                write_json(self.spark, self.path, f"pointer-{number:012d}", made | {"settings": self.settings, "number": number}, replace=False)
                return
            except Conflict:
                if not left:
                    raise

    def _names(self) -> list[str]:
        fs, root = self._fs()
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root


class IndexTable(Stored):
    """A table of chunks (chunk_id, paper_id, version_id, ...) below ``path``, in buckets by chunk_id.

    A change rewrites the buckets that it touches as a new generation. Files that the pointer no
    longer names stay until ``vacuum``. ``rebuild`` may change the number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, buckets: int = 16) -> None:
        super().__init__(spark, path, settings)
        self.buckets = (self.pointer() or {"buckets": buckets})["buckets"]

    def read(self) -> DataFrame | None:
        """The rows, or None where nothing has been written yet."""
        pointer = self.pointer()
        return self._rows(list(pointer["places"]), pointer) if pointer and pointer["places"] else None

    def upsert(self, rows: DataFrame) -> None:
        """New rows replace old ones of their chunk_id; of repeated new ids any one stays."""
        new = self._placed(rows.dropDuplicates(["chunk_id"]))
        touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # a row per bucket

        def change(pointer: dict | None) -> dict:
            old = self._rows(touched, pointer)
            whole = new if old is None else self._placed(old.join(new.select("chunk_id"), "chunk_id", "left_anti")).unionByName(new, allowMissingColumns=True)
            return self._written(whole, touched, pointer)

        self._change(change)

    def delete(self, papers: list | None = None, versions: list | None = None) -> None:
        """Deletes by papers or by versions, by exactly one of them; rows of a null id stay."""
        column, gone = _one_of(papers, versions)

        def change(pointer: dict | None) -> dict | None:
            old = self._rows(list(pointer["places"]), pointer) if pointer else None
            if old is None or not gone:
                return None
            touched = [str(r.bucket) for r in self._placed(old.where(old[column].isin(gone))).select("bucket").distinct().collect()]  # a row per bucket
            rows = self._rows(touched, pointer) if touched else None
            return None if rows is None else self._written(self._placed(rows.where(~rows[column].isin(gone) | rows[column].isNull())), touched, pointer)

        self._change(change)

    def rebuild(self, rows: DataFrame, settings: dict | None = None, buckets: int | None = None) -> None:
        self.settings, self.buckets = settings or self.settings, buckets or self.buckets
        self._change(lambda pointer: self._written(self._placed(rows.dropDuplicates(["chunk_id"])), None, pointer))

    def _used(self, pointer: dict) -> set[str]:
        return {p.split("/")[0] for p in pointer["places"].values()}

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.drop("bucket").withColumn("bucket", F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.lit(self.buckets)).cast("int"))

    def _rows(self, buckets: list[str], pointer: dict | None) -> DataFrame | None:
        places = [pointer["places"][b] for b in buckets if b in pointer["places"]] if pointer else []
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in places]) if places else None

    def _written(self, rows: DataFrame, touched: list[str] | None, pointer: dict | None) -> dict:
        """Write ``rows`` as the new contents of the touched buckets (None: of all); returns the pointer to them."""
        name = f"generation-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        fs, _ = self._fs()
        made = {}
        for status in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
            folder = status.getPath().getName()
            if folder.startswith("bucket="):
                made[folder.removeprefix("bucket=")] = f"{name}/{folder}"
        stay = {b: p for b, p in pointer["places"].items() if b not in touched} if pointer and touched is not None else {}
        return {"generation": name, "buckets": self.buckets, "places": stay | made}


def _one_of(papers: list | None, versions: list | None) -> tuple[str, list]:
    if (papers is None) == (versions is None):
        raise ValueError("give papers or versions, one of them")
    return ("paper_id", papers) if versions is None else ("version_id", versions)


class VectorStore(IndexTable):
    """An index table whose texts are embedded as they are written; ``settings`` has model and dimension.

    A vector of another length, or with a component that isn't a finite number, fails the write.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, embed: seams.Embedder, buckets: int = 16) -> None:
        super().__init__(spark, path, settings, buckets)
        self.embed = embed

    def upsert(self, rows: DataFrame) -> None:
        super().upsert(self._embedded(rows))

    def rebuild(self, rows: DataFrame, settings: dict | None = None, buckets: int | None = None) -> None:
        self.settings = settings or self.settings
        super().rebuild(self._embedded(rows), self.settings, buckets)

    def search(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """Questions (query_id, text, and any scope columns) by the store's own embedder; see ``retrieval.vector_search``."""
        held = self.read()
        if held is None:
            raise ValueError("nothing has been written yet")
        return retrieval.vector_search(self.embed(questions, "text"), held, limit)

    def _embedded(self, rows: DataFrame) -> DataFrame:
        v = F.col("embedding")
        sound = (F.size(v) == self.settings["dimension"]) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        checked = F.when(F.coalesce(sound, F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("bad vector of chunk "), F.col("chunk_id").cast("string"))))
        return self.embed(rows, "text").withColumn("embedding", checked)


class KeywordStore(Stored):
    """Chunks (chunk_id, text, ...) with their inverted index, in immutable segments.

    A change writes a segment of the new chunks, the names of the chunks that it replaces or
    deletes, and what that takes off the document frequencies; nothing else is written. Segments of
    like size (powers of ``tier``) are merged when there are ``tier`` of them, and a segment half of
    whose chunks are gone is written anew, so that a chunk is rewritten a logarithmic number of times.
    Scores equal those of a store that is rebuilt from the present rows.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, tier: int = 4) -> None:
        super().__init__(spark, path, settings)
        self.tier = tier

    def read(self) -> DataFrame | None:
        """The present rows, or None where nothing has been written yet."""
        pointer = self.pointer()
        return self._index(pointer).docs.drop("segment", *keywords.OWN) if pointer and pointer["segments"] else None

    def index(self) -> retrieval.KeywordIndex:
        pointer = self.pointer()
        if not pointer or not pointer["segments"]:
            raise ValueError("nothing has been written yet")
        return self._index(pointer)

    def search(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        return self.index().search(questions, limit)

    def upsert(self, rows: DataFrame) -> None:
        """New rows replace old ones of their chunk_id; of repeated new ids any one stays."""
        name, made = self._written(keywords.tokenised(_one_each(kept(rows, "rows"))))  # sorting looks at them twice
        new = keywords.small(self.spark.read.parquet(f"{self.path}/{name}/docs").select("chunk_id"))

        def change(pointer: dict | None) -> dict | None:
            left = self._without(pointer, lambda docs: docs.join(new, "chunk_id", "left_semi"))
            return self._merged(left | {"segments": left["segments"] | made})

        if made:
            self._change(change)

    def delete(self, papers: list | None = None, versions: list | None = None) -> None:
        """Deletes by papers or by versions, by exactly one of them; rows of a null id stay."""
        column, gone = _one_of(papers, versions)

        def change(pointer: dict | None) -> dict | None:
            if not pointer or not pointer["segments"] or not gone:
                return None
            made = self._without(pointer, lambda docs: docs.where(docs[column].isin(gone)))
            return None if made == pointer else self._merged(made)

        self._change(change)

    def rebuild(self, rows: DataFrame, settings: dict | None = None) -> None:
        self.settings = settings or self.settings
        _, made = self._written(keywords.tokenised(_one_each(kept(rows, "rows"))))
        self._change(lambda _: {"segments": made, "changes": []})

    def _used(self, pointer: dict) -> set[str]:
        return {*pointer["segments"], *pointer["changes"]}

    def _index(self, pointer: dict) -> retrieval.KeywordIndex:
        segments = pointer["segments"]
        read = lambda kind: self.spark.read.parquet(*[f"{self.path}/{c}/{kind}" for c in pointer["changes"]]).where(F.col("segment").isin(list(segments))) if pointer["changes"] else None
        n, length = (sum(x[c] for x in segments.values()) for c in ("n", "length"))
        return keywords.open_segments(self.spark, {s: f"{self.path}/{s}" for s in segments}, n, length, read("gone"), read("terms"))

    def _written(self, rows: DataFrame) -> tuple[str, dict]:
        """Write tokenised rows as a segment, which no pointer names yet; returns its name and what a pointer says of it, nothing if it is empty."""
        name = f"generation-{uuid.uuid4().hex}"
        n, length = keywords.write_segment(rows, f"{self.path}/{name}")
        return name, {name: {"n": n, "length": length, "written": n}} if n else {}

    def _without(self, pointer: dict | None, which: Callable[[DataFrame], DataFrame]) -> dict:
        """The pointer with the chunks among the present ones that ``which`` takes marked as gone."""
        if not pointer or not pointer["segments"]:
            return {"segments": {}, "changes": []}
        gone = kept(which(self._index(pointer).docs).select("segment", "chunk_id", "dl", "tokens"), "gone")
        sums = {r.segment: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).collect()}  # a row per segment
        if not sums:
            return pointer
        name = f"generation-{uuid.uuid4().hex}"
        gone.select("segment", "chunk_id").write.parquet(f"{self.path}/{name}/gone")
        terms = gone.select("segment", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("segment", "term").agg((-F.count("*")).alias("df"))
        terms.select("term", "df", "segment").write.parquet(f"{self.path}/{name}/terms")
        left = {s: x | ({"n": x["n"] - sums[s].n, "length": x["length"] - sums[s].length} if s in sums else {}) for s, x in pointer["segments"].items()}
        return pointer | {"segments": {s: x for s, x in left.items() if x["n"]}, "changes": [*pointer["changes"], name]}

    def _merged(self, pointer: dict) -> dict:
        """The pointer after all merges that are due."""
        while True:
            tiers: dict[int, list[str]] = {}
            for name, x in pointer["segments"].items():
                tiers.setdefault(int(math.log(x["n"], self.tier) + 1e-9), []).append(name)
            due = next((names for _, names in sorted(tiers.items()) if len(names) >= self.tier), None)
            due = due or [name for name, x in pointer["segments"].items() if 2 * x["n"] <= x["written"]][:1]
            if not due:
                return pointer
            docs = self._index(pointer).docs
            rows = docs.where(F.col("segment").isin(due)).drop("segment")
            order = [*[c for c in retrieval.META[::-1] if c in rows.columns], "dl", "chunk_id"]
            parts = self.spark.sparkContext.defaultParallelism
            rest = {s: x for s, x in pointer["segments"].items() if s not in due}
            _, made = self._written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
            pointer = pointer | {"segments": rest | made}


def _one_each(rows: DataFrame) -> DataFrame:
    """``rows`` with any one of those of a chunk_id. Only the ids are looked at, and only rows of repeated ones move."""
    twice = rows.groupBy("chunk_id").count().where("count > 1").select(F.col("chunk_id").alias("_twice"))
    if twice.isEmpty():
        return rows
    twice, same = keywords.small(twice), F.col("chunk_id").eqNullSafe(F.col("_twice"))
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["chunk_id"]))


def simple_ids(index) -> F.Column:
    """Ids by a chunk's number in its source."""
    return F.concat(F.lit("doc_"), index.cast("string"))


def add_new(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows whose key isn't there yet: adding the same rows twice changes nothing."""
    return old.unionByName(rows.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def write_json(spark: SparkSession, folder: str, name: str, value, replace: bool = True) -> str:
    """One small JSON artifact, whole or not at all: a temporary file, renamed over the old one.

    ``name`` may hold letters, digits, hyphens and underscores. Without ``replace``, a file that is
    there already is a ``Conflict``.
    """
    if not re.fullmatch(r"[\w-]+", name, re.ASCII):
        raise ValueError(f"not a plain name: {name!r}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.getFileSystem(conf).makeQualified(root).toUri(), conf)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    draft, last = jvm.org.apache.hadoop.fs.Path(root, f"_{name}-{uuid.uuid4().hex}.tmp"), jvm.org.apache.hadoop.fs.Path(root, f"{name}.json")
    stream = fs.create(draft, True)
    stream.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
    stream.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    try:
        files.rename(draft, last, how)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if not replace and "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{last.toString()} is there already") from e
        raise
    return last.toString()
