"""The partitioned vector index: recall against exact search, whatever share of the chunks a scope allows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval, vectors

SF = "/root/testdata/sf0.1"


def recall(index, rows, asked, limit=10):
    exact, got = retrieval.vector_search(asked, rows, limit).collect(), index.search(asked, limit).collect()
    want, found = {(r.query_id, r.chunk_id): r.score for r in exact}, {(r.query_id, r.chunk_id): r.score for r in got}
    assert all(abs(want[k] - s) < 1e-6 for k, s in found.items() if k in want)
    assert len(found) == len(want)
    return len(want.keys() & found.keys()) / len(want)


def papers(rows):
    i = F.col("chunk_id")
    kind = F.when(i % 4 == 0, "reference").otherwise("text")
    return rows.withColumn("paper_id", i % 100).withColumn("version_id", F.when(i % 2 == 0, "a").otherwise("b")).withColumn("content_type", kind)


def test_recall_by_selectivity(spark, tmp_path):
    rows = papers(spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")).cache()
    index = vectors.build_vector_index(rows, f"file://{tmp_path}/index")
    assert index.rows.count() == rows.count() and index.probes < len(index.centroids)
    asked = rows.where("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    ids = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    every = asked.withColumn("include_references", F.lit(True))
    assert recall(index, rows, asked) >= 0.9
    assert recall(index, rows, every.withColumn("version_ids", F.array(F.lit("a")))) >= 0.9  # half of all
    assert recall(index, rows, every.withColumn("paper_ids", ids(*range(10)))) >= 0.9  # a tenth
    assert recall(index, rows, asked.withColumn("include_references", F.lit(False)).withColumn("paper_ids", ids(3, 4))) == 1.0  # a fiftieth: all of it is seen
    narrow = index.visits(every.withColumn("paper_ids", ids(3)), 10).groupBy("query_id").count()
    assert {r["count"] for r in narrow.collect()} == {index.census.where("paper_id = 3").select("list").distinct().count()}  # every list with an allowed chunk, no other
    assert index.visits(every, 10).groupBy("query_id").count().agg(F.max("count")).first()[0] < len(index.centroids)


def test_a_hot_list_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[300:700] = x[5] + rng.normal(size=(400, 8)) * 1e-3
    rows = papers(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>"))
    index = vectors.build_vector_index(rows, f"file://{tmp_path}/index")
    assert index.rows.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 140
    asked = rows.where("chunk_id % 90 = 5").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert recall(index, rows, asked, 5) >= 0.9


def test_edges(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    index = vectors.build_vector_index(rows, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in index.search(asked).orderBy("rank").collect()] == [(1, 1, 1), (1, 6, 2)]
    with pytest.raises(ValueError):
        index.search(asked, 0)
    with pytest.raises(ValueError):
        vectors.build_vector_index(rows.limit(0), f"file://{tmp_path}/none")
