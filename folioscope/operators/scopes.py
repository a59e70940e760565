"""What a question's scope allows, and the best hits of a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["paper_ids", "version_ids", "include_references"]
META = ["paper_id", "version_id", "content_type"]


def conjunction(conditions: list[Column]) -> Column | None:
    """None of no conditions, the one itself, else all of them."""
    return reduce(Column.__and__, conditions) if conditions else None


def scope_condition(columns: list[str], own=F.col) -> Column | None:
    """What a question's scope asks of a chunk, from the scope columns that are there.

    ``paper_ids`` and ``version_ids`` (arrays) name the papers and versions allowed; null or empty
    ones allow all. Chunks of content type reference are left out unless ``include_references``
    is true; without that column they stay. A chunk of unknown paper, version or type fits no
    list, and is no reference. ``own`` takes a chunk's column name to the column.
    """
    found = []
    for ids, name in (("paper_ids", "paper_id"), ("version_ids", "version_id")):
        if ids in columns:
            found.append(_free(ids) | F.coalesce(F.array_contains(ids, own(name)), F.lit(False)))
    if "include_references" in columns:
        found.append(F.coalesce("include_references", F.lit(False)) | (F.coalesce(own("content_type"), F.lit("")) != "reference"))
    return conjunction(found)


def bundle_condition(columns: list[str]) -> Column | None:
    """As ``scope_condition``, of a bundle of chunks by its ``papers``, ``versions`` and whether it ``has_text``: false where no chunk fits."""
    found = []
    for ids, held in (("paper_ids", "papers"), ("version_ids", "versions")):
        if ids in columns:
            found.append(_free(ids) | F.coalesce(F.arrays_overlap(ids, held), F.lit(False)))
    if "include_references" in columns:
        found.append(F.coalesce("include_references", F.lit(False)) | F.col("has_text"))
    return conjunction(found)


def _free(ids: str) -> Column:
    return F.coalesce(F.size(ids), F.lit(0)) <= 0


def best(hits: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """Hits with their rank among those of their question, up to ``limit``."""
    if limit <= 0:
        raise ValueError("a limit must be positive")
    line = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.asc("chunk_id")]))
    return hits.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= limit)
