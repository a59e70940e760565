"""Parser output to pages and blocks: margins, OCR merge, sections, links, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx

#: Block kinds of parser labels, and titles of the reference section.
KINDS = {
    "section_header": "heading", "title": "heading", "list_item": "list", "table": "table", "formula": "formula",
    "picture": "picture", "caption": "caption", "page_header": "header", "page_footer": "footer",
}
REFERENCES = ["references", "bibliography", "参考文献"]
SPECIAL = ["table", "formula", "caption", "picture", "reference"]
MARGINS = ["page_header", "page_footer"]
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
OCR_ORDER = 1_000_000  # where the order of OCR lines begins, behind all native items of a page
NATIVE, OCR = "native_pdf", "rapidocr"  # fixed values: sources of blocks


def kind_of(label) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), label), F.lit("text"))


def without_margins(items: DataFrame) -> DataFrame:
    """Drops page headers and footers whose text occurs more than once among the document's margins.

    Only the margins are counted and looked up; blank ones stay.
    """
    margins = items.where(F.col("label").isin(MARGINS)).select("version_id", tx.content_key(F.col("text")).alias("key"))
    often = margins.where("key <> ''").groupBy("version_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("version_id", "key")
    gone = often.select(F.col("version_id").alias("_version"), F.col("key").alias("_margin"))
    held = items.withColumn("_own", F.when(F.col("label").isin(MARGINS), tx.content_key(F.col("text"))))
    plain = held.where("_own is null")
    left = held.where("_own is not null").join(gone, F.col("version_id").eqNullSafe(F.col("_version")) & (F.col("_own") == F.col("_margin")), "left_anti")
    return plain.unionByName(left).drop("_own")


def with_ocr(native: DataFrame, lines: DataFrame) -> DataFrame:
    """Native rows and the OCR lines whose text, white space aside, isn't on the same page already.

    ``lines`` has version_id, page_no, pos, text and, where known, confidence and points (an array
    of x and y): the line's quality and bounding box. Lines follow the page's native rows.
    """
    key = ["version_id", "page_no", "_key"]
    seen = native.select("version_id", "page_no", tx.bare_key(F.col("text")).alias("_key")).where("_key <> ''").distinct()
    fresh = lines.withColumn("_key", tx.bare_key(F.col("text"))).join(seen, key, "left_anti").drop("_key")
    fresh = fresh.withColumn("pos", F.col("pos") + OCR_ORDER).withColumn("label", F.lit("text")).withColumn("source", F.lit(OCR))
    if "points" in lines.columns:
        fresh = fresh.withColumn("bbox", tx.bounding_box(F.col("points"))).drop("points")
    if "confidence" in lines.columns:
        fresh = fresh.withColumnRenamed("confidence", "quality")
    own = native if "source" in native.columns else native.withColumn("source", F.lit(NATIVE))
    return own.unionByName(fresh, allowMissingColumns=True)


def page_rows(pages: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Preflight pages (version_id, page_no, coverage) to page rows; OCR pages (version_id, page_no, status, confidence) tell what was read.

    OCR of a version that has no pages is an error.
    """
    own = F.col("version_id"), F.col("page_no")
    rows = pages.withColumn("page_id", tx.stable_id(F.lit("page"), *own))
    if ocr is None:
        return rows.withColumn("ocr_used", F.lit(False)).withColumn("ocr_confidence", F.lit(None).cast("double"))
    check_versions(pages, ocr)
    found = ocr.select("version_id", "page_no", F.col("status").isin("success", "empty", "failed").alias("ocr_used"), F.col("confidence").alias("ocr_confidence"))
    return rows.join(found, ["version_id", "page_no"], "left").withColumn("ocr_used", F.coalesce("ocr_used", F.lit(False)))


def check_versions(pages: DataFrame, ocr: DataFrame) -> None:
    """Raises where OCR belongs to a version without pages."""
    strange = ocr.select("version_id").distinct().join(pages.select("version_id").distinct(), "version_id", "left_anti").limit(3).collect()
    if strange:
        raise ValueError(f"OCR of other versions: {[r.version_id for r in strange]}")


def blocks(items: DataFrame, pages: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Items (version_id, page_no, pos, label, text; bbox, source, quality) as blocks with section, kind, id and links.

    Items are ordered by page, place and label (repeats by text and box) and numbered; then blank
    ones go, and those of pages that aren't in ``pages`` (version_id, page_no). The last heading's
    title is the section; behind a heading of references, other blocks are references. Texts are
    stripped. The id hashes version, page, place, number, kind, text and source. A null text is blank.
    Items move once, by version, in ``parts`` partitions (see ``parts_for``), and the blocks stay there.
    """
    for name, value in (("bbox", F.lit(None).cast(BOX)), ("source", F.lit(NATIVE)), ("quality", F.lit(None).cast("double"))):
        if name not in items.columns:
            items = items.withColumn(name, value)
    kind = kind_of(F.col("label"))
    opens = tx.casefold(F.when(kind == "heading", tx.stripped(F.col("text")))).isin(REFERENCES)  # before the rows move: an Arrow function hides where they are
    marked = items.withColumn("opens", opens)
    dealt = marked.repartition(parts, "version_id") if parts else marked
    order = Window.partitionBy("version_id").orderBy("page_no", "pos", "label", "text", "bbox")
    placed = dealt.withColumn("position", F.row_number().over(order) - 1).withColumn("text", tx.stripped(F.col("text"))).where("text <> ''")
    if pages is not None:
        # one row a version, so that the join leaves the items where they are
        own = pages.groupBy(F.col("version_id").alias("_version")).agg(F.collect_set("page_no").alias("_pages"))
        placed = placed.join(own, (F.col("version_id") == F.col("_version")) & F.array_contains("_pages", F.col("page_no")), "left_semi")
    line = Window.partitionBy("version_id").orderBy("position")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(kind == "heading", F.struct("text", "opens")), True).over(upto)
    titled = placed.withColumn("kind", kind).withColumn("title", title)
    typed = titled.withColumn("kind", F.when(F.col("title.opens") & (F.col("kind") != "heading"), "reference").otherwise(F.col("kind")))
    section = F.when(F.col("title").isNotNull(), F.array("title.text")).otherwise(F.array().cast("array<string>"))
    page = F.col("version_id"), F.col("page_no")
    own = tx.stable_id(F.lit("block"), *page, F.col("pos"), F.col("position"), F.col("kind"), tx.squeezed(F.col("text")), F.col("source"))
    named = typed.select(
        "version_id", "page_no", "position", "kind", "text", section.alias("section_path"), own.alias("block_id"),
        tx.stable_id(F.lit("page"), *page).alias("page_id"), "bbox", "source", "quality",
    )
    return named.withColumn("previous_id", F.lag("block_id").over(line)).withColumn("next_id", F.lead("block_id").over(line))


def related(found: DataFrame) -> DataFrame:
    """(version_id, position, related): special blocks and the caption (else text) nearest to them on the page, both ways.

    Nearness counts the blocks that are left, so it follows their order, not their first numbers; of
    two that are equally near the one before counts. One sorted pass over a page sees the last and the
    next caption and text of every block, whatever the page holds.
    """
    line = Window.partitionBy("version_id").orderBy("position")
    page = Window.partitionBy("version_id", "page_no").orderBy("position")
    before, after = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(1, Window.unboundedFollowing)
    numbered = found.select("version_id", "page_no", "position", "kind", F.row_number().over(line).alias("place"))
    spots = []
    for kind in ("caption", "text"):
        own = F.when(F.col("kind") == kind, F.struct("place", "position"))
        last, following = F.last(own, True).over(before), F.first(own, True).over(after)
        closer = following.isNotNull() & (last.isNull() | (following["place"] - F.col("place") < F.col("place") - last["place"]))
        spots.append(F.when(closer, following["position"]).otherwise(last["position"]))
    special = numbered.select("version_id", "kind", F.col("position").alias("a"), F.coalesce(*spots).alias("b"))
    pairs = special.where(F.col("kind").isin("table", "picture", "formula") & F.col("b").isNotNull()).select("version_id", "a", "b")
    both = pairs.unionAll(pairs.select("version_id", "b", "a"))
    return both.groupBy("version_id", F.col("a").alias("position")).agg(F.sort_array(F.collect_set("b")).alias("related"))


def document(items: DataFrame, pages: DataFrame, ocr_pages: DataFrame | None = None, ocr_lines: DataFrame | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page rows, blocks with related_ids) of whole documents: margins, OCR merge, order, sections, links."""
    kept = without_margins(items)
    merged = with_ocr(kept, ocr_lines) if ocr_lines is not None else kept
    found = blocks(merged, pages, parts)
    near = related(found).select("version_id", "position", F.explode("related").alias("other"))
    ids = found.select("version_id", F.col("position").alias("other"), F.col("block_id").alias("other_id"))
    links = near.join(ids, ["version_id", "other"]).groupBy("version_id", "position").agg(F.sort_array(F.collect_set("other_id")).alias("related_ids"))
    linked = found.join(links, ["version_id", "position"], "left").withColumn("related_ids", F.coalesce("related_ids", F.array().cast("array<string>")))
    return page_rows(pages, ocr_pages), linked


def _bad(text) -> F.Column:
    return F.length(F.regexp_replace(text, "[^\\x{FFFD}\\p{Cc}]|" + tx.WHITE, ""))


def _black(text) -> F.Column:
    return F.length(F.regexp_replace(text, tx.WHITE, ""))


def garbled_share(text) -> F.Column:
    """The share of replacement and control characters among those that aren't white space.

    Strings here are UTF-8, which has no surrogates: a lone one is a replacement character already.
    """
    return F.coalesce(F.try_divide(_bad(text), _black(text)), F.lit(0.0))


def covered_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with ``covered``: whether a block with text is on it."""
    some = found.where(tx.stripped(F.col("text")) != "").select("version_id", "page_no").distinct().withColumn("covered", F.lit(True))
    return pages.join(some, ["version_id", "page_no"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def missing_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages (version_id, page_no) that have no block with text."""
    return pages.join(found.where(tx.stripped(F.col("text")) != ""), ["version_id", "page_no"], "left_anti").select("version_id", "page_no")


def kind_counts(found: DataFrame) -> DataFrame:
    """(version_id, blocks, headings, tables, formulas)."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return found.groupBy("version_id").agg(F.count("*").alias("blocks"), count("heading").alias("headings"), count("table").alias("tables"), count("formula").alias("formulas"))


def quality(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Pages (version_id, page_no, covered, garbled, ocr_status, confidence) to one report per version.

    Warnings name the pages without text and those where OCR failed, a high share of garbled
    characters, a low confidence of OCR and, by ``counts`` (see ``kind_counts``), documents with
    blocks but without headings.
    """
    ok = (F.col("ocr_status") == "success") & F.col("confidence").isNotNull()
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("page_no").cast("int"))))
    out = pages.groupBy("version_id").agg(
        F.count("*").alias("pages"), F.count_if("covered").alias("with_text"), F.round(F.avg("garbled"), 9).alias("garbled"),
        F.round(F.avg(F.when(ok, F.col("confidence"))), 9).alias("confidence"), F.count_if(F.col("ocr_status") == "failed").alias("failed_ocr"),
        listed(~F.col("covered")).alias("missing_pages"), listed(F.col("ocr_status") == "failed").alias("failed_pages"),
    ).withColumn("coverage", F.round(F.coalesce(F.try_divide("with_text", "pages"), F.lit(0.0)), 9))
    if counts is not None:
        out = out.join(counts, "version_id", "left")
    bare = F.coalesce((F.col("blocks") > 0) & (F.col("headings") == 0), F.lit(False)) if counts is not None else F.lit(False)
    level = (
        F.when((F.col("pages") == 0) | (F.col("coverage") < 0.5), "failed")
        .when((F.col("coverage") < 0.9) | (F.col("garbled") > 0.1) | (F.coalesce("confidence", F.lit(1.0)) < 0.6) | (F.col("failed_ocr") > 0), "partially_ready")
        .otherwise("ready")
    )
    numbers = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ", ")
    notes = F.array_compact(F.array(
        F.when(F.size("missing_pages") > 0, F.concat(F.lit("Missing text on PDF pages: "), numbers("missing_pages"))),
        F.when(F.size("failed_pages") > 0, F.concat(F.lit("OCR failed on PDF pages: "), numbers("failed_pages"))),
        F.when(F.col("garbled") > 0.1, F.format_string("Garbled character ratio is high: %.3f", "garbled")),
        F.when(F.col("confidence") < 0.6, F.format_string("OCR confidence is low: %.3f", "confidence")),
        F.when(bare, "No section structure was detected"),
    ))
    own = tx.stable_id(F.lit("quality"), F.col("version_id"))
    return out.withColumn("level", level).withColumn("warnings", notes).withColumn("quality_report_id", own).drop("failed_pages")


def page_metrics(boxes: DataFrame) -> DataFrame:
    """Text boxes (version_id, page_no, x0, y0, x1, y1, text, width, height) to one row per page.

    Coverage is the boxes' area within the page over the page's area, 1 at most; few characters,
    little coverage or many garbled ones ask for OCR. A page without area has coverage 0.
    """
    across = F.greatest(F.lit(0.0), F.least("x1", "width") - F.greatest("x0", F.lit(0.0)))
    down = F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest("y0", F.lit(0.0)))
    chars, bad = F.coalesce(_black(F.col("text")), F.lit(0)), F.coalesce(_bad(F.col("text")), F.lit(0))
    page = boxes.groupBy("version_id", "page_no").agg(
        F.sum(chars).alias("chars"), F.sum(bad).alias("bad"), F.sum(across * down).alias("area"), F.max(F.col("width") * F.col("height")).alias("whole"),
    )
    measured = page.select(
        "version_id", "page_no", "chars", F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide("area", "whole"), F.lit(0.0))), 9).alias("coverage"),
        F.round(F.coalesce(F.try_divide("bad", "chars"), F.lit(0.0)), 9).alias("garbled"),
    )
    return measured.withColumn("needs_ocr", (F.col("chars") < 40) | (F.col("coverage") < 0.002) | (F.col("garbled") > 0.1))


def page_level(covered, garbled, ocr_status, confidence) -> F.Column:
    """The level of one page; the report of its version is ``quality``."""
    worse = (garbled > 0.1) | (ocr_status == "failed") | (confidence < 0.6)
    return F.when(~covered, "failed").when(worse, "partially_ready").otherwise("ready")


def propagated(versions: DataFrame, papers: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions' parse status, and the status and quality level of papers whose active version has a report."""
    level = reports.select("version_id", "level")
    own = versions.join(level, "version_id", "left")
    parsed = own.withColumn("parse_status", F.coalesce("level", "parse_status")).drop("level")
    active = papers.join(level.withColumnRenamed("version_id", "active_version_id"), "active_version_id", "left")
    return parsed, active.withColumn("status", F.coalesce("level", "status")).withColumn("quality_level", F.coalesce("level", "quality_level")).drop("level")
