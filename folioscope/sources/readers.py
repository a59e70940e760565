"""Scans: tables, text and markdown files, web pages, PDF bytes and pages, parser JSON, OCR."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.arrow import arrow_schema, batch_of
from folioscope.operators import seams

_PROV = "prov:array<struct<page_no:int,bbox:string>>,page_no:int,bbox:string"
PARSED = (
    f"texts array<struct<label:string,text:string,{_PROV}>>, "
    f"tables array<struct<label:string,text:string,data:struct<table_cells:array<struct<text:string>>>,{_PROV}>>, "
    f"pictures array<struct<label:string,text:string,data:struct<table_cells:array<struct<text:string>>>,{_PROV}>>"
)
CASES = "id string, fixture string, question string, scope array<string>, evidence array<string>, layer string"
#: States of a conversion that give a document.
CONVERTED = ["success", "partial_success"]
MAGIC = b"%PDF-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of some keys: a pushed-down filter."""
    return rows.where(F.col(key).isin(values))


def text_files(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Whole files below a path, with their place."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"), F.lit(kind).alias("file_type"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole markdown files below a path."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True)
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"), F.lit("markdown").alias("file_type"))


def pdf_uploads(spark: SparkSession, path: str, most: int = 100 << 20, known: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """(path, length, sha256, title, problem, duplicate) of all files below a path; contents are read where they are and aren't moved.

    ``problem`` (null: fine) is the first of: the name doesn't end in .pdf, the declared type
    (``kinds``: path, content_type) is another, the file is empty, too large, or doesn't begin as
    one; most stores' scans pass over empty files, which then have no row at all. Of equal contents, the first path is the upload and the others are duplicates, all of them
    if the content is ``known`` (sha256).
    """
    files = spark.read.format("binaryFile").load(path)
    head = F.when(F.col("length") <= most, F.col("content"))
    rows = files.select("path", "length", F.substring(head, 1, len(MAGIC)).alias("head"), F.sha2(head, 256).alias("sha256"))
    rows = rows.join(kinds.select("path", "content_type"), "path", "left") if kinds is not None else rows.withColumn("content_type", F.lit(None).cast("string"))
    problem = (
        F.when(~F.lower("path").endswith(".pdf"), "not_a_pdf_name").when(F.coalesce("content_type", F.lit("application/pdf")) != "application/pdf", "wrong_type")
        .when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large").when(F.col("head") != F.lit(MAGIC), "no_pdf_header")
    )
    rows = rows.withColumn("problem", problem).withColumn("title", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))
    fine = rows.where("problem is null")
    first = fine.groupBy("sha256").agg(F.min("path").alias("first"))
    told = rows.join(first, "sha256", "left")
    if known is not None:
        told = told.join(known.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left")
    else:
        told = told.withColumn("_known", F.lit(None).cast("boolean"))
    again = F.col("problem").isNull() & (F.coalesce("_known", F.lit(False)) | (F.col("path") != F.col("first")))
    return told.select("path", "length", "sha256", "title", "problem", again.alias("duplicate"))


def pdf_files(spark: SparkSession, path: str, most: int = 100 << 20, known: DataFrame | None = None) -> DataFrame:
    """Contents of valid PDF files: of equal ones one, and none that is known. Paths are chosen first, then read."""
    uploads = pdf_uploads(spark, path, most, known).where("problem is null and not duplicate")
    return spark.read.format("binaryFile").load(path).join(uploads.select("path", "sha256", "title"), "path")


PREFLIGHT = "path string, page_no int, text string, width double, height double, x0 double, y0 double, x1 double, y1 double, error string"


def preflight(files: DataFrame, read: seams.PageReader, most_pages: int = 1000) -> DataFrame:
    """Files (path, content) to the text boxes of their pages (see ``PREFLIGHT``), for ``normalize.page_metrics``.

    ``read`` gives the pages of a file, each with width, height and boxes (x0, y0, x1, y1, text); a
    page without boxes gives one row without text. A file that can't be read, is encrypted, has no
    page or too many gives one row with an ``error``.
    """

    shape = arrow_schema(PREFLIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _boxes(path, content.as_py(), read, most_pages)
                yield batch_of(rows, shape)

    return files.select("path", "content").mapInArrow(run, PREFLIGHT)


def _boxes(path: str, content: bytes, read: seams.PageReader, most_pages: int) -> list[tuple]:
    failed = lambda why: [(path, *[None] * 8, why)]
    if not content.startswith(MAGIC):
        return failed("not a PDF")
    try:
        pages = read(content)
    except Exception as e:  # the reader's own: the file gets an error row, the others go on
        return failed(f"{type(e).__name__}: {e}")
    if not 0 < len(pages) <= most_pages:
        return failed("no pages" if not pages else "too many pages")
    out = []
    for n, page in enumerate(pages, 1):
        size = float(page["width"]), float(page["height"])
        for x0, y0, x1, y1, text in page.get("boxes") or [(0.0, 0.0, 0.0, 0.0, None)]:
            out.append((path, n, text, *size, float(x0), float(y0), float(x1), float(y1), None))
    return out


def page_images(files: DataFrame, pages: DataFrame, render: seams.Renderer, dpi: int = 200) -> DataFrame:
    """Pages (path, page_no from 1) of files (path, content) as images: (path, page_no, image, error)."""
    schema = "path string, page_no int, image binary, error string"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, page in zip(*(batch.column(i) for i in range(3))):
                try:
                    row = (path.as_py(), page.as_py(), render(content.as_py(), page.as_py(), dpi), None)
                except Exception as e:  # the renderer's own
                    row = (path.as_py(), page.as_py(), None, f"{type(e).__name__}: {e}")
                yield batch_of([row], shape)

    asked = pages.select("path", F.col("page_no").cast("int").alias("page_no"))
    return files.select("path", "content").join(asked, "path").select("path", "content", "page_no").mapInArrow(run, schema)


OCR_PAGES = "version_id string, page_no int, status string, source string, lines array<struct<text:string,confidence:double,points:array<struct<x:double,y:double>>>>, confidence double, low_confidence boolean, error string"


def ocr(pages: DataFrame, engine: seams.OcrEngine, low: float = 0.6) -> DataFrame:
    """Pages (version_id, page_no, needs_ocr, image) through an OCR engine: one row per page (see ``OCR_PAGES``).

    Pages that don't need it are ``skipped`` and never sent. The others are ``success`` with lines
    (text, confidence, corner points), ``empty`` without, or ``failed`` with the error, after which
    the rest goes on. The confidence is the lines' mean; without one, or below ``low``, it is low.
    """
    own = [F.col("version_id").cast("string").alias("version_id"), F.col("page_no").cast("int").alias("page_no")]
    wanted = F.coalesce("needs_ocr", F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    lines = OCR_PAGES.split("lines ")[1].split(", confidence double,")[0]
    skipped = pages.where(~wanted).select(
        *own, F.lit("skipped").alias("status"), F.lit("native_text").alias("source"), F.array().cast(lines).alias("lines"),
        none("double").alias("confidence"), F.lit(False).alias("low_confidence"), none("string").alias("error"),
    )

    shape = arrow_schema(OCR_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for version, page, image in zip(*(batch.column(i) for i in range(3))):
                yield batch_of([(version.as_py(), page.as_py(), *_recognised(engine, image.as_py(), low))], shape)

    return pages.where(wanted).select(*own, "image").mapInArrow(run, OCR_PAGES).unionByName(skipped)


def _recognised(engine: seams.OcrEngine, image: bytes, low: float) -> tuple:
    try:
        lines = [{"text": str(t), "confidence": float(c), "points": [{"x": float(x), "y": float(y)} for x, y in points]} for t, c, points in engine(image)]
    except Exception as e:  # the engine's own: the page has failed
        return "failed", "rapidocr", [], None, True, f"{type(e).__name__}: {e}"
    mean = sum(x["confidence"] for x in lines) / len(lines) if lines else None
    return "success" if lines else "empty", "rapidocr", lines, mean, mean is None or mean < low, None


def ocr_lines(pages: DataFrame) -> DataFrame:
    """The lines of successful OCR pages: (version_id, page_no, pos, text, confidence, points)."""
    rows = pages.where("status = 'success'").select("version_id", "page_no", F.posexplode("lines").alias("pos", "l"))
    return rows.select("version_id", "page_no", "pos", "l.text", "l.confidence", "l.points")


def converted(files: DataFrame, convert: seams.Converter) -> DataFrame:
    """Files (path, content) through a converter: (path, status, json, error); a failure is a row with status failure."""
    schema = "path string, status string, json string, error string"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    row = (path.as_py(), *convert(content.as_py()))
                except Exception as e:  # the converter's own
                    row = (path.as_py(), "failure", None, f"{type(e).__name__}: {e}")
                yield batch_of([row], shape)

    return files.select("path", "content").mapInArrow(run, schema)


def accepted(conversions: DataFrame) -> DataFrame:
    """Conversions (status, json) that gave a document, whole or in part."""
    return conversions.where(F.col("status").isin(CONVERTED) & F.col("json").isNotNull())


def pdf_pages(files: DataFrame, read: seams.PageReader) -> DataFrame:
    """Files (path, content) as documents, one a page: (text, source, page, page_label, file_type); pages count from 0, labels from 1."""
    boxes = preflight(files, read, most_pages=1 << 30).where("error is null")
    page = boxes.groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("b"))
    text = F.array_join(F.transform("b", lambda b: b["text"]), "\n")
    rows = page.select(text.alias("text"), F.col("path").alias("source"), (F.col("page_no") - 1).alias("page"), F.lit("pdf").alias("file_type"))
    return rows.withColumn("page_label", page_label(F.col("page")))


def page_label(page) -> F.Column:
    """The number that a page is shown with; unknown pages have none."""
    return F.when(page.isNotNull(), page + 1)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Acceptance cases: a JSON array of objects."""
    return spark.read.schema(CASES).json(path, multiLine=True)


def page_texts(pages: DataFrame) -> DataFrame:
    """Text of web pages: scripts, styles and navigation go, tags become blanks."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav)[^>]*>.*?</\1>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return pages.select("page_id", "url", plain.alias("text"), F.lit("webpage").alias("file_type"))


def parsed_items(rows: DataFrame) -> DataFrame:
    """Parser JSON (version_id, json) to items in order: (version_id, pos, label, text, page_no, bbox).

    Texts, tables, pictures; an item's own label counts, else that of its list. The text wins over
    the cells of a table. An item is listed for each of its places, with one number; without any it
    stands on its page, or on page 1. Boxes are objects or lists of four.
    """
    doc = rows.select("version_id", F.from_json("json", PARSED).alias("d"))
    cells = lambda t: F.array_join(F.filter(F.transform(t["data"]["table_cells"], lambda c: c["text"]), lambda x: x != ""), "\n")
    text = lambda t, n: t["text"] if n == "texts" else F.coalesce(t["text"], cells(t))

    def part(name: str, label: str) -> F.Column:
        empty = F.array().cast("array<struct<label:string,text:string,prov:array<struct<page_no:int,bbox:string>>,page_no:int,bbox:string>>")
        own = lambda t: F.struct(F.coalesce(F.nullif(t["label"], F.lit("")), F.lit(label)).alias("label"), text(t, name).alias("text"), t["prov"].alias("prov"), t["page_no"].alias("page_no"), t["bbox"].alias("bbox"))
        return F.coalesce(F.transform(f"d.{name}", own), empty)

    items = doc.select("version_id", F.posexplode(F.concat(part("texts", "text"), part("tables", "table"), part("pictures", "picture"))).alias("pos", "i"))
    placed = items.select("version_id", "pos", "i.label", "i.text", "i.page_no", "i.bbox", F.explode_outer("i.prov").alias("p"))
    page = F.when(F.col("p").isNull(), F.coalesce("page_no", F.lit(1))).otherwise(F.coalesce(F.nullif("p.page_no", F.lit(0)), F.lit(1)))
    return placed.select("version_id", "pos", "label", "text", page.alias("page_no"), tx.box_of(F.coalesce("p.bbox", "bbox")).alias("bbox"))


import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have the package
