"""Scanned and printed files to page-marked texts. What reads a file's pages and what reads a picture are given as functions;
the stand-ins here need no library."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .shared import saved


class Page(NamedTuple):
    """Native text, whether pictures are embedded, and what makes a picture of the page, called where it is needed only."""

    native: str | None
    has_image: bool
    picture: Callable[[], bytes] | None


class Extractor(Protocol):
    """The pages of a file, one after another: a page's picture is made before the next page is asked for."""

    def __call__(self, content: bytes) -> Iterable[Page]: ...


class Reader(Protocol):
    """The text in a picture."""

    def __call__(self, picture: bytes) -> str: ...


#: Stands before the text of a page that is a picture, in files of plain_pages.
PICTURE = b"PICTURE:"


def plain_pages(content: bytes) -> Iterator[Page]:
    """Pages set apart by form feeds; one that begins with PICTURE has no native text."""
    for p in content.split(b"\f"):
        yield Page(None, True, lambda p=p: p[len(PICTURE) :]) if p.startswith(PICTURE) else Page(p.decode("utf-8", "replace"), False, None)


def plain_reader(picture: bytes) -> str:
    return picture.decode("utf-8", "replace")


def pdf_pages(content: bytes) -> Iterator[Page]:
    """Pages of a PDF, where PyMuPDF is installed; a page is rendered when its picture is asked for."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            yield Page(page.get_text(), bool(page.get_images()), lambda page=page: page.get_pixmap(dpi=300).tobytes("png"))


def page_texts(files: DataFrame, extract: Extractor = plain_pages, read: Reader | None = plain_reader, least: int = 50) -> DataFrame:
    """source_file, page from 1, kind (native, ocr or empty), text and has_image of the pages of files (path, content).
    Pictures are made and read only where the native text has fewer than `least` characters, one at a time; null contents
    have no pages."""
    schema = "source_file string, page int, native string, scanned string, has_image boolean"
    arrow = pa.schema([("source_file", pa.string()), ("page", pa.int32()), ("native", pa.string()), ("scanned", pa.string()), ("has_image", pa.bool_())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for k, page in enumerate(extract(content.as_py()) if content.is_valid else []):
                    wanted = page.picture is not None and read is not None and len((page.native or "").strip()) < least
                    rows.append({"source_file": path.rsplit("/", 1)[-1], "page": k + 1, "native": page.native, "scanned": read(page.picture()) if wanted else None, "has_image": page.has_image})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    pages = files.select("path", "content").mapInArrow(run, schema)
    return pages.withColumn("p", tables.page_text(F.col("native"), F.col("scanned"), least)).select("source_file", "page", F.col("p.kind").alias("kind"), F.col("p.text").alias("text"), "has_image")


def marked_texts(pages: DataFrame, caps: DataFrame | None = None, empty: bool = True) -> DataFrame:
    """source_file and text with a marker before each page; caps (source_file, max_pages) leaves out files of 0 pages and
    pages beyond the cap, null is no cap. A file's pages are one group, as large as the file."""
    if caps is not None:
        pages = pages.join(caps, "source_file", "left").filter(F.col("max_pages").isNull() | (F.col("page") <= F.col("max_pages"))).drop("max_pages")
    if not empty:
        pages = pages.filter("kind <> 'empty'")
    tag = F.when(F.col("kind") == "ocr", " [OCR]").when(F.col("kind") == "empty", " [EMPTY]").otherwise("")
    block = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), tag, F.lit(" ---\n"), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("b")))), lambda x: x["b"])
    return pages.groupBy("source_file").agg(F.array_join(lines, "\n").alias("text"))


def unread(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path) whose name, but for its ending, none of done (source_file) has."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return files.join(done.select(stem(F.col("source_file")).alias("__stem")), stem(F.col("path")) == F.col("__stem"), "left_anti")


def read_folder(spark: SparkSession, folder: str, to: str, extract: Extractor = plain_pages, read: Reader | None = plain_reader, glob: str = "*.pdf") -> DataFrame:
    """Appends the texts of a folder's files that `to`, a Parquet table of source_file and text, does not have yet; returns
    page_statistics of what was read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/_SUCCESS")
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        files = unread(files, spark.read.parquet(to))
    pages = saved(page_texts(files, extract, read), "pages")  # each file is read once, for its text and its statistics
    marked_texts(pages).write.mode("append").parquet(to)
    return statistics(pages)


def statistics(pages: DataFrame) -> DataFrame:
    return tables.page_statistics(pages.select("source_file", F.struct("kind", "text").alias("p")))
