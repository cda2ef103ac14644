"""Laid-out files to spans of text with font size and place, to lines, to chunks by headings and to entities of sheets. What
reads a file's spans is given as a function; the stand-in here needs no library."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunking, layout
from .shared import saved


class Span(NamedTuple):
    """A piece of a line: pages count from 1, blocks and lines are any numbers within their page and block."""

    page: int
    block: int
    line: int
    text: str
    size: float | None
    x0: float
    y0: float
    x1: float
    y1: float


Extractor = Callable[[bytes], Iterable[Span]]


def plain_spans(content: bytes) -> Iterator[Span]:
    """Files with one span a line, as a JSON object of a Span's fields."""
    for line in content.splitlines():
        if line.strip():
            yield Span(**json.loads(line))


def pdf_spans(content: bytes) -> Iterator[Span]:
    """Spans of a PDF in the file's own order, where PyMuPDF is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                for n, line in enumerate(block.get("lines", [])):
                    for s in line["spans"]:
                        yield Span(number, b, n, s["text"], s["size"], *s["bbox"])


def stem(path: Column) -> Column:
    """A file's name without its folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def file_spans(files: DataFrame, extract: Extractor = plain_spans, rows: int = 10_000) -> DataFrame:
    """doc (the file's name without ending), seq from 0, the fields of a Span, and error. A file that can't be read has one
    row with its error in place of what remains of its spans; null contents have no rows. `rows` go in a batch, so a file's
    spans are not held at once."""
    fields = [("page", pa.int32()), ("block", pa.int32()), ("line", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("size", "x0", "y0", "x1", "y1"))]
    arrow = pa.schema([("doc", pa.string()), ("seq", pa.int64()), *fields, ("error", pa.string())])
    schema = "doc string, seq bigint, page int, block int, line int, text string, size double, x0 double, y0 double, x1 double, y1 double, error string"

    def found(doc: str, content: bytes) -> Iterator[dict]:
        n = 0
        try:
            for n, span in enumerate(extract(content), 1):
                yield {"doc": doc, "seq": n - 1, **span._asdict()}
        except Exception as e:  # one broken file doesn't end the job
            yield {"doc": doc, "seq": n, "error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = found(doc, content.as_py()) if content.is_valid else iter(())
                while part := list(islice(own, rows)):
                    yield pa.RecordBatch.from_pylist(part, schema=arrow)

    return files.select(stem(F.col("path")).alias("doc"), "content").mapInArrow(run, schema)


def lines(spans: DataFrame) -> DataFrame:
    """doc, seq, page, text and size (the largest of its spans) of lines, in order of page, of the tops of blocks and then of
    lines. A doc's spans are shuffled once, and its chunkers need no further shuffle."""
    by = lambda *keys: Window.partitionBy("doc", *keys)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    own = spans.repartition("doc").groupBy("doc", "page", "block", "line").agg(F.array_join(pieces, "").alias("text"), F.max("size").alias("size"), F.min("y0").alias("top"))
    placed = own.withColumn("block_top", F.min("top").over(by("page", "block")))
    order = by().orderBy("page", "block_top", "block", "top", "line")
    return placed.withColumn("seq", F.row_number().over(order)).select("doc", "seq", "page", "text", "size")


def read_folder(spark: SparkSession, folder: str, extract: Extractor = plain_spans, glob: str = "*.pdf") -> DataFrame:
    """file_spans of a folder and the folders in it, stored: each file is read once, however often its spans are used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return saved(file_spans(files, extract), "spans")


def section_chunks(spans: DataFrame, carriers: Column) -> DataFrame:
    """chunking.layout_chunks of stored file_spans; carriers is a column over doc. Files with an error have no chunks."""
    good = readable(spans)
    sized = lines(good).join(chunking.body_size(good), "doc")
    return chunking.layout_chunks(sized.withColumn("carrier", carriers))


def readable(spans: DataFrame) -> DataFrame:
    """The spans of files without an error. Few files have one, but nothing bounds them, so this is a join by doc."""
    return spans.filter("error is null").join(spans.filter("error is not null").select("doc").distinct(), "doc", "left_anti")


def sheets(spans: DataFrame) -> DataFrame:
    """layout.entities of the first pages of stored file_spans, without files that have an error."""
    return layout.entities(readable(spans).filter("page = 1").select("doc", "seq", "text", "x0", "y0", "x1", "y1"))
