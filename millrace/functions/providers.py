"""Steps that a model would do, as interfaces with offline stand-ins that always give the same result."""

from __future__ import annotations

import re
import zlib
from difflib import SequenceMatcher
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Unit vectors of signed word hashes."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % self.dims] += 1 if h >> 16 & 1 else -1
            row /= np.linalg.norm(row) or 1
        return out


def embedded(chunks: DataFrame, embedder: Embedder | None = None, text: str = "text", to: str = "embedding") -> DataFrame:
    """chunks with an embedding of each text, made by the batch."""
    embedder = embedder or HashingEmbedder()
    columns = chunks.columns

    def run(batches):
        for b in batches:
            vectors = embedder(b.column(b.schema.get_field_index(text)).to_pylist())
            values = pa.array(vectors.tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*columns, to])

    from pyspark.sql import types as T

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def classified(query: str) -> dict:
    """Type, rule numbers, scenario and sub-queries of a question, by patterns."""
    rules = list(dict.fromkeys(re.findall(r"\b(?:\d{1,2}\.\d{1,3}(?:\.\d{1,2})?|[A-Z]\d{1,2}\.\d{1,4})\b", query)))
    m = re.search(fixed.SCENARIO_NAMED, query)
    low = query.lower()
    if rules and re.search(r"\b(?:compare|versus|vs|difference)\b", low):
        kind = "comparison"
    elif m:
        kind = "scenario"
    elif rules:
        kind = "direct_rule"
    elif "variant" in low or "house rule" in low:
        kind = "variant"
    elif re.search(r"\b(?:if|can i|can my|happens)\b", low):
        kind = "situation"
    else:
        kind = "concept"
    return {"query_type": kind, "rule_numbers": rules, "scenario": m and m[1], "sub_queries": []}


def listing_filters(query: Column) -> Column:
    """price_max and rating_min that a question asks for; null where it doesn't."""
    price = F.regexp_extract(query, r"(?i)(?:under|below|less than|at most|up to)\s+\$?(\d+(?:\.\d+)?)", 1)
    rating = F.regexp_extract(query, r"(?i)rat(?:ing|ed)\s+(?:of\s+)?(?:at least|above|over)\s+(\d+(?:\.\d+)?)", 1)
    return F.struct(F.when(price != "", price.cast("double")).alias("price_max"), F.when(rating != "", rating.cast("double")).alias("rating_min"))


def first_pages(text: Column, n: int = 3) -> Column:
    """The first pages of a page-marked text, as one."""
    parts = F.filter(F.split(text, "--- PAGE "), lambda p: p.rlike(r"\S"))
    return F.array_join(F.slice(parts, 1, n), " ")


def even_text(text: Column) -> Column:
    """The text in lower case with white space made even; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def ratio_from(matcher: SequenceMatcher, threshold: float) -> float | None:
    """The matcher's ratio if it is `threshold` or more, else None: its blocks are found in its own order, only until what is
    still open can't make up for what has no match."""
    size, whole = len(matcher.a) + len(matcher.b), (0, len(matcher.a), 0, len(matcher.b))
    left, found, may = [whole], 0, min(len(matcher.a), len(matcher.b))
    while left:
        if 2.0 * (found + may) < threshold * size * (1 - 1e-12):
            return None
        a, a_end, b, b_end = left.pop()
        i, j, n = matcher.find_longest_match(a, a_end, b, b_end)
        may -= min(a_end - a, b_end - b)
        found += n
        for part in ((a, i, b, j), (i + n, a_end, j + n, b_end)) if n else ():
            if part[0] < part[1] and part[2] < part[3]:
                left.append(part)
                may += min(part[1] - part[0], part[3] - part[2])
    ratio = 2.0 * found / size if size else 1.0
    return ratio if ratio >= threshold else None


def similar_text(a: Column, b: Column, threshold: float = 0.90) -> Column:
    """Whether two texts, white space made even and in lower case, are alike by the ratio of their matching blocks; not if
    either is null or blank. Texts whose lengths alone rule that out are not compared."""

    @F.pandas_udf("boolean")
    def alike(x, y):
        import pandas as pd

        def one(p: str | None, q: str | None) -> bool:
            if not p or not q or 2 * min(len(p), len(q)) < threshold * (len(p) + len(q)):
                return False
            return p == q or ratio_from(SequenceMatcher(None, p, q), threshold) is not None

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=bool)

    return alike(even_text(a), even_text(b))
