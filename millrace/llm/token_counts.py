"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table, broadcast to all tasks: the token lengths of the pre-tokens that are most frequent in all
documents. Tier two is a cache of the Python worker for pre-tokens that the table lacks; each is encoded once.
Pre-tokens never cross the network: a first pass leaves one summary of bounded size for each task, and summaries are
merged pairwise in rounds.

The lookup unit is a run of text between white space, since this tokenizer drops white space and no token spans it.

Defined cases: null texts and empty texts have 0 bytes and 0 tokens; repeated rows give one result row each; other
columns of the input are not touched unless named in `keep`; an empty table gives an empty result. No text is cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from heapq import nlargest

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, shuffle_partitions, worker_cache

#: Entries of the broadcast table, and so of each task's summary.
TABLE_ENTRIES = 16_384
#: Entries of a worker's cache; it starts anew when full. The count of a text doesn't depend on it.
CACHE_ENTRIES = 300_000
#: Summaries merged by one task in one round.
MERGE_WIDTH = 64

#: Fixed values of the tokenizer file: its pre-token pattern and its special strings.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: str.split() also splits at these, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPECIAL = re.compile("|".join(map(re.escape, SPECIAL)))


def normalised(text: str) -> str:
    """The tokenizer's normal form but for white space: NFC, then each code point in lower case by itself."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # Python alone has a special form at a word's end
            text = text.replace("Σ", "σ")
    return text.lower()


class TokenLengths(dict):
    """Number of tokens of a run of normalised text without white space; missing runs are encoded and kept."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model = Tokenizer.from_file(tokenizer_file).model
        self.to_symbols = ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(PRE_TOKEN).findall
        self.fixed: dict[str, int] = {}

    def load(self, table: dict[str, int]) -> None:
        """Makes the broadcast table this cache's first tier."""
        if self.fixed is not table:
            self.fixed = table
            self.clear()
            self.update(table)

    def __missing__(self, run: str) -> int:
        n = sum(len(self.model.tokenize(self.to_symbols.pre_tokenize_str(x)[0][0])) for x in self.find(run))
        if len(self) >= CACHE_ENTRIES + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        self[run] = n
        return n

    def runs(self, text: str) -> list[str]:
        text = normalised(text)
        if _SEPARATORS.search(text):
            return regex.split(r"\p{White_Space}+", text)
        return text.split()

    def count(self, text: str) -> int:
        if "<|" in text:
            parts = _SPECIAL.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.runs(x))) for x in parts)
        return sum(map(self.__getitem__, self.runs(text)))


def lengths_of(tokenizer_file: str) -> TokenLengths:
    """This worker's lookup for a tokenizer file."""
    cache = worker_cache("token lengths")
    if tokenizer_file not in cache:
        cache[tokenizer_file] = TokenLengths(tokenizer_file)
    return cache[tokenizer_file]


def _top(counts: Counter, entries: int) -> list[tuple[str, int]]:
    return nlargest(entries, counts.items(), key=lambda x: (x[1], x[0]))


_SUMMARY = pa.schema([("part", pa.int32()), ("runs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _summary(part: int, counts: Counter, entries: int) -> pa.RecordBatch:
    top = _top(counts, entries)
    return pa.RecordBatch.from_pylist([{"part": part, "runs": [x for x, _ in top], "counts": [n for _, n in top]}], schema=_SUMMARY)


def frequent_runs(docs: DataFrame, tokenizer_file: str, text: str = "text", entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent runs over all documents, from summaries of at most `entries` runs for each task."""

    def count(batches):
        from pyspark import TaskContext

        lengths, seen = lengths_of(tokenizer_file), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    seen.update(lengths.runs(x))
            if len(seen) > 8 * entries:
                seen = Counter(dict(_top(seen, 4 * entries)))
        yield _summary(TaskContext.get().partitionId(), seen, entries)

    def merge(batches):
        seen: dict[int, Counter] = {}
        for batch in batches:
            for row in batch.to_pylist():
                seen.setdefault(row["part"], Counter()).update(dict(zip(row["runs"], row["counts"])))
        for part, counts in seen.items():
            yield _summary(part, counts, entries)

    schema = "part int, runs array<string>, counts array<bigint>"
    tasks, found = docs.select(text), None
    found = saved(tasks.mapInArrow(count, schema))
    left = found.select(F.max("part")).first()[0]
    while left is not None and left > 0:
        left //= MERGE_WIDTH
        width = min(left + 1, shuffle_partitions(docs.sparkSession))
        found = found.withColumn("part", F.floor(F.col("part") / MERGE_WIDTH).cast("int")).repartitionById(width, F.pmod("part", F.lit(width)))
        found = saved(found.mapInArrow(merge, schema))
    rows = found.collect()  # one summary, of bounded size
    return list(rows[0]["runs"]) if rows else []


def count_tokens(docs: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, entries: int = TABLE_ENTRIES) -> DataFrame:
    """`keep`, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs."""
    lengths = lengths_of(tokenizer_file)
    table = docs.sparkSession.sparkContext.broadcast({x: lengths[x] for x in frequent_runs(docs, tokenizer_file, text, entries)})

    def tokens(batches):
        lengths = lengths_of(tokenizer_file)
        lengths.load(table.value)
        for batch in batches:
            counts = [lengths.count(x) if x else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "over_limit"])

    rows = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).alias(free_name([*keep, "n_bytes"])))
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(tokens, schema)
