"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every window of an item's words must be found whole, so one word of it is a necessary prefix: the one that is rarest in
all documents. A first pass counts the items' words in the documents; a second one joins document words with the
windows' prefix words, keeps those whose window would lie within the document (position and length bounds), and verifies
the window word for word, all in the task that reads the document.

The windows are broadcast if they and their items' ids have at most BROADCAST_BYTES; else the same joins shuffle, and a
document's word travels with the words around it that a window may cover, never with the whole document.

Defined cases: null and empty texts have no words and no hits; items without words have no windows; repeated rows of
docs give one result row each, repeated items count once by id; other columns are not read; with no items nothing is
hit; an empty table gives an empty result; long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Characters of all windows and of the ids of their items up to which they are broadcast.
BROADCAST_BYTES = 64 << 20

#: A-Z become a-z; words are what stands between runs of ASCII that is neither a-z nor a digit.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The text's words; none if it is null. Splitting takes a tenth of the time that extracting each word takes."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, GAP), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int, key: str = "item_id") -> DataFrame:
    """Distinct windows: their words, and the ids, as sorted strings, of the items that have them."""
    w = items.select(F.col(key).cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Each row of docs (doc_id, text) with n_words, n_hit, n_items, items and contaminated."""
    found = windows(items, width)
    size = found.agg(F.sum(F.char_length(F.array_join("window", " ")) + F.char_length(F.array_join("items", ",")))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    sent = F.broadcast if small else (lambda df: df)
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))

    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    seen = own.select(F.explode("w").alias("word")).join(sent(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = vocabulary.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    by_word = found.select("window", "items", F.posexplode("window").alias("at", "word")).join(counts, "word")
    prefix = by_word.groupBy("window", "items").agg(F.min(F.struct("n", "word", "at")).alias("p"))
    if not small:
        # rows are numbered once, for two joins meet at that number
        rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
        own = rows.select("row", "doc_id", words(F.col("text")).alias("w"))
        return _shuffled(own, prefix.select("window", "items", F.col("p.word").alias("word"), F.col("p.at").alias("at")), width)
    # the empty word is no word: it stands at each document's end, so that every document has a row
    mark = docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"), F.lit("").alias("word"), F.lit(0).alias("at"))
    probes = prefix.select("window", "items", F.col("p.word").alias("word"), F.col("p.at").alias("at")).unionByName(mark)

    tokens = own.select("row", "doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    bounds = (start >= 0) & (start + length <= F.size("w"))
    hits = tokens.join(sent(probes), (tokens["word"] == probes["word"]) & bounds & (F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")))
    hits = hits.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.when(length > 0, F.struct(start.alias("s"), (start + length).alias("e"))).alias("span"), "items")
    return _covered(hits.groupBy("row", "doc_id", "n_words").agg(*_found()))


def _found() -> list[Column]:
    return [F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]


def _shuffled(own: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """As the broadcast join of contamination, by joins that shuffle: words alone, of which the probes' are kept; these go back
    to their documents, and each goes on with the words around it."""
    bare = own.select("row", F.posexplode("w").alias("pos", "word")).join(probes.select("word").distinct(), "word", "left_semi")
    places = bare.groupBy("row").agg(F.collect_list(F.struct("pos", "word")).alias("places"))  # no more than a document's words
    tokens = own.join(places, "row").select("row", F.size("w").alias("size"), "w", F.explode("places").alias("p")).select("row", "size", "w", "p.*")
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    tokens = tokens.select("row", "size", "pos", "word", first.alias("first"), F.slice("w", first + 1, 2 * width - 1).alias("around"))
    start, length = F.col("pos") - F.col("at"), F.size("window")
    bounds = (start >= 0) & (start + length <= F.col("size"))
    whole = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, length) == F.col("window")
    hits = tokens.join(probes, (tokens["word"] == probes["word"]) & bounds & whole).select("row", F.struct(start.alias("s"), (start + length).alias("e")).alias("span"), "items")
    rows = own.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words")).join(hits.groupBy("row").agg(*_found()), "row", "left")
    none = F.array().cast("array<struct<s:int,e:int>>"), F.array().cast("array<string>")
    return _covered(rows.withColumns({"spans": F.coalesce("spans", none[0]), "items": F.coalesce("items", none[1])}))


def _covered(each: DataFrame) -> DataFrame:
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("hit"), F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["hit"])
    return each.select("doc_id", "n_words", covered.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """contamination's rows with a hash in place of the item ids."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
