"""Near-duplicates by MinHash: many universal hash minima, banding, verification, connected components.

1. Each document's set of word shingles is hashed, and ROWS * BANDS minima make its band keys. Documents of equal sets
   form a class; from here on its smallest id stands for it.
2. Classes that share a band key are a bucket's members. Each is verified against the bucket's leader, the member that
   shares most keys with others, on the full sets. Links give components by alternating large-star and small-star.
3. Most buckets now lie in one component. In the others, all pairs from different components are verified as well:
   members are dealt to chunks, pairs of chunks are compared in one task each by the product of their membership
   matrices, and a task returns no more links than join what it holds. So a bucket of any size is compared whole, and no
   pair of a group is ever a row.

A pair of similarity 0.85 shares no bucket with a chance of (1 - 0.85^6)^40 = 6e-9.

Defined cases: null texts and texts without words have the empty set and are linked with nothing; texts of fewer words
than a shingle are one shingle; repeated rows are copies; rows of equal id share one component; other columns are not
read; an empty table gives an empty result; long texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to_groups, mix, saved, text_bytes
from .components import connected_components
from .substring_dedup import window_hashes, word_bounds, word_hashes

ROWS, BANDS = 6, 40
#: Members of a chunk of a bucket, and cells of a membership matrix made at once.
CHUNK, CELLS = 256, 1 << 22

#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each text, sorted, one text after another; and the n + 1 offsets."""
    body, offsets = text_bytes(column)
    body = LOWER[body]
    starts, ends = word_bounds(body, offsets)
    words = word_hashes(body, starts, ends)
    first = np.searchsorted(starts, offsets)
    windows = window_hashes(words, width)
    sizes = np.diff(first)
    sets = []
    for at, n in zip(first[:-1].tolist(), sizes.tolist()):
        if n >= width:
            sets.append(np.unique(windows[at : at + n - width + 1]))
        else:
            sets.append(window_hashes(words[at : at + n], n) if n else np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def band_keys(values: np.ndarray, offsets: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """texts x bands; the texts have no empty sets."""
    factors = mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    lo = 0
    while lo < len(offsets) - 1:  # as much at once as the processor's cache holds
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 15), "right")) - 1)
        own, starts = values[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
        for k, f in enumerate(factors):
            least = np.minimum.reduceat(own * f, starts)
            out[lo:hi, k // rows] = mix(out[lo:hi, k // rows] * np.uint64(0xD1342543DE82EF95) + least)
        lo = hi
    return out


def sketches(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n, two sums that tell sets apart, and the band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                values, offsets = shingle_sets(batch.column(1), width)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                sums, keys = np.zeros((2, len(n)), np.uint64), [None] * len(n)
                if len(full):
                    at = offsets[:-1][full]
                    sums[0, full] = np.add.reduceat(mix(values), at)
                    sums[1, full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for i, k in zip(full, band_keys(values, np.append(at, len(values)), rows, bands).view(np.int64)):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(s.view(np.int64)) for s in sums), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {kind}, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id and the whole set, as bytes, of the documents whose id is in wanted (id); one row for each id."""
    def sets(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                values, offsets = shingle_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "members"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    return own.mapInArrow(sets, f"id {kind}, members binary")


def is_link(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                keep.append(bool(is_link(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    kind = pairs.schema["u"].dataType.simpleString()
    return both.mapInArrow(check, f"u {kind}, v {kind}")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b, by matrix products over slices of the values."""
    out = np.zeros((len(a), len(b)))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    values = np.intersect1d(flat_a, flat_b)
    use_a, use_b = np.isin(flat_a, values), np.isin(flat_b, values)
    at_a, at_b = np.searchsorted(values, flat_a[use_a]), np.searchsorted(values, flat_b[use_b])
    row_a, row_b = row_a[use_a], row_b[use_b]
    step = max(1, CELLS // max(1, len(a) + len(b)))
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, row_a, at_b, row_b = at_a[order_a], row_a[order_a], at_b[order_b], row_b[order_b]
    for lo in range(0, len(values), step):
        width = min(step, len(values) - lo)
        parts = []
        for at, row, n in ((at_a, row_a, len(a)), (at_b, row_b, len(b))):
            i, j = np.searchsorted(at, (lo, lo + width))
            m = np.zeros((n, width), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def joining_links(table: pa.Table, percent: int) -> list[tuple]:
    """Links that join different components in a pair of chunks, of one bucket: side 0 or 1, id, part, members."""
    rows: dict[int, list] = {0: [], 1: []}
    for side, i, part, members in zip(*(table.column(c) for c in ("side", "id", "part", "members"))):
        rows[side.as_py()].append((i.as_py(), part.as_py(), np.frombuffer(members.as_buffer(), np.uint64)))
    a, b = rows[0], rows[1] or rows[0]
    if not a:
        return []
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, step = [], 64
    for lo in range(0, len(a), step):
        for to in range(0, len(b), step):
            x, y = a[lo : lo + step], b[to : to + step]
            common = common_counts([r[2] for r in x], [r[2] for r in y])
            n, m = np.array([len(r[2]) for r in x]), np.array([len(r[2]) for r in y])
            for i, j in zip(*np.nonzero(is_link(common, n[:, None], m[None, :], percent))):
                if (p := find(x[i][1])) != (q := find(y[j][1])):
                    root[p] = q
                    links.append((x[i][0], y[j][0]))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach, its own included) of each row of docs.
    Linked are documents whose sets' intersection is at least percent / 100 of their union. Rows of one id share
    a component, that of the links of all their texts."""
    made = saved(sketches(docs, width, rows, bands))
    sums = F.struct("n", "s1", "s2")
    varied = ~F.max(sums).eqNullSafe(F.min(sums))
    if made.groupBy("doc_id").agg(varied.alias("varied")).agg(F.bool_or("varied")).first()[0]:
        return _by_row(docs, width, percent, rows, bands)
    classes = saved(made.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")).filter("size > 1"))
    slim = made.select("doc_id", "n", "s1", "s2")
    member = saved(joined_to_groups(slim, classes, ["s1", "s2", "n"], "size", F.col("doc_id"), made.count()).select("doc_id", "n", F.coalesce("id", "doc_id").alias("id")))
    heads = made.filter("n > 0").join(member.filter("doc_id = id").select("id"), made["doc_id"] == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    keys = heads.select(F.col("doc_id").alias("id"), "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = saved(keys.join(shared, ["band", "key"]))

    fame = buckets.groupBy("id").agg(F.sum("size").alias("fame"))
    ranked = buckets.join(fame, "id")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("fame", "id", "n")).alias("l")).select("band", "key", F.col("l.id").alias("u"), F.col("l.n").alias("m"))
    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pairs = buckets.join(leaders, ["band", "key"]).filter((F.col("u") != F.col("id")) & near).select("u", F.col("id").alias("v")).distinct()
    sets = saved(full_sets(docs, fame.select("id"), width).dropDuplicates(["id"]))
    links = saved(verified(pairs, sets, percent))
    parts = connected_components(links)

    placed = buckets.join(parts.select(F.col("u").alias("id"), F.col("v").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    split = placed.groupBy("band", "key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("n").alias("least")).filter("p <> q").select("band", "key")
    open_ = saved(placed.join(split, ["band", "key"]))
    if open_.isEmpty():
        found = parts
    else:
        more = saved(compared(open_, sets, percent))
        found = parts if more.isEmpty() else connected_components(parts.select("u", "v").unionByName(more))
    joined = member.join(found.select(F.col("u").alias("id"), F.col("v").alias("least")), "id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _by_row(docs: DataFrame, width: int, percent: int, rows: int, bands: int) -> DataFrame:
    """near_duplicates of documents of which some share an id but not the text: rows are numbered and linked by number, then
    components that an id has rows in are linked, and each is named by the smallest id of its rows."""
    numbered = saved(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    found = saved(near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), width, percent, rows, bands))
    named = saved(found.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row").select("doc_id", "n_shingles", F.col("component_id").alias("part")))
    of_id = named.filter("doc_id is not null").select("doc_id", "part").distinct()
    links = of_id.join(of_id.groupBy("doc_id").agg(F.min("part").alias("u")), "doc_id").filter("u <> part").select("u", F.col("part").alias("v")).distinct()
    joined = connected_components(saved(links)).select(F.col("u").alias("part"), F.col("v").alias("whole"))
    merged = saved(named.join(joined, "part", "left").withColumn("whole", F.coalesce("whole", "part")))
    least = merged.groupBy("whole").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    out = joined_to_groups(merged.drop("part"), least, ["whole"], "size", F.monotonically_increasing_id(), merged.count())
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def compared(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different parts of the same bucket: open_ has band, key, size, id, n and part."""
    kind = open_.schema["id"].dataType.simpleString()
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = open_.withColumn("chunks", chunks).withColumn("own", own).join(sets, "id")
    # chunk i of a bucket meets chunks i, i + 1, ... of it: once as side 0, and as side 1 of the earlier ones
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    each = each.select("band", "key", low.alias("low"), high.alias("high"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "part", "members")

    def links(key, table):
        found = joining_links(table, percent)
        return pa.Table.from_arrays([pa.array([x for x, _ in found], table.schema.field("id").type), pa.array([y for _, y in found], table.schema.field("id").type)], names=["u", "v"])

    return each.groupBy("band", "key", "low", "high").applyInArrow(links, f"u {kind}, v {kind}").distinct()
