"""Tables merged on reading, the stored index, scans that are read once, and patterns for both engines."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import rule_index
from millrace.sources import merged, rule_table, scans
from millrace.streaming import scan


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_merged_table_against_a_dictionary(spark, tmp_path):
    held, r, want, schema = merged.Merged(spark, f"file://{tmp_path}/t"), random.Random(1), {}, "k string, v int, o int"
    with pytest.raises(merged.Missing):
        held.get()
    rows = [(f"k{i}", i, 0) for i in range(40)] + [(None, -1, 0)]
    held.create(spark.createDataFrame(rows, schema), "k", buckets=4)
    want |= {k: v for k, v, _ in rows}
    for step in range(6):
        batch = [(r.choice([f"k{r.randrange(60)}", None]), r.randrange(1000), o) for o in range(7)]
        how = ["upsert", "insert", "delete", "upsert", "insert", "compact"][step]
        table = spark.createDataFrame(batch, schema)
        if how == "upsert":
            held.upsert(table, "o")
            want |= {k: v for k, v, _ in batch}
        elif how == "insert":
            held.insert(table, "o")
            for k, v, _ in batch:
                want.setdefault(k, v)
        elif how == "delete":
            held.delete(table)
            want = {k: v for k, v in want.items() if k not in {b[0] for b in batch}}
        else:
            assert held.compact() and held.compact() == []
        assert {x.k: x.v for x in held.get().collect()} == want and held.get().count() == len(want)
    ids = spark.createDataFrame([("k1",), ("k59",), (None,)], "k string")
    assert {x.k: x.v for x in held.by_ids(ids).collect()} == {k: want[k] for k in ("k1", "k59", None) if k in want}


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    held = merged.Merged(spark, f"file://{tmp_path}/t")
    held.create(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("o")), "id", buckets=8)
    whole = size(tmp_path)
    held.upsert(spark.createDataFrame([(5, "x", 1), (5, "y", 2)], "id long, v string, o int"), "o")
    held.insert(spark.createDataFrame([(6, "no", 1), (-7, "new", 1)], "id long, v string, o int"), "o")
    held.delete(spark.createDataFrame([(8,)], "id long"))
    assert size(tmp_path) - whole < whole / 500
    assert {x.id: x.v for x in held.get().filter("id < 9 and id > 4 or id < 0").collect()} | {6: 0, 7: 0} == {5: "y", 6: 0, 7: 0, -7: "new"}
    one = held.by_ids(spark.createDataFrame([(5,)], "id long"))
    assert len({f.split("__bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1 and one.first().v == "y"
    before = held.get().count()
    reader = held.get()
    touched = held.compact()
    assert 0 < len(touched) <= 4 and held.get().count() == before == reader.count() == 200_000
    assert len({f.split("__bucket=")[1] for f in held.get().inputFiles()}) >= 8


def test_two_writers(spark, tmp_path):
    held = merged.Merged(spark, f"file://{tmp_path}/t")
    held.create(spark.createDataFrame([(1, 0)], "k int, o int"), "k")
    old = held._manifest()
    held.upsert(spark.createDataFrame([(2, 0)], "k int, o int"), "o")
    with pytest.raises(merged.Conflict):
        held._commit(old | {"n": old["n"] + 1})
    assert held.get().count() == 2


def chunks_of(spark, n=4000):
    r = random.Random(3)
    rows = [(f"c{i:05}", "1.1" if i % 2 else r.choice([None, "2.5", "9.9", "3.14"]), r.choice([None, [], ["1.1", "4.2"], ["2.5", "2.5", "8.1"]]), r.choice(["errata", "qa"]), r.choice([1, 2, 3, None]), "f", "rule", r.choice([None, i])) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, rule_number string, all_rule_numbers array<string>, doc_type string, priority int, source_file string, content_type string, seq long").repartition(5)


def test_hot_rule_is_ranked_in_pieces(spark):
    chunks = chunks_of(spark)
    found = rule_table.ranked(chunks, 12)
    per_piece = {x.piece: x.n for x in found.groupBy("piece").agg(F.count("*").alias("n")).collect()}
    assert len(per_piece) >= 8 and max(per_piece.values()) <= 4 * sum(per_piece.values()) / 12
    assert found.filter("rule = '1.1'").select("piece").distinct().count() >= 4
    columns = ["rule", "chunk_id", "secondary", "rank"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, rule_index.rule_index(chunks).select(columns).collect()))


def test_lookup_reads_few_files(spark, tmp_path):
    chunks, path = chunks_of(spark), f"file://{tmp_path}/index"
    rule_table.write(chunks, path, 12)
    found = rule_table.lookup(spark, path, ["1.1", "8.1", "7.7"], 5)
    every = len(spark.read.parquet(f"{path}/pieces").inputFiles())
    assert every == 12 and len(found.inputFiles()) <= 4
    want = rule_index.rule_index(chunks).filter("rule in ('1.1', '8.1') and rank <= 5")
    assert sorted((x.rule, x["rank"], x.chunk_id) for x in found.collect()) == sorted((x.rule, x["rank"], x.chunk_id) for x in want.collect())
    assert rule_table.lookup(spark, path, ["0.0"], 5).collect() == []


def counted(folder):
    """An extractor and a reader that note their calls in a folder."""

    def note(kind):
        with open(os.path.join(folder, f"{kind}-{os.getpid()}-{random.random()}"), "w"):
            pass

    def extract(content):
        note("file")
        for k, p in enumerate(content.split(b"\f")):
            yield scans.Page(p.decode() if p[:1] != b"!" else "", p[:1] == b"!", lambda p=p: (note("picture"), p)[1])

    return extract, lambda picture: picture.decode().strip("!")


def calls(folder):
    found = [f.split("-")[0] for f in os.listdir(folder)]
    for f in os.listdir(folder):
        os.unlink(os.path.join(folder, f))
    return found.count("file"), found.count("picture")


LONG = b"A page with a native text that has more than fifty characters in it, so no picture is made."


def test_pictures_are_made_where_needed_and_files_read_once(spark, tmp_path):
    for name in ("in", "calls"):
        (tmp_path / name).mkdir()
    (tmp_path / "in/a.pdf").write_bytes(LONG + b"\f!scanned words\f" + LONG)
    (tmp_path / "in/b.pdf").write_bytes(b" ")
    extract, read = counted(str(tmp_path / "calls"))
    found = {x.source_file: x for x in scans.read_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", extract, read).collect()}
    assert calls(tmp_path / "calls") == (2, 2)  # the scanned page, and the blank one
    assert set(found) == {"a.pdf", "b.pdf"}
    pages = scans.page_texts(spark.read.format("binaryFile").load(f"file://{tmp_path}/in"), extract, read)
    assert {(x.source_file, x.page): (x.kind, x.has_image) for x in pages.collect()} == {("a.pdf", 1): ("native", False), ("a.pdf", 2): ("ocr", True), ("a.pdf", 3): ("native", False), ("b.pdf", 1): ("empty", False)}
    calls(tmp_path / "calls")
    (tmp_path / "in/c.pdf").write_bytes(LONG)
    scans.read_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", extract, read).collect()
    assert calls(tmp_path / "calls") == (1, 0) and spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_a_killed_stream_goes_on(spark, tmp_path):
    for name in ("in", "calls"):
        (tmp_path / name).mkdir()
    for k in range(4):
        (tmp_path / f"in/{k}.pdf").write_bytes(LONG + b" %d" % (k % 3))
        os.utime(tmp_path / f"in/{k}.pdf", (1000 + k, 1000 + k))
    extract, read = counted(str(tmp_path / "calls"))

    def failing(content):
        if content.endswith(b" 2"):
            raise RuntimeError("killed")
        return extract(content)

    run = lambda e: scan.read_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check", e, read, files_each=1)
    with pytest.raises(Exception, match="killed"):
        run(failing).awaitTermination()
    done, _ = calls(tmp_path / "calls")
    assert done == 2
    run(extract).awaitTermination()
    assert calls(tmp_path / "calls")[0] == 2
    digests = {x.source_file: x.duplicate_of for x in spark.read.parquet(f"file://{tmp_path}/out/digests").collect()}
    assert digests == {"0.pdf": None, "1.pdf": None, "2.pdf": None, "3.pdf": "0.pdf"}
    assert {x.source_file for x in scan.texts(spark, f"file://{tmp_path}/out").collect()} == {"0.pdf", "1.pdf", "2.pdf"}
    assert spark.read.parquet(f"file://{tmp_path}/out/statistics").count() == 4
    run(extract).awaitTermination()
    assert calls(tmp_path / "calls") == (0, 0)


@pytest.mark.parametrize("pattern", [r"(\p{Lu}\d+)", r"((?P<x>\d)", r"(\d+\Z\z)", r"((?P<n>a))"])
def test_patterns_of_one_engine_only(spark, pattern):
    with pytest.raises(ValueError):
        text.checked_patterns(spark, {"rule_pattern": pattern})
    found = text.checked_patterns(spark, {"rule_pattern": r"(\d+\.\d+)", "cross_ref_pattern": pattern})
    assert found["cross_ref_pattern"] == r"(\d+\.\d+)"


def test_product_codes_have_their_recall(spark, tmp_path):
    """Every hundredth row against all rows: recall at 10 of the codes alone and after ranking anew, and the bytes stored."""
    import numpy as np

    from millrace.operators import codes, vector

    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 64)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "vec_id long, embedding array<float>").repartition(4)
    vectors.write.parquet(f"file://{tmp_path}/vectors")
    vectors = spark.read.parquet(f"file://{tmp_path}/vectors")
    book = codes.fit(vectors, parts=32, centres=64)
    codes.encoded(vectors, book).write.parquet(f"file://{tmp_path}/codes")
    stored = spark.read.parquet(f"file://{tmp_path}/codes")
    assert stored.count() == 6000 and size(f"{tmp_path}/codes") <= size(f"{tmp_path}/vectors") / 4
    asked = vectors.filter("vec_id % 100 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(a.query_id, a.vec_id) for a in vector.multi_top_k(vectors, asked, 10).collect()}
    rough = {(a.query_id, a.vec_id) for a in codes.candidates(stored, book, asked, 10).collect()}
    fine = {(a.query_id, a.vec_id) for a in codes.top_k(stored, book, vectors, asked, 10, rerank=100).collect()}
    assert len(want) == 600 and len(rough & want) >= 0.6 * len(want) and len(fine & want) >= 0.9 * len(want)


def test_product_codes_can_be_exact(spark, tmp_path):
    """Groups of near copies with the same codes, and rows and queries without a direction: the search by codes alone loses
    some, the exact one none."""
    import numpy as np

    from millrace.operators import codes, vector

    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(5, 16)), 400, axis=0) + r.normal(size=(2000, 16)) * 0.01
    x = np.concatenate([x * r.uniform(0.5, 2, size=(2000, 1)), r.normal(size=(500, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9100, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()
    book = codes.fit(vectors, parts=4, centres=16)
    codes.encoded(vectors, book).write.parquet(f"file://{tmp_path}/codes")
    stored = spark.read.parquet(f"file://{tmp_path}/codes")
    asked = vectors.filter("vec_id % 100 = 0 and vec_id < 9000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rank = lambda found: {(a.query_id, a.vec_id, a["rank"]) for a in found.collect()}
    want = rank(vector.multi_top_k(vectors, asked, 10))
    assert len(want) == 250 and rank(codes.top_k(stored, book, vectors, asked, 10, rerank=50)) != want
    assert rank(codes.exact_top_k(stored, book, vectors, asked, 10)) == want
    few = spark.createDataFrame(rows[:4] + rows[-1:], "vec_id long, embedding array<float>")
    own = codes.exact_top_k(codes.encoded(few, book), book, few, asked.filter("query_id = 0").union(spark.createDataFrame([(7, [0.0] * 16)], asked.schema)), 10)
    assert own.filter("query_id = 0").count() == 5 and own.filter("query_id = 7").count() == 5


def test_catalog_tables(spark, tmp_path):
    """CREATE IF NOT EXISTS, insert-ignore, and joins by key that leave the table where it is."""
    from millrace.operators import retrieval
    from millrace.sources import catalog

    name = "millrace_test_chunks"
    try:
        for _ in range(2):
            catalog.create(spark, name, "chunk_id string, text string, o int", "chunk_id", 4, f"file://{tmp_path}/t")
        rows = spark.createDataFrame([(f"a_chunk_{i}", f"t{i}", i) for i in range(50)] + [("a_chunk_3", "later", 99), (None, "none", 1)], "chunk_id string, text string, o int")
        assert catalog.insert_ignore(spark, name, rows, "chunk_id", "o").count() == 51
        more = spark.createDataFrame([("a_chunk_3", "again", 0), ("a_chunk_50", "new", 1), (None, "more", 0)], rows.schema)
        table = catalog.insert_ignore(spark, name, more, "chunk_id", "o")
        assert {x.chunk_id: x.text for x in table.collect()} == {f"a_chunk_{i}": f"t{i}" for i in range(50)} | {"a_chunk_50": "new", None: "none"}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = retrieval.neighbours(spark.createDataFrame([("a_chunk_7", "t7")], "chunk_id string, text string"), table.select("chunk_id", "text"))
        assert found.first().expanded == "t6\nt7\nt8"
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans_ = [line for line in plan.splitlines() if "FileScan" in line]
        assert scans_ and plan.count("Exchange hashpartitioning") <= 2 and "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        catalog.drop(spark, name)


def test_pages_of_a_large_file_are_many_tasks_work(spark, tmp_path):
    from millrace.sources import tables

    (tmp_path / "in").mkdir()
    r = random.Random(1)
    body = lambda: "\n".join("x " + " ".join(r.choice(["fire", "--- PAGE", "wäll", ""]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6)))
    big = "".join(f"--- PAGE {k}{r.choice(['', ' [OCR]', ' [EMPTY]'])} ---\n{body()}\n" for k in range(1, 600))
    texts = {"big.txt": big, "before.txt": f"a preamble\n{big[:2000]}", "plain.txt": "no marker here\nat all", "blank.txt": " \n", "one.txt": "--- PAGE 7 ---"}
    for name, value in texts.items():
        (tmp_path / "in" / name).write_text(value)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = tables.pages_of_files(spark, f"file://{tmp_path}/in")
        assert found.rdd.getNumPartitions() >= 6
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = tables.pages(spark.createDataFrame(list(texts.items()), "source_file string, text string"))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 600


def test_spans_of_files(spark, tmp_path):
    import json

    from millrace.sources import spans

    def line(text, size, page=1, block=0, n=0, x0=0.0, y0=0.0):
        return json.dumps({"page": page, "block": block, "line": n, "text": text, "size": size, "x0": x0, "y0": y0, "x1": x0 + 20, "y1": y0 + 8})

    (tmp_path / "in").mkdir()
    body = [line("low ", 10.0, block=0, y0=200.0), line("er", None, block=0, y0=201.0), line("Head", 15.0, block=1, y0=20.0), line("b" * 160, None, block=1, n=1, y0=40.0), line("Next", 15.0, page=2)]
    (tmp_path / "a.pdf").write_text("\n".join(body))
    (tmp_path / "in" / "b.pdf").write_text(line("whole", 10.0) + "\n\n" + "{broken\n" + line("late", 10.0))
    (tmp_path / "c.txt").write_text("not read")
    (tmp_path / "d.pdf").write_text("")
    found = spans.read_folder(spark, f"file://{tmp_path}")
    assert sorted((r.doc, r.seq, r.text) for r in found.collect() if r.error is None) == [("a", 0, "low "), ("a", 1, "er"), ("a", 2, "Head"), ("a", 3, "b" * 160), ("a", 4, "Next"), ("b", 0, "whole")]
    assert [(r.doc, r.seq) for r in found.filter("error is not null").collect()] == [("b", 1)]
    assert [tuple(r) for r in spans.lines(spans.readable(found)).orderBy("seq").select("seq", "page", "text", "size").collect()] == [(1, 1, "Head", 15.0), (2, 1, "b" * 160, None), (3, 1, "low er", 10.0), (4, 2, "Next", 15.0)]
    chunks = spans.section_chunks(found, F.lit(None).cast("string")).collect()
    assert [(r.doc, r.n, r.section, r.page) for r in chunks] == [("a", 1, "Head", 1)]
    assert chunks[0].text == "[Carrier: Unknown] [Section: Head] [Subsection: ] " + "b" * 160 + "\nlow er"
    assert [(r.doc, r.name) for r in spans.sheets(found).collect()] == [("a", "Unknown")]
    empty = spark.createDataFrame([("x.pdf", None)], "path string, content binary")
    assert spans.section_chunks(spans.file_spans(empty), F.lit("c")).count() == 0 and spans.sheets(spans.file_spans(empty)).count() == 0
