"""Chunkers, index, search, layout, sources and streaming."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.operators import chunking, evaluation, layout, profile, retrieval, rule_index, vector
from millrace.plans import queries
from millrace.sources import tables
from millrace.streaming import ingest


def plain_fold(text, cap, tail, overlap=2):
    """The size-only fold, written the long way."""
    own, out, page = [], [], 1
    for line in text.split("\n"):
        if line.startswith("--- PAGE "):
            page = int(line.split()[2])
            continue
        if line.strip():
            own.append(line.strip())
        if len(" ".join(own)) > cap:
            out.append(("\n".join(own), page))
            own = own[-overlap:]
    if own and len(" ".join(own)) >= tail:
        out.append(("\n".join(own), page))
    return out


def test_size_only_folds_agree(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["", "  ", "--- PAGE %d ---" % r.randint(2, 9), "é" * r.randint(1, 90), "word " * r.randint(1, 12), "\tx"]) for _ in range(r.randint(0, 60))) for _ in range(80)] + ["", "x" * 49, "x" * 50, "x" * 2001]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.sized_chunks(F.col("t"), 300, 50).alias("c")).collect()
    for row in got:
        assert [tuple(c) for c in row.c] == plain_fold(texts[row.i], 300, 50)
    plain = chunking.Chunker("X", 300, 50)
    for t in texts:
        assert [(c[0], c[5]) for c in chunking.fold(plain, t)] == plain_fold(t, 300, 50)


RULES = "\n".join(["--- PAGE 1 ---", "5. MOVES AND FIRE", "5.1 " + "a" * 90, "short", "--- PAGE 2 ---", "5.2 tiny", "5.3 " + "b" * 90, "Q. " + "c" * 30, "5.4 end of it all, with some more words"])


def test_rules_split_at_numbers_and_short_ones_merge_forward():
    got = chunking.fold(chunking.core_rules(), RULES)
    assert [(c[3], c[5]) for c in got] == [("5.1", 2), ("5.3", 2)]
    assert got[0][0].startswith("5. MOVES AND FIRE\n5.1 a") and got[0][1] == "5. MOVES AND FIRE"
    assert got[1][0].startswith("5.2 tiny\n5.3 b")


def test_errata_and_scenarios():
    got = chunking.fold(chunking.errata(), "intro\n*3.1 first\nmore\n3.2 second")
    assert [(c[0], c[1], c[3]) for c in got] == [("intro\n*3.1 first\nmore", "Errata for Rule 3.1", "3.1"), ("3.2 second", "Errata for Rule 3.2", "3.2")]
    assert chunking.fold(chunking.errata(), "only words")[0][1] == "Errata"
    got = chunking.fold(chunking.scenarios(), "intro\nA: FIRST\nx\nB. SECOND\ny")
    assert [(c[1], c[4]) for c in got] == [("Scenario A", "A"), ("Scenario B: SECOND", "B")]


def test_caps_split_at_natural_points_and_overlap():
    lines = [f"line {k} " + "w" * 80 for k in range(60)]
    lines[20] = "•....... " + "s" * 80
    got = chunking.fold(chunking.integrated_rules(), "\n".join(lines))
    assert got[0][0].split("\n")[-1] == lines[19] and got[1][0].split("\n")[0] == lines[18]
    forced = chunking.fold(chunking.core_rules(), "\n".join(lines))
    assert forced[1][0].split("\n")[:2] == forced[0][0].split("\n")[-2:]
    endless = chunking.fold(chunking.keyword_headers("codex"), "\n".join(x for x in lines if "•" not in x))
    assert len(endless) == 1


def test_keyword_headers_and_formats():
    got = chunking.fold(chunking.keyword_headers("codex"), "H U L L  D O W N\n" + "a" * 60 + "\nNext Part\n" + "b" * 60)
    assert [c[3] for c in got] == ["HULL DOWN", "Next Part"] and got[0][0] == "HULL DOWN " + "a" * 60
    assert [c[4] for c in chunking.fold(chunking.scenarios_by_format("letter"), "A. Alpha\n" + "x" * 60 + "\nB. Beta\n" + "y" * 60)] == ["A", "B"]
    assert [c[4] for c in chunking.fold(chunking.scenarios_by_format("numeric"), "Scenario T12\n" + "x" * 60)] == ["T12"]
    assert chunking.chunker_for("qa", {}).cap == 2000 and chunking.chunker_for("codex", {"rule_schema": "keyword_header"}).join == " "


@pytest.fixture(scope="module")
def chunks(spark):
    docs = [("f1.txt", RULES, "core_rules", 2), ("f2.txt", "5.1 other [5.3] and see 5.1\n" + "z" * 80 + "\nScenario C", "integrated_rules", 1), ("f3.txt", None, "qa", 6)]
    return chunking.built(chunking.folded(spark.createDataFrame(docs, "source_file string, text string, doc_type string, priority int"))).cache()


def test_built_chunks(chunks):
    rows = {(r.source_file, r.seq): r for r in chunks.collect()}
    assert len(rows) == 3
    r = rows["f2.txt", 0]
    assert r.text.startswith("[Doc: integrated_rules] [Section: Introduction] [Rule: 5.1] [Scenario: C]\n5.1 other")
    assert (r.rule_number, r.cross_refs, r.all_rule_numbers, r.scenario, r.subsection) == ("5.1", ["5.3"], ["5.1"], "C", "5.1")


def test_index_lookup_chase_and_conflicts(spark, chunks):
    index = rule_index.rule_index(chunks)
    rows = index.filter("rule = '5.1'").orderBy("rank").collect()
    assert [(r.doc_type, r.secondary) for r in rows] == [("integrated_rules", False), ("core_rules", False)]
    assert [e.rank for e in rule_index.nested(index).filter("rule = '5.1'").first().entries] == [1, 2]
    wanted = spark.createDataFrame([("5.1", 0), ("9.9", 1)], "rule string, ord int")
    assert rule_index.lookup(index, wanted, each=1).count() == 1
    docs = chunks.filter("source_file = 'f2.txt'").withColumn("pos", F.lit(1))
    assert [r.ref for r in rule_index.chase(docs, index, fixed.CHASED_REFERENCE, fixed.RULE_TAG).collect()] == ["5.3"]
    found = rule_index.conflicts(chunks.withColumn("pos", F.col("seq"))).collect()
    assert [(r.rule_number, r.doc_type, r.others) for r in found] == [("5.1", "integrated_rules", "core_rules")]


def test_answers(chunks):
    from millrace.functions import providers

    own = providers.embedded(chunks)
    embed = lambda q: providers.HashingEmbedder()([q])[0].tolist()
    for preset in ("rules", "profile"):
        got = retrieval.answer_context(own, rule_index.rule_index(chunks), "Rule 5.1?", embed, providers.classified("Rule 5.1?"), preset=preset)
        assert got["documents"].count() == 3 and "5.1" in got["context"].first().context
    assert retrieval.branches("scenario", [], None) == [("search", 8, None)]


def test_search(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)], "src" + str(i % 3)) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>, source string")
    every = [r.vec_id for r in vector.top_k(v, [1.0, 1.0, 1.0], 30).collect()]
    assert [r.vec_id for r in vector.top_k(v, [1.0, 1.0, 1.0], 7).collect()] == every[:7]
    assert {r.source for r in vector.top_k(v, [1.0, 1.0, 1.0], 5, where=vector.predicate(source=["src1"])).collect()} == {"src1"}
    assert [r.vec_id for r in vector.top_k(v, [0.0, 1.0, 0.0], 1, metric="l2").collect()] == [0]
    assert vector.predicate(a=None, b=[]) is None and [vector.oversampled(n) for n in (4, 5, 6, 8, 10)] == [10, 12, 15, 20, 25]
    centres = vector.cell_centres(v, 4)
    assert set(r.vec_id for r in vector.approximate_top_k(vector.cell_index(v, centres), centres, [1.0, 1.0, 1.0], 3, probes=2).collect()) <= set(range(30))


def test_neighbours_pages_and_budget(spark):
    rows = [(f"c_chunk_{k}", "C", "f.pdf", k, k, f"[Carrier: C] text {k} see page 4") for k in (1, 2, 4)] + [("odd", "C", "f.pdf", 9, 9, "plain")]
    c = spark.createDataFrame(rows, "chunk_id string, carrier string, source string, page int, seq int, text string")
    wide = {r.chunk_id: r.expanded for r in retrieval.neighbours(c, c).collect()}
    assert wide["c_chunk_2"] == "text 1 see page 4\n[Carrier: C] text 2 see page 4" and wide["odd"] == "plain"
    hits = retrieval.neighbours(c.filter("page = 2"), c)
    found = retrieval.referenced_pages(hits, c).collect()
    assert len(found) == 1 and found[0].text.startswith("=== CROSS-REFERENCE: C Page 4 (from f.pdf) ===\n[Carrier: C] text 4")
    items = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "pos int, size int")
    assert retrieval.within_budget(items, 10).count() == 2
    assert [retrieval.result_count(n) for n in (0, 1, 3, 5)] == [5, 4, 6, 6]


def test_profiles(spark):
    pages = spark.createDataFrame([("Rules_2nd_Edition.pdf", k, f"{k}.1 a rule of some length, see {k}.2\nLine Of Sight (LOS) and so on and on") for k in (1, 2, 3)], "source_file string, page int, text string")
    got = profile.discovered(pages, "Game", spark.createDataFrame([("Rules_2nd_Edition.pdf", 120.0)], "source_file string, size_mb double"))
    assert (got["rule_schema"], got["catalog"].first().doc_type, got["catalog"].first().max_pages) == ("numeric_decimal", "core_rules", 200)
    assert got["glossary_candidates"].first().candidate == "LOS: Line Of Sight"
    catalog = spark.createDataFrame([("a", "x", 1, "d"), ("b", "x", 1, "d")], "source_file string, doc_type string, priority int, description string")
    over = spark.createDataFrame([("b", "y", 4, None), ("c", "z", 1, "d")], catalog.schema)
    assert sorted(map(tuple, profile.patched(catalog, over).collect())) == [("a", "x", 1, "d"), ("b", "y", 4, "d")]
    assert spark.range(1).select(profile.carrier(F.lit("pds.pdf")).alias("a"), profile.carrier(F.lit("new-one.pdf")).alias("b")).first()[:] == ("CGU_ANZ", "NEW-ONE")


def test_layout(spark):
    rows = [("d", 1, "Type:", 10, 50, 40, 60), ("d", 2, "Falcon", 60, 52, 90, 58), ("d", 3, "Eagle", 120, 52, 150, 58), ("d", 4, "Maximum", 400, 100, 430, 110), ("d", 5, "7", 540, 170, 550, 180), ("d", 6, "12", 90, 20, 100, 30), ("d", 7, "Gun", 20, 230, 60, 240), ("d", 8, "LW", 110, 230, 125, 240), ("d", 9, "20", 140, 230, 150, 240), ("d", 10, "SMLM Missile", 20, 100, 50, 110), ("d", 11, "Engine", 62, 130, 80, 140)]
    s = spark.createDataFrame([(a, b, c, *map(float, xy)) for a, b, c, *xy in rows], "doc string, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    assert layout.names(s).first().name == "Falcon" and layout.thrust(s).first().max_thrust == 7
    assert {r.facing: r.sf for r in layout.armour(s).collect()}["Turret Armor"] == 12
    assert tuple(layout.weapons(s).first()) == ("d", 235, 1, "Gun", "LW", "20", "N/A")
    assert ("d", "SMLM", 1) in [tuple(r) for r in layout.missiles(s).collect()]
    grid = {r.column: r.cells for r in layout.grid(s, 60, 130, 10).collect()}
    assert len(grid) == 10 and grid[0][0] == grid[2][0] == "Engine" and grid[9] == ["Empty"] * 10


def test_layout_chunks(spark):
    rows = [("d", "C", k, 1 + k // 3, t, z, 10.0) for k, (t, z) in enumerate([("Cover", 14.0), ("a" * 200, 10.0), ("tiny", 5.0), ("Sub", 12.0), ("b" * 160, 10.0), ("PART two", 10.0), ("c", 10.0)])]
    got = chunking.layout_chunks(spark.createDataFrame(rows, "doc string, carrier string, seq int, page int, text string, size double, body_size double")).orderBy("n").collect()
    assert [(r.section, r.subsection, r.page, len(r.text.split("] ")[-1])) for r in got] == [("Cover", "", 1, 200), ("Cover", "Sub", 2, 160), ("PART two", "", 2, 1)]
    spans = spark.createDataFrame([("d", 1, "long text", 9.98), ("d", 1, "x", 20.0), ("e", 20, "late", 8.0)], "doc string, page int, text string, size double")
    assert {r.doc: r.body_size for r in chunking.body_size(spans).collect()} == {"d": 10.0, "e": 10.0}


def test_sources(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("--- PAGE 1 ---\nfirst\n--- PAGE 2 [OCR] ---\nsecond")
    (tmp_path / "c.txt").write_text("no marker")
    (tmp_path / "d.txt").write_text("twice")
    (tmp_path / "d.txt.duplicate").write_text("")
    docs = tables.page_marked_texts(spark, f"file://{tmp_path}")
    assert sorted(r.source_file for r in docs.collect()) == ["a b.txt", "c.txt"]
    assert sorted(map(tuple, tables.pages(docs).collect())) == [("a b.txt", 1, "first"), ("a b.txt", 2, "second"), ("c.txt", 1, "no marker")]
    catalog = spark.createDataFrame([("c.pdf", 0), ("a b.pdf", None)], "source_file string, max_pages int")
    assert [r.source_file for r in tables.page_marked_texts(spark, f"file://{tmp_path}", catalog).collect()] == ["a b.pdf"]
    made = tables.made_up_listings(spark, 50)
    assert made.exceptAll(tables.made_up_listings(spark, 50).repartition(3)).count() == 0
    made.coalesce(1).write.csv(f"file://{tmp_path}/csv", header=True)
    assert tables.listings(spark, f"file://{tmp_path}/csv", 20).agg(F.max("id")).first()[0] == 20
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "x.json").write_text('{"name": "N", "entity_type": "t"}')
    (tmp_path / "json" / "y.json").write_text('{"entity_type": "t"}')
    (tmp_path / "json" / "z.json").write_text("{ not json")
    assert [r.entity_id for r in tables.entities(spark, f"file://{tmp_path}/json").collect()] == ["entity_x"]
    assert tables.json_or_empty(spark, f"file://{tmp_path}/none.json", "a int").count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (3, "f", 2)], old.schema)
    assert sorted(map(tuple, tables.upserted(old, new, "k", "o").select("k", "v").collect())) == [(1, "a"), (2, "d"), (3, "f")]
    assert sorted(map(tuple, tables.inserted(old, new, "k", "o").select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "e")]


def test_pages_by_kind(spark):
    rows = spark.createDataFrame([("f", "x" * 60, None), ("f", "short", "scan"), ("f", None, None)], "source_file string, native string, scanned string")
    found = rows.select("source_file", tables.page_text(F.col("native"), F.col("scanned")).alias("p"))
    assert tuple(tables.page_statistics(found).first()) == ("f", 1, 1, 1, 64)
    seen = spark.createDataFrame([("a", 1, "x" * 101, False), ("b", 1, "x", True), ("c", 1, "", False)], "source_file string, page int, text string, has_image boolean")
    assert {r.source_file: r.kind for r in tables.triage(seen).collect()} == {"a": "TEXT", "b": "SCANNED/IMAGE", "c": "EMPTY"}


def test_evaluation(spark):
    rows = spark.createDataFrame([("s", "EXACT"), ("s", "FAIL"), ("t", "CITED")], "system string, grade string")
    got = {r.system: (r.total, r.pass_rate, r.gate) for r in evaluation.grades(rows).collect()}
    assert got == {"s": (2, 50.0, False), "t": (1, 100.0, True), "OVERALL": (3, 66.6667, False)}
    kw = spark.createDataFrame([(["a"], ["b", "c"]), ([], [])], "keywords_found array<string>, keywords_missing array<string>")
    assert tuple(evaluation.keyword_recall(kw).first()) == (1, 3, 0.333333)


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x" * 60)
    run = lambda: ingest.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("y" * 70)
    run()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.source_file for r in got) == ["a.txt", "b.txt"]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_queries_in_waves(spark, most):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    near = lambda q: sorted((round(sum((x - y) ** 2 for x, y in zip(v, q)), 6), i) for i, v in rows)[:3]
    want = {(i, j, n + 1) for i, q in rows if i % 4 == 0 for n, (_, j) in enumerate(near(q))}
    got = [(x.query_id, x.vec_id, x["rank"]) for x in vector.multi_top_k(vectors, queries, 3, metric="l2", most=most).collect()]
    assert len(got) == len(want) and set(got) == want


def test_lines_of_all_documents(spark, tmp_path):
    rows = [(i, f"first {i}\n\nlast") for i in (0, 499, 500, 10**12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["line_explode"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, n, line) for i, t in rows for n, line in enumerate(t.split("\n")))


def test_keywords_of_all_items(spark, tmp_path):
    rows = [(1, "The élan, of Straße; an_x 12 3456!"), (2, "Plain words"), (3, "où être\u00a0là-bas"), (4, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda t: " ".join(w for w in re.split(r"\s+", re.sub(r"[^\w\s]", "", t.lower())) if len(w) > 2 and w not in fixed.STOP_WORDS_RULES)
    got = sorted(map(tuple, queries.QUERIES["keyword_extract"](spark, str(tmp_path)).collect()))
    assert got == [(i, kept(t)) for i, t in rows]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_approximate_search(spark, sf):
    """The index of cells against the exact search, over every hundredth row."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    centres = vector.cell_centres(rows)
    indexed = vector.cell_index(rows, centres)
    every = indexed.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in every], float)
    near = vector.nearest_cells(x, centres, 40)
    cells, found, total = np.array([r.cell for r in every]), 0, 0
    for i in range(0, len(x), 100):
        exact = np.argsort(-(vector.unit(x) @ vector.unit(x)[i]), kind="stable")[:10]
        found, total = found + np.isin(cells[exact], near[i]).sum(), total + 10
    assert found / total >= 0.9, found / total
    got = [r.vec_id for r in vector.approximate_top_k(indexed, centres, x[0].tolist(), 10).collect()]
    want = [r.vec_id for r in vector.top_k(rows, x[0].tolist(), 10).collect()]
    assert len(set(got) & set(want)) >= 8 and got[0] == want[0]


def test_folded_holds_a_few_documents_at_once(spark):
    """The chunks of a large batch come out in small ones, all of them in order."""
    import pyarrow as pa

    from millrace.operators import chunking

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            n = 3 * chunking.FOLDED_ROWS + 1
            texts = [None if k == 5 else f"1.{k} " + "some words to read\n" * (k % 7) + "and an end of fifty characters or so, to be a chunk" for k in range(n)]
            return list(run([pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(n)]), pa.array(texts), pa.array(["unknown"] * n), pa.array([1] * n, pa.int32())], names=["source_file", "text", "doc_type", "priority"])]))

    found = chunking.folded(Rows())
    assert len(found) == 4 and all(len(set(b.column(0).to_pylist())) <= chunking.FOLDED_ROWS for b in found)
    assert [x for b in found for x in b.column(0).to_pylist()] == [str(k) for k in range(3 * chunking.FOLDED_ROWS + 1) if k != 5]


def test_duplicate_check_is_dealt_out_and_compares_once(spark):
    from millrace.plans import queries

    plan = queries.QUERIES["duplicate_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("alike(") == 1 and "RepartitionByExpression" in plan
