"""Tables of questions against one question after another, and the store of replies."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import models
from millrace.operators import questions as asked
from millrace.operators import retrieval, rule_index, vector
from millrace.sources.replies import Replies


def made(spark):
    r = random.Random(7)
    word = lambda: r.choice(["fire", "move", "wall", "river", "tank", "smoke"])
    rows = []
    for i in range(160):
        own = f"{r.randint(1, 4)}.{r.randint(1, 5)}"
        rows.append((f"c{i:03}", f"[Rule: {own}]\n{own} {' '.join(word() for _ in range(4))} see {r.randint(1, 4)}.{r.randint(1, 6)}", [r.gauss(0, 1) for _ in range(6)], own, [f"{r.randint(1, 4)}.{r.randint(1, 5)}", own], r.choice(["errata", "variant", "core_rules"]), r.choice([1, 2, 3, None]), f"f{i % 3}", "rule", r.choice(["A", "B", None]), i % 9, i))
    rows.append(("c900", None, None, None, None, None, None, None, None, None, None, 900))
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<double>, rule_number string, all_rule_numbers array<string>, doc_type string, priority int, source_file string, content_type string, scenario string, page int, seq long")
    kinds = ["direct_rule", "scenario", "comparison", "variant", "situation", "concept", None]
    questions = []
    for i in range(21):
        vec = lambda: [r.gauss(0, 1) for _ in range(6)]
        questions.append((i, f"Which {word()} crosses the {word()} {i}?", vec(), kinds[i % 7], [f"{r.randint(1, 4)}.{r.randint(1, 6)}" for _ in range(r.randint(0, 3))] or None, r.choice(["A", "", None, "B"]), [(f"Which {word()} {i} {j}?", vec()) for j in range(r.randint(0, 2))] or None))
    table = spark.createDataFrame(questions, "question_id long, query string, embedding array<double>, query_type string, rule_numbers array<string>, scenario string, sub_queries array<struct<query:string,embedding:array<double>>>")
    return chunks, questions, table


def test_one_plan_gives_what_one_by_one_gives(spark):
    chunks, questions, table = made(spark)
    index = rule_index.rule_index(chunks)
    for preset in ("rules", "profile"):
        found = asked.retrieved(chunks, index, table, preset)
        got = {part: {} for part in ("documents", "references", "conflicts", "contexts")}
        for part, rows in found.items():
            for x in rows.collect():
                got[part].setdefault(x.question_id, []).append(x)
        for i, query, embedding, kind, rules, scenario, subs in questions[: 4 if preset == "rules" else 1]:
            vectors = {query: embedding} | dict(subs or [])
            want = retrieval.answer_context(chunks, index, query, vectors.__getitem__, {k: v for k, v in {"query_type": kind, "rule_numbers": rules, "scenario": scenario, "sub_queries": [s for s, _ in subs or []]}.items() if v is not None}, preset=preset)
            assert sorted((x.pos, x.chunk_id) for x in got["documents"].get(i, [])) == sorted((x.pos, x.chunk_id) for x in want["documents"].collect())
            assert sorted((x.pos, x.chunk_id) for x in got["references"].get(i, [])) == sorted((x.pos, x.chunk_id) for x in want["references"].collect())
            assert sorted(x.note for x in got["conflicts"].get(i, [])) == sorted(x.note for x in want["conflicts"].collect())
            assert [x.context for x in got["contexts"].get(i, [])] == [x.context for x in want["context"].collect() if x.context]


def test_the_plan_does_not_grow_with_the_questions(spark):
    chunks, _, table = made(spark)
    index = rule_index.rule_index(chunks)
    joins = [asked.route(chunks, index, table.limit(n))._jdf.queryExecution().analyzed().toString().count("Join") for n in (1, 20)]
    assert joins[0] == joins[1]


def test_no_questions(spark):
    chunks, _, table = made(spark)
    found = asked.retrieved(chunks, rule_index.rule_index(chunks), table.limit(0))
    assert all(rows.count() == 0 for rows in found.values())


def test_searches_by_value_and_bounds(spark, monkeypatch):
    """Many queries, each against the rows of its own value, with a sample smaller than the table."""
    monkeypatch.setattr(vector, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(vector, "HELD_ROWS", 25)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=5).tolist(), "xyz"[i % 3] if i % 10 else None) for i in range(200)] + [(500, [0.0] * 5, "x"), (501, None, "x")]
    queries = [(j, r.normal(size=5).tolist(), ["x", "y", None, "none"][j % 4]) for j in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(3)
    table = spark.createDataFrame(queries, "query_id long, query array<double>, own string")
    for metric in ("cosine", "l2"):
        got = {(x.query_id, x["rank"]): x.vec_id for x in vector.multi_top_k(vectors, table, 4, metric, same=("kind", "own")).collect()}
        want = {}
        for j, q, own in queries:
            for k, x in enumerate(vector.top_k(vectors.filter(F.col("kind") == own), q, 4, metric).collect() if own else []):
                want[j, k + 1] = x.vec_id
        assert got == want


def test_replies_are_asked_once(spark, tmp_path):
    """Each distinct prompt is sent once, by whatever run; failing prompts leave an error and are tried a few times."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(prompts):
        with open(calls / f"{os.getpid()}-{random.random()}", "w") as f:
            f.write("\n".join(prompts))
        if any("bad" in p for p in prompts):
            raise ValueError("no such thing")
        return [p.upper() for p in prompts]

    def sent():
        found = [p for f in calls.iterdir() for p in f.read_text().split("\n")]
        for f in calls.iterdir():
            f.unlink()
        return sorted(found)

    store = Replies(spark, f"file://{tmp_path}/replies", tries=2)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id long, p string").withColumn("error", F.lit("x")).repartition(1)
    want = [(1, "A", None), (2, "B", None), (3, "A", None), (4, None, None), (5, None, "ValueError: no such thing")]
    for k in range(3):
        got = store.asked(rows, F.col("p"), model)
        assert sorted((x.id, x.reply, x.error) for x in got.collect()) == want
        asked_for = sent()
        assert set(asked_for) == [{"a", "b", "bad"}, {"bad"}, set()][k] and (k == 0 or len(asked_for) <= 1)
    more = spark.createDataFrame([(9, "b"), (10, "c")], "id long, p string")
    assert sorted((x.id, x.reply) for x in store.asked(more, F.col("p"), model).collect()) == [(9, "B"), (10, "C")] and sent() == ["c"]
    other = store.asked(more, F.col("p"), models.first_source, name="other")
    assert {x.reply for x in other.collect()} == {"The documents do not answer it."}


def test_answers_and_verdicts(spark, tmp_path):
    chunks, questions, table = made(spark)
    found = asked.retrieved(chunks, rule_index.rule_index(chunks), table)
    store = Replies(spark, f"file://{tmp_path}/replies")

    def model(prompts):
        if any("river 3?" in p or "3?" in p.rsplit("Question: ", 1)[1] for p in prompts):
            raise RuntimeError("down")
        return models.first_source(prompts)

    rows = {x.question_id: x for x in asked.answered(table, found, store, model, models.lenient_judge).collect()}
    assert len(rows) == len(questions)
    failed = {i for i, x in rows.items() if x.answer_error}
    assert failed == {i for i, q, *_ in questions if q.endswith("3?")} and all(rows[i].answer is None and rows[i].verdicts.faithfulness == "No" for i in failed)
    assert all(x.verdicts.faithfulness == x.verdicts.citation == "Yes" for i, x in rows.items() if i not in failed and x.context)
