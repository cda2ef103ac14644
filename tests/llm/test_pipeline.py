"""Each stage of the pipeline on its own input against brute force, and the run as a whole."""

import random
import re

import pytest
from test_dedup import groups
from test_finding import STEMS, contaminated, spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    say = lambda x, n: " ".join("".join(r.choice(STEMS[x]) for _ in range(r.randint(2, 4))) for _ in range(n))
    rows = [(i, say(x := r.choice(list(STEMS)), r.randint(20, 90)), x) for i in range(150)]
    items = [(i, say("en", 25)) for i in range(4)]
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[4][1] + " tail", rows[4][2]), (202, say("en", 30) + " " + items[0][1].upper() + " " + say("en", 30), "en"), (203, say("fr", 30) + " me@mail.example.com or +1 (743) 555-3824, 84.93.123.184", "fr"), (204, "1234 -- 5678", "en"), (205, None, "de"), (206, "", None), (207, say("de", 40), None), (None, say("en", 40) + " you@mail.example.com", "en"), (208, say("en", 2000), "en")]
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:4]:
        path = f"{folder}/after-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        now = docs.collect()
        if name == "language_id":
            want = [r for r in before if re.search(r"[^\W\d_]", r.text or "")]
        elif name == "near_duplicates":
            ranked = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
            want = [ranked[i] for i, _, c in groups([(i, r.text) for i, r in enumerate(ranked)], 80) if i == c]
            assert len(want) <= len(before) - 2
        elif name == "decontamination":
            hit = {c[0] for c in contaminated([(r.doc_id, r.text) for r in before], [(i.item_id, i.text) for i in items], 10) if c[-1]}
            assert hit == {202}
            want = [r for r in before if r.doc_id not in hit]
        else:
            def clean(text):
                for kind, a, b in sorted(spans(text), key=lambda s: -s[1]):
                    text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
                return text

            want = [(r.doc_id, clean(r.text)) for r in before]
            assert key(now) == sorted(want, key=str)
            assert all(r.n_chars == len(r.text) for r in now) and sum("<EMAIL>" in r.text for r in now) == 2
            before = now
            continue
        assert key(now) == key(want), name
        before = now
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in before}
    used = {}
    for p in packed:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sum(n for _, n in own) <= 1024 and sorted(own)[0][0] == 0 for own in used.values())


def test_run(spark, folder):
    first, again = (sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).filter("doc_id is not null").collect()) for _ in range(2))
    assert first == again and len(first) > 100


def test_missing_and_repeated_ids_and_other_columns(spark, tmp_path):
    """Documents that no id tells apart are judged one by one; columns may have any name; a table may be empty."""
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choice(STEMS["en"]) for _ in range(r.randint(2, 4))) for _ in range(n))
    a, item = say(60), say(25)
    rows = [(1, a), (1, say(50)), (None, a + " end"), (None, say(40)), (None, f"{say(20)} {item}"), (2, f"{say(20)} {item} tail"), (2, say(30)), (None, "write me@mail.example.com " + say(30)), (3, say(30))]
    names = ["__spans", "spans", "row", "lang_pred", "score", "rest", "__row", "__text"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *range(8)) for i, t in rows], f"{SCHEMA}, {', '.join(f'{n} int' for n in names)}").coalesce(1)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    want = list(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns[5:] == names
        got = docs.collect()
        assert all(tuple(x)[5:] == tuple(range(8)) for x in got), name
        if name == "near_duplicates":
            want.remove(rows[2])
        elif name == "decontamination":
            want = [x for x in want if item not in x[1]]
        elif name == "personal_data":
            want = [(i, t.replace("me@mail.example.com", "<EMAIL>")) for i, t in want]
        assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(want, key=str), name
    assert {x.doc_id for x in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()} == {1, 2, 3, None}
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, f"file://{tmp_path}")
        assert none.count() == 0, name
