"""The pipeline, stage by stage, against brute force on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm.common import written
from llm.test_operators import best_fit, components, measures, plain_words


def planted(seed=4):
    rng = random.Random(seed)
    plain = "the of and to in is that it was for on with".split()
    vocabulary = plain * 25 + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    sentences = lambda n: "\n".join(text(12) + "." for _ in range(n))
    docs = {i: sentences(rng.randint(6, 20)) for i in range(60)}
    docs |= {100 + i: " ".join(f"x{j}### y{j}$$$" for j in range(40 + i)) for i in range(8)}  # junk
    docs |= {120: "too short", 121: "", 122: None}
    docs |= {200 + i: docs[i] for i in range(4)}  # copies
    docs |= {210 + i: docs[10 + i].replace(docs[10 + i].split()[20], "edited", 1) for i in range(4)}  # near copies
    passage = text(70)
    for i in (30, 31, 32):
        docs[i] = docs[i] + "\n" + passage + "\n" + sentences(8)
    items = [(i, text(40)) for i in range(5)]
    for n, i in enumerate((40, 41, 42)):
        w = items[n][1].split()
        for at in rng.sample(range(40), 2 * n):
            w[at] = "other"
        docs[i] = docs[i] + "\n" + " ".join(w) + "."
    return docs, items


def test_each_stage(spark, tmp_path):
    docs, items = planted()
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = now.schema
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), "stage")
        assert now.schema == first
        after[name] = {r.doc_id: r.text for r in now.collect()}
    good, single, cut, clean = after.values()
    # quality: what the base rules fail is gone, junk too; every clean document stays
    failed = {i for i, t in docs.items() if (m := measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
    assert set(good) == set(docs) - failed - set(range(100, 108))
    # one document of each component
    _, label = components(list(good.items()), 5, 80)
    assert set(single) == {i for i in good if label[i] == i}
    # the passage stays in its first document
    assert {i for i in single if cut[i] != single[i]} == {31, 32}
    for i in (31, 32):
        kept = len(single[i].split()) - len(cut[i].split())
        assert 66 <= kept <= 76
    assert {r.doc_id: r.n_chars for r in now.collect()} == {i: len(t) for i, t in clean.items()}
    # no document holds an item
    held = {i for i, t in cut.items() for _, u in items if best_fit(plain_words(u), plain_words(t)) <= int(0.2 * len(plain_words(u)))}
    assert held and set(clean) == set(cut) - held
    # every word is packed once; run() does the same
    out = corpus_pipeline.run(spark, str(tmp_path))
    packed = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert packed == {i: len(t.split()) for i, t in clean.items()}


def test_stages_take_repeated_rows_nulls_and_columns_of_any_name(spark, tmp_path):
    docs, items = planted(9)
    rows = [(i, t, "x", "y", "z", None) for i, t in docs.items()]
    rows += [rows[0], rows[40], (None, docs[1], None, None, None, None), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, row string, spans string, kept string, n_chars long"
    now = spark.createDataFrame(rows, schema)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, now, str(tmp_path)), "stage")
        assert out.schema == now.schema and 0 < out.count() <= now.count()
        now = out
    assert now.where("doc_id = 0").count() == 2 and now.where("doc_id is null").count() == 1
    words = sum(len(r.text.split()) for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == words


def test_stages_take_empty_tables(spark, tmp_path):
    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, str(tmp_path)).count() == 0
