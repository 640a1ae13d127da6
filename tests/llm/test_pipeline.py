"""The pipeline's stages on a small corpus, against their plain meaning."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean = {i: text(80) for i in range(30)}
    passage = text(40)
    rows = dict(clean) | {40: clean[3], 41: clean[4].upper(), 42: "!!! 12", 43: None, 44: text(60) + "\n" + passage, 45: passage + "  " + text(60), 46: clean[5] + " " + clean[6]}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) - set(kept["language_id"]) == {42, 43}
    assert set(kept["language_id"]) - set(kept["near_dedup"]) == {40, 41}
    last = kept["substring_dedup"]
    assert {i: last[i] for i in clean} == clean  # clean documents are as they were
    assert last[44] == rows[44] and last[45] == rows[45][len(passage) + 2:] and 46 not in last
    assert {r.doc_id for r in docs.collect()} == set(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_unlabelled(spark, tmp_path):
    rows = [(i, t, None, "s", len(t or "")) for i, t in enumerate(["some words here", "日本", "!!! 12", None, "", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()} == {0, 1, 5}


def test_near_dedup_keeps_one_row(spark, tmp_path):
    """Null, repeated and shared doc_ids: one row of each component, whatever its key."""
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, b.upper()), (7, c), (7, c), (7, c), (9, c), (7, d), (5, d), (None, d), (8, e), (8, e.upper())]
    docs = spark.createDataFrame([(i, t, None if i == 7 else "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0), r.text.lower()) for r in got) == sorted([(0, a), (0, b), (7, c), (5, d), (8, e)])


FORM = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows, and rows of which every column may be null, empty or repeated."""
    spark.createDataFrame([], FORM).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    text = "a plain text that has some words in it and then some more of them to read"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, None, None, None), (2, text, None, None, None), (None, text, "en", "s", 1), (3, " \n", "en", "s", 2)]
    df = spark.createDataFrame(rows, FORM)
    for (name, stage), left in zip(corpus_pipeline.STAGES, (3, 1, 1, 1), strict=True):
        df = corpus_pipeline.saved(stage(spark, df, str(tmp_path)), name)
        assert df.count() == left, name
