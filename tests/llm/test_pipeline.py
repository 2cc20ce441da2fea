"""The pipeline's stages, one after another, on odd rows and on an empty table."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _copies string"


def rows():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "nrst"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(25)
    made = [(i, text(60), "en", f"s{i % 3}", 0, "x") for i in range(30)]
    copy = made[4][1]
    return passage, [*made, (40, copy, "en", "s1", 0, None), (41, copy + " more", "en", None, 0, None), (42, text(20) + " " + passage + " " + text(20), None, "s2", 0, None), (43, None, "en", "s0", 0, None), (44, "", None, None, 0, None), (45, "123 456 !!", "en", "s0", 0, None), (None, text(30), "en", "s0", 0, None), (3, made[3][1], "en", "s0", 0, "x")]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    passage, made = rows()
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([] if empty else made, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
        assert name == "token_ids" or docs.columns == columns
    if empty:
        assert not any(seen.values())
        return
    ids = {k: {i for none, i in v if not none} for k, v in seen.items()}
    assert ids["language_id"] == {*range(30), 40, 41, 42}  # without letters or text: gone
    assert ids["near_dedup"] == {*range(30), 42} and (True, 0) in seen["near_dedup"]
    assert ids["decontaminate"] == set(range(30))
    assert ids["mix_sources"] <= set(range(30)) and len(seen["token_ids"]) == len(seen["mix_sources"])
    assert [r.start for r in docs.orderBy("start").limit(1).collect()] == [0]


def test_run(spark, tmp_path):
    passage, made = rows()
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(made, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_dedup_links_from_four_fifths_on(spark):
    words = [f"w{k}" for k in range(104)]  # runs of five: 100
    change = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    texts = [change(), change(30, 60), change(20, 50, 80)]  # of the first: 90 of 110 runs, 85 of 115
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
