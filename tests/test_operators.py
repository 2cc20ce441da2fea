import json
import random

from pyspark.sql import functions as F

from loomstone.operators import dedupe, match, sequence
from loomstone.plans import hooks
from loomstone.sources import readers, sinks, tables
from loomstone.streaming import incremental


def greedy(n, near):
    root = {}
    for i in range(n):
        if i not in root:
            root[i] = i
            for j in near.get(i, ()):
                root.setdefault(j, i)
    return root


def test_greedy_canonical_is_the_sequential_pass(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 14
        near = {i: sorted(j for j in range(i + 1, n) if rng.random() < 0.2) for i in range(n)}
        nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
        edges = spark.createDataFrame([(i, j) for i, js in near.items() for j in js] or [(0, 0)], "src long, dst long")
        got = {r.id: r.root for r in dedupe.greedy_canonical(nodes, edges, tables.write_and_read).collect()}
        assert got == greedy(n, near)


def test_pack_carries_overlap():
    assert sequence.pack(["aaaa", "bbbb", "cccc"], 10, 3) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert sequence.pack([], 10, 3) == []
    assert sequence.pack(["aaaa", "bbbb", "cccc"], 10, 7) == ["aaaa\n\nbbbb", "aaaa\n\nbbbb\n\ncccc"]  # one paragraph doesn't reach 7
    assert sequence.pack(["aa", "x" * 25, "b"], 10, 4) == ["aa", "x" * 10, "x" * 10, "x" * 10, "x" * 7, "b"]
    assert sequence.pack(["aaaa", "bbbb"], 4, 0) == ["aaaa", "bbbb"]


def test_char_chunks(spark):
    df = spark.createDataFrame([("x" * 23,), ("",)], "t string")
    got = [(r.chunk_start, len(r.chunk)) for r in sequence.char_chunks(df.where("t <> ''"), "t", 10, 3).orderBy("chunk_no").collect()]
    assert got == [(0, 10), (7, 10), (14, 9)]


def test_cascade_stops_at_first_indexed_key(spark):
    probe = spark.createDataFrame([(1, 1, 0, "missing"), (1, 2, 0, "k"), (1, 3, 0, "good")], "probe_id long, rule int, pos int, key string")
    build = spark.createDataFrame([("k", 10, False), ("good", 11, True)], "key string, build_id long, fine boolean")
    row = match.cascade(probe, build, F.col("fine"), [F.col("build_id")]).first()
    assert (row.rule, row.build_id, row.candidates) == (2, None, 1)


def test_upsert_and_update(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, at long")
    assert sorted(map(tuple, tables.upsert(target, changes, "id", "at").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    done, unknown = tables.update_existing(target, changes.where("at = 1"), "id", ["v"])
    assert sorted(map(tuple, done.collect())) == [(1, "a"), (2, "x")]
    assert [r.id for r in unknown.collect()] == [3]
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, at long")
    assert sorted(r.id for r in tables.suffixed_ids(ids, "id", "at").collect()) == ["a", "a_2", "b"]


def test_readers_and_sinks(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text(json.dumps({"metadata": {"TITLE": "t", "YEAR": "2001"}, "factoids": [{"index": 4, "text": "one"}, {"id": 5, "factoid_text": "two"}, {"text": " "}]}))
    (docs / "b.json").write_text("{broken")
    rows = readers.factoids(readers.json_documents(spark, str(docs))).orderBy("pos").collect()
    assert [(r.file_name, r.idx, r.text, r.title, r.year) for r in rows] == [("a.json", 4, "one", "t", 2001), ("a.json", 5, "two", "t", 2001)]
    good, bad = readers.parted_documents(spark, str(docs))
    assert good.count() == 1 and [(r.file_name, r.value.strip()) for r in bad.collect()] == [("b.json", "{broken")]
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name, body in (("l.json", [{"x": 1}, {"x": 2}]), ("r.json", {"results": [{"x": 3}]}), ("o.json", {"x": 4})):
        (mixed / name).write_text(json.dumps(body))
    got = readers.json_records(spark, str(mixed)).select(F.try_variant_get("record", "$.x", "int").alias("x")).collect()
    assert sorted(r.x for r in got) == [1, 2, 3, 4]
    (tmp_path / "c.csv").write_text("﻿name, kind\n a ,\n", encoding="utf-8")
    assert [r.asDict() for r in readers.csv_rows(spark, str(tmp_path / "c.csv")).collect()] == [{"name": "a", "kind": ""}]
    out = str(tmp_path / "texts")
    sinks.header_texts(spark.createDataFrame([("T", "body")], "title string, body string").coalesce(1), out, ["title"], "body")
    row = readers.header_texts(spark, out).first()
    assert (row.fields, row.body) == ({"TITLE": "T"}, "body")
    made = sinks.documents(spark.createDataFrame([("d", "y", 2), ("d", "x", 1)], "k string, f string, o int"), "k", ["k"], "f", "o").first()
    assert [(f.id, f.factoid_text) for f in made.factoids] == [(1, "x"), (2, "y")]


def test_incremental_merge(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    go = lambda: incremental.merge_new_files(spark, str(source), "id long, v string, at long", str(tmp_path / "t"), str(tmp_path / "c"), "id", "at")
    (source / "1.json").write_text('{"id":1,"v":"a","at":1}\n{"id":2,"v":"b","at":1}\n')
    go()
    (source / "2.json").write_text('{"id":2,"v":"c","at":2}\n')
    go()
    got = incremental.latest_version(spark, str(tmp_path / "t")).select("id", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "c")]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "t", "cancer drug"), (2, "t", "stars"), (3, None, None)], "id long, title string, abstract string")
    got = {r.id: r.status for r in hooks.relevance(df, "title", "abstract", hooks.keyword_answer("drug")).collect()}
    assert got == {1: "relevant", 2: "not_relevant", 3: "no_abstract"}
    made = hooks.apply(df.select("abstract"), "abstract", hooks.hashed_embedding, "e", "array<float>").where("abstract is not null").collect()
    assert all(len(r.e) == hooks.DIMS for r in made)


def test_global_id_and_report(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(20)], "s long, d long")
    got = sorted((r.s, r.d, r.global_id) for r in sequence.global_id(df, ["s", "d"]).collect())
    assert [g for *_, g in got] == list(range(1, 21))
    rows = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c")], "id long, t string")
    rep = dedupe.duplicate_report(rows, dedupe.text_key(F.col("t")), "id").collect()
    assert [tuple(r) for r in rep] == [(1, 2, 2)]


def test_extract_whole_or_in_windows(spark):
    def tagging(texts):
        """One block a word; texts of more than 30 characters have no room, and those with "bad" fail."""
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [None if len(t) > 30 else "".join(f"<<<FACTOID>>> {w} <<<END_FACTOID>>>" for w in t.split()) for t in texts]

    long = " ".join(f"w{k:02d}" for k in range(20))  # 79 characters
    rows = [(1, "a B b  a"), (2, "bad"), (3, long), (4, None), (5, " "), (6, long[:39])]
    got = {r.id: (r.factoids, r.way) for r in hooks.extract(spark.createDataFrame(rows, "id long, text string"), "id", "text", hooks.safely(tagging), most=60, size=24, overlap=8).collect()}
    windows = lambda t: [t[at : at + 24] for at in range(0, max(1, len(t) - 8), 16)]
    brute = lambda t: list(dict.fromkeys(w for part in windows(t) for w in part.split()))
    assert got == {1: (["a", "B"], "single"), 2: ([], "chunked"), 3: (brute(long), "chunked"), 4: ([], "none"), 5: ([], "none"), 6: (brute(long[:39]), "chunked")}


def test_resolve_match(spark):
    def pick(prompts):
        asked = [json.loads(p) for p in prompts]
        return ["no json" if p["target"] == "odd" else json.dumps({"matched_file_name": next((c["file"] for c in p["candidates"] if c["name"] == p["target"]), None)}) for p in asked]

    rows = [(1, "x", [("f1", "y"), ("f2", "x")]), (2, "x", [("f1", "y")]), (3, "x", []), (4, "odd", [("f1", "odd")]), (5, "x", None), (6, "x", [("f1", "y"), ("f3", "z"), ("f2", "x")])]
    df = spark.createDataFrame(rows, "id long, target string, found array<struct<file:string,name:string>>")
    got = {r.id: r.matched_file_name for r in hooks.resolve_match(df, "target", "found", pick, most=2).collect()}
    assert got == {1: "f2", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_numbers_keep_every_row_and_column(spark):
    rows = spark.range(0, 400_000, 1, 4).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("k"), "id", F.concat(F.lit("payload-"), F.col("id")).alias("payload"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("g"))
    numbered = sequence.global_id(rows, ["k", "id"])
    assert numbered.columns == ["k", "id", "payload", "g", "global_id"]
    assert numbered.agg(F.count("*"), F.countDistinct("id"), F.countDistinct("global_id"), F.min("global_id"), F.max("global_id")).first()[:] == (400_000, 400_000, 400_000, 1, 400_000)
    assert numbered.where("payload <> concat('payload-', id)").count() == 0
    own = numbered.selectExpr("global_id", "row_number() OVER (ORDER BY k, id) AS want")
    assert own.where("global_id <> want").count() == 0
    groups = sequence.number_in_group(rows, "g", "id", "nth")
    per = groups.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("nth").alias("u"), F.min("nth").alias("lo"), F.max("nth").alias("hi"))
    assert sorted(r.n for r in per.collect()) == sorted([133_334, *[r.n for r in rows.where("g <> 'hot'").groupBy("g").agg(F.count("*").alias("n")).collect()]])
    assert per.where("n <> u OR lo <> 0 OR hi <> n - 1").count() == 0
    wrong = groups.selectExpr("nth", "row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS want").where("nth <> want")
    assert wrong.count() == 0


def test_numbers_of_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", 2), ("a", 2)], "g string, id long")
    got = sequence.number_in_group(rows, ["g"], ["id"], "nth").collect()
    assert sorted((r.g or "", r.nth) for r in got) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 2)]
    assert sorted(r.global_id for r in sequence.global_id(rows, ["g", "id"]).collect()) == [1, 2, 3, 4, 5]
    assert sequence.number_in_group(rows.limit(0), "g", "id", "nth").count() == sequence.global_id(rows.limit(0), ["g"]).count() == 0


def test_numbers_are_the_same_where_few_runs_go_to_the_rows(spark):
    rows = spark.range(0, 3000, 1, 3).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 4).cast("string")).alias("g"))
    want = sorted((r.id, r.nth) for r in sequence.number_in_group(rows, "g", "id", "nth").collect())
    for few in (1, 1000):  # more runs than that, and fewer
        assert sorted((r.id, r.nth) for r in sequence.number_in_group(rows, "g", "id", "nth", few=few).collect()) == want


def test_patterns_in_blocks(spark, monkeypatch):
    from loomstone.operators import patterns

    rng = random.Random(6)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    texts = [(k, "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 40)))) for k in range(80)] + [(900, None), (901, ""), (5, "ab")]
    df, wanted = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in [*words, "", None]], "pattern string")
    want = sorted((i, w) for i, t in texts if t for w in {w for w in words if w in t})
    for size in (1 << 20, 40):
        monkeypatch.setattr(patterns, "BLOCK_BYTES", size)
        assert sorted(map(tuple, patterns.found_in(df, wanted).collect())) == want
    assert patterns.found_in(df, wanted.limit(0)).count() == 0


def test_candidates_of_records_with_several_names(spark):
    names = spark.createDataFrame([(1, "tamoxifen citrate"), (1, "citrate"), (2, "tamox"), (3, "nolvadex"), (4, None)], "name_id long, name string")
    asked = spark.createDataFrame([("Tamoxifen (citrate)",), ("X",)], "n string")
    tokens = match.name_tokens(asked, "n", "n", {"tamoxifen (citrate)": ["Nolvadex"]})
    assert sorted(map(tuple, tokens.collect())) == [("Tamoxifen (citrate)", "citrate"), ("Tamoxifen (citrate)", "nolvadex"), ("Tamoxifen (citrate)", "tamoxifen"), ("X", "x")]
    got = sorted(map(tuple, match.substring_candidates(tokens, names, most=2).collect()))
    assert got == [("Tamoxifen (citrate)", 1, 2), ("Tamoxifen (citrate)", 3, 1), ("X", 1, 1), ("X", 2, 1)]
