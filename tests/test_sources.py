"""Keyed tables, paged sources, bad rows and files for records: restarts, order, and what is left as it is."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstone.sources import paged, versions
from loomstone.sources.keyed import KeyedTable
from loomstone.streaming.incremental import merge_stream

ROW = "id long, v string, at long, gone boolean"


def state(table):
    return {r.id: (r.v, r["at"]) for r in table.rows().collect()}


def test_batches_in_any_order_give_the_same_table(spark, tmp_path):
    rng = random.Random(1)
    changes = [(rng.randrange(40), f"v{k}", rng.randrange(30), rng.random() < 0.2) for k in range(200)] + [(None, "x", 1, False), (1, "x", None, False)]
    want = None
    for order in range(2):
        table = KeyedTable(spark, str(tmp_path / f"t{order}"), "id", "at", buckets=8)
        parts = [changes[k::3] for k in range(3)]
        rng.shuffle(parts)
        for part in [*parts, parts[0]]:
            table.merge(spark.createDataFrame(part, ROW), deleted=F.col("gone"))
        newest = {}
        for i, v, at, gone in changes:
            if i is not None and at is not None:
                newest.setdefault(i, {}).setdefault(at, set()).add((v, gone))
        got = state(table)
        for i, by in newest.items():
            last = by[max(by)]
            assert (i in got and (got[i][0], False) in last and got[i][1] == max(by)) or (i not in got and any(g for _, g in last))
        if all(len(by[max(by)]) == 1 for by in newest.values()):
            assert want is None or got == want
            want = got
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none"), "id", "at").rows()


def test_merge_writes_touched_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "at", buckets=16)
    rows = spark.range(300).select("id", F.lit("a").alias("v"), F.lit(1).cast("long").alias("at"), F.lit(False).alias("gone"))
    assert table.merge(rows, stream="s", batch=0) == 16
    before = {e.bucket: e.folder for e in table.entries()}
    some = spark.createDataFrame([(7, "b", 2, False), (9, "c", 2, True)], ROW)
    assert table.merge(some, deleted=F.col("gone"), stream="s", batch=1) <= 2
    after = {e.bucket: e.folder for e in table.entries()}
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and table.merged() == {"s": 1}
    assert table.merge(some, stream="s", batch=1) == 0 and table.version == 2  # merged before
    got = state(table)
    assert len(got) == 299 and got[7] == ("b", 2) and 9 not in got and len(table.rows(1).collect()) == 300
    table.merge(spark.createDataFrame([(9, "late", 1, False)], ROW))  # older than the deletion
    assert 9 not in state(table)
    table.compact(4)
    assert {e.bucket for e in table.entries()} == set(range(4)) and state(table) == got
    assert table.vacuum() >= 3 and versions.versions(table.store) == [table.version] and state(table) == got
    assert table.merge(rows.limit(0)) == 0


def service_of(n, page, mark, broken):
    """Answers for keys 0 .. n-1 in pages; 503 every third time, and it breaks once where it is asked for ``broken``."""
    calls = [0]

    def fetch(request):
        asked = dict(request.params)
        lo, hi = int(asked.get("cursor", asked["lo"])), min(n, int(asked["hi"]))
        calls[0] += 1
        if calls[0] % 3 == 2:
            return paged.Answer(503)
        if lo <= broken < hi:
            try:
                with open(mark, "x"):
                    raise ValueError("broken midway")
            except FileExistsError:
                pass
        to = min(hi, lo + page)
        body = {"r": [{"id": k, "flag": "Y" if k % 2 else None, "n": "x" if k == 3 else str(k), "deep": {"a": [k]}} for k in range(lo, to)], "next": to if to < hi else None}
        return paged.Answer(200, json.dumps(body).encode())

    return fetch


def test_stream_starts_again_where_it_broke(spark, tmp_path):
    fetch = paged.with_retry(service_of(95, 7, str(tmp_path / "mark"), 60), sleep=lambda s: None)
    first = lambda lo, hi: paged.Request("u", (("lo", str(lo)), ("hi", str(hi))))
    upto = str(tmp_path / "upto")

    def known():
        with open(upto) as f:
            return int(f.read())

    source = paged.ranged_source("breaking", "id long, flag boolean, n int, deep string", first, fetch, "r", paged.next_by_cursor("next", "cursor"), known, names={"deep": "deep.a"}, range_keys=20)
    spark.dataSource.register(source)
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "id", buckets=4)

    def run(keys):
        (tmp_path / "upto").write_text(str(keys))
        merge_stream(spark.readStream.format("breaking").load(), table, str(tmp_path / "c"), name="pages")

    run(40)
    with pytest.raises(Exception, match="broken midway"):
        run(80)
    assert sorted(r.id for r in table.rows().collect()) == list(range(40))
    run(80)
    run(95)
    got = {r.id: r for r in table.rows().collect()}
    assert sorted(got) == list(range(95)) and got[3].n is None and got[5].n == 5 and got[5].flag and not got[4].flag and got[6].deep == "[6]"
    assert table.rows().count() == 95
    assert spark.read.format("breaking").load().where("id < 50").count() == 50


def test_fetches_try_again_and_follow_links():
    asked = []

    def shaky(request):
        asked.append(request)
        if len(asked) < 3:
            raise ConnectionError
        return paged.Answer(404 if request.url == "gone" else 200, b"{}")

    waited = []
    assert paged.with_retry(shaky, sleep=waited.append)(paged.Request("u")).status == 200
    assert len(waited) == 2 and 0.75 <= waited[0] <= 1.25 and 1.5 <= waited[1] <= 2.5
    with pytest.raises(paged.FetchError):
        paged.with_retry(shaky, sleep=waited.append)(paged.Request("gone"))
    with pytest.raises(paged.FetchError):
        paged.with_retry(lambda r: paged.Answer(500), tries=3, sleep=waited.append)(paged.Request("u"))
    assert len(waited) == 4
    posted = paged.post_after_get(lambda r: paged.Answer(200 if r.method == "POST" else 403, r.method.encode()))
    assert posted(paged.Request("u", (("q", "1"),))).body == b"POST"

    def linked(request):
        at = int(dict(request.params).get("skip", 0))
        header = f'<http://s/x?skip={at + 2}>; rel="next", <http://s/x>; rel="first"' if at < 4 else '<http://s/x>; rel="first"'
        return paged.Answer(200, json.dumps({"results": [at, at + 1] if dict(request.params)["q"] == "a" else []}).encode(), {"link": header})

    assert list(paged.pages(linked, paged.Request("http://s/x", (("q", "a"),)), "results", paged.next_by_link)) == list(range(6))
    still = lambda r: paged.Answer(200, b'{"r": [1], "c": "*"}')
    assert list(paged.pages(still, paged.Request("u", (("cursor", "*"),)), "r", paged.next_by_cursor("c", "cursor"))) == [1]


def test_articles_are_typed():
    from pyspark.sql.types import _parse_datatype_string

    decode = paged.decoder(_parse_datatype_string(paged.ARTICLE), paged.ARTICLE_PATHS)
    assert decode({"id": 5, "source": "MED", "title": "T", "citedByCount": "7", "isOpenAccess": "N"}) == ("5", "MED", "T", None, None, None, None, None, 7, False)
    assert decode({"id": "x", "authorString": "A B", "pubYear": "2020", "citedByCount": None, "isOpenAccess": "Y", "doi": "d"})[3:] == ("A B", None, "2020", None, "d", None, True)


def test_leaves_of_any_depth(spark):
    from loomstone.functions import variants

    deep = {"x": 1}
    for k in range(30):
        deep = {f"k{k}": deep, "n": None}
    objects = [{"b": {"c": [2, {"z": 1, "a": None}], "d": True}, "a": "t", "e": None, "f": {}, "g": 1.5}, deep, [1], "s", {}, {"a_b": 1, "a": {"b": "other"}}]
    df = spark.createDataFrame([(k, json.dumps(o)) for k, o in enumerate(objects)] + [(99, None), (98, "{broken")], "id long, j string").withColumn("v", F.try_parse_json("j"))

    def flat(o, above=""):
        for k, x in o.items():
            if isinstance(x, dict):
                yield from flat(x, f"{above}{k}_")
            elif x is not None:
                yield (above + k, json.dumps(x, separators=(",", ":"), sort_keys=True) if isinstance(x, (list, bool)) else str(x))

    got = sorted((r.id, r.path, r.text) for r in variants.leaves(df, "id", "v").collect())
    assert got == sorted((k, *leaf) for k, o in enumerate(objects) if isinstance(o, dict) for leaf in flat(o))
    names = variants.flat_json(df.where("id = 0"), "id", "v").select(F.map_keys("flat").alias("k")).first().k
    assert names == ["a", "b_c", "b_d", "g"]
    tree = {"b": {"c": variants.KEEP, "q": variants.KEEP}, "a": lambda c: F.upper(c)}
    made = {r.id: r.p for r in df.where("id IN (0, 2, 99)").select("id", variants.pruned_json(F.col("v"), tree).alias("p")).collect()}
    assert json.loads(made[0]) == {"b": {"c": [2, {"a": None, "z": 1}], "q": None}, "a": "T"} and json.loads(made[2]) == json.loads(made[99]) == {"b": {"c": None, "q": None}, "a": None}


def test_bad_lines_are_numbered(spark, tmp_path):
    from loomstone.sources import records

    lines = ['{"a": 1, "b": "x"}', "", '{"a": "no", "b": "y"}', '{"b": "z"}', "[1]", "{", '{"a": 2}', '{"a": null, "b": 3}'] * 400
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "g.jsonl").write_text("nope\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # parts of a file are read apart
    try:
        good, bad = records.parted_lines(spark, str(tmp_path / "in"), "a int, b string", ["a"])
        assert sorted((r.a, r.b or "") for r in good.collect()) == sorted([(1, "x"), (2, "")] * 400)
        found = {(r.file_name, r.line): (r.reason, r.value) for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    why = {2: "bad a", 3: "no a", 4: "no object", 5: "not JSON", 7: "no a"}
    assert found == {("f.jsonl", k + 1): (why[k % 8], line) for k, line in enumerate(lines) if k % 8 in why} | {("g.jsonl", 1): ("not JSON", "nope")}
    assert {(r.file_name, r.reason): r.n for r in records.bad_counts(bad).collect()}["f.jsonl", "no a"] == 800


def test_files_of_records_are_all_there_or_none(spark, tmp_path):
    from loomstone.sources import records

    path = tmp_path / "out"
    rows = [(k, f"Name {k % 3}!", f"text {k} é") for k in range(20)] + [(50, None, "unnamed"), (51, "null", None), (52, "  ", "")]
    df = spark.createDataFrame(rows, "id long, n string, t string").repartition(3)
    names = {r.id: r.file_name for r in records.write_records(df, str(path), F.col("n"), F.col("t"), order="id", ending=".md").collect()}
    assert names[0] == "name_0.md" and names[3] == "name_0__1.md" and names[50] == "unnamed.md" and names[52] == "unnamed__1.md" and 51 not in names
    got = {r.file_name: bytes(r.content).decode() for r in records.read_records(spark, str(path)).collect()}
    assert got == {names[i]: t for i, _, t in rows if t} and [p.stat().st_size for p in path.glob("*/unnamed__1.md")] == [0]
    broken = spark.range(0, 40, 1, 4).select(F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") < 39, F.col("id").cast("string").cast("binary")).otherwise(F.raise_error(F.lit("midway"))).alias("content"))
    with pytest.raises(Exception, match="midway"):
        broken.write.format("loomstone_record_files").mode("append").option("path", str(path)).save()
    assert {r.file_name for r in records.read_records(spark, str(path)).collect()} == set(got)
    assert all(p.name.startswith(("job-", "_job-")) for p in path.iterdir())  # what late attempts leave, readers don't see


def test_files_of_odd_documents_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from loomstone.plans import everything

    sources = ["src1", "Src 1", "SRC-1!", "src 1", None, "", "!?", "unnamed", "null", "\u0130x", "\u212a7", "long" * 90, "long" * 91]
    texts = ["", "one", None, "two", "\u00e9, \U0001d7d8"]
    rows = [(None if k % 31 == 30 else k, texts[(k * 7 + k // 13) % 5], sources[k % 13]) for k in range(260)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(everything.SQL["record_files"]).fetchall()
    got = [(r.file_name, r.bytes, r.digest) for r in everything.QUERIES["record_files"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 208 and any(n is None for n, _, _ in got) and any(b == 0 for _, b, _ in got)


def test_asking_once_a_few_at_a_time(spark, tmp_path):
    from loomstone.plans import hooks

    log = str(tmp_path / "log")

    async def call(prompt):
        import asyncio

        with open(log, "a") as f:
            f.write(prompt + "\n")
        await asyncio.sleep(0.001)
        if prompt == "busy":
            raise ConnectionError("busy")
        if prompt == "odd":
            raise ValueError("odd")
        return prompt.upper()

    df = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b", "a", "busy", "odd", None, "known", "b"])], "id long, p string")
    memo = spark.createDataFrame([("known", "K")], "prompt string, answer string")
    answered, asked = hooks.ask(df, "p", call, at_once=2, tries=3, pause=0.0, memo=memo)
    assert {r.id: r.answer for r in answered.collect()} == {0: "A", 1: "B", 2: "A", 3: None, 4: None, 5: None, 6: "K", 7: "B"}
    assert {r.prompt: (r.error, r.tries, r.retryable) for r in asked.collect() if r.error} == {"busy": ("ConnectionError: busy", 3, True), "odd": ("ValueError: odd", 1, False)}
    assert sorted(open(log).read().split()) == ["a", "b", "busy", "busy", "busy", "odd"]
