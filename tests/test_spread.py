"""Heavy work for each row of a small file is dealt out before it is done."""

import asyncio
import json
import os

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomstone.functions import rules
from loomstone.plans import catalogue, embedding_rows, hooks, ingest, small
from loomstone.sources import paged, records

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["literature_rows", "guideline_rows", "seed_summaries"])
def test_rows_are_dealt_out(spark, name):
    assert "RoundRobinPartitioning" in catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_names_of_literature_rows_stand_once(spark):
    doc = '{"metadata":{"title":"T","file_name":"d/a.xml"},"factoids":[{"id":7,"factoid_text":" x "},{"factoid_text":"y"},{"factoid_text":" "},{"factoid_text":null},"z"]}'
    rows = embedding_rows.literature_rows(spark.createDataFrame([("n.json", doc)], "file_name string, d string").select("file_name", F.parse_json("d").alias("doc")))
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in text  # no list of all names made again for each of them
    own = {"source_json": "n.json", "source_family": "EPMC", "document_title": "T", "file_name": "d/a.xml", "doc_title": "T", "doc_file_name": "d/a.xml"}
    assert {r.id: (r.document, r.metadata) for r in rows.collect()} == {"a_7": ("x", own | {"factoid_id": "7"}), "a_2": ("y", own | {"factoid_id": "a_2"})}


def test_a_page_of_events_reads_no_more_than_it_needs(tmp_path, monkeypatch):
    ids = [*range(0, 1000), 5000, *range(9000, 9100)]
    pq.write_table(pa.table({"event_id": ids, "user_id": ids, "event_type": ["x"] * len(ids), "value": [1.0] * len(ids), "props": ["{}"] * len(ids)}), tmp_path / "e.parquet")
    read, opened = [], ds.dataset

    class Counted:
        def __init__(self, *a, **k):
            self.own = opened(*a, **k)

        def to_table(self, **k):
            read.append(self.own.to_table(**k))
            return read[-1]

    monkeypatch.setattr(ds, "dataset", Counted)
    fetch, got, lo = ingest.events_service(str(tmp_path / "e.parquet"), page=10), [], 0
    while lo is not None:
        answer = json.loads(fetch(paged.Request("events", (("lo", "0"), ("hi", "9100"), ("cursor", str(lo))))).body)
        got += [r["id"] for r in answer["found"]["list"]]
        lo = answer["next"]
    assert got == ids
    assert sum(t.num_rows for t in read) < 3 * len(ids)


def test_prompts_are_asked_in_bounded_runs(monkeypatch):
    texts = ["x" * n for n in (3, 0, 50, 4, 4, 4)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["prompt"])
    runs = [r.to_pylist() for r in hooks._within([batch.slice(0, 6)], 8)]
    assert [x for r in runs for x in r] == texts[:6] and [len(r) for r in runs] == [2, 1, 2, 1]
    begun, most = [], []

    async def call(prompt):
        begun.append(len(asyncio.all_tasks()))
        await asyncio.sleep(0)
        most.append(len(asyncio.all_tasks()))
        return prompt

    rows = asyncio.run(hooks._answers([str(i) for i in range(300)], call, 5, 1, 9.0, 0.0))
    assert [r[0] for r in rows] == [str(i) for i in range(300)]
    assert max(begun + most) <= 11  # 5 under way, each perhaps with its call as a task, and the run itself


def test_license_of_a_record_makes_its_texts_once(spark):
    plan = catalogue.license_rule_b(spark, DATA)._jdf.queryExecution().optimizedPlan().toString() if os.path.isdir(DATA) else ""
    assert plan.count("regexp_replace") <= 3
    kinds = "raw string, u array<string>, s array<string>, o array<string>, a array<string>"
    odd = [(r, *map(list, cells)) for _, r, *cells, _ in catalogue._RECORDS] + [(None, None, None, None, None), ("x", [None, " CC  BY 9.9 "], [], ["1"], []), ("Creative  Commons", [], None, ["yes"], []), ("", [], ["creative commons"], [], ["no"])]
    labels = [r.label for r in rules.publisher_labels(spark.createDataFrame(odd, kinds).coalesce(1), "raw", "u", "s", "o", "a").collect()]
    assert labels == [r[-1] for r in catalogue._RECORDS] + ["NO_OPEN_ACCESS", "CC_BY_UNSPECIFIED", "CREATIVE_COMMONS_UNCLEAR", "SELF_ARCHIVING_CREATIVE_COMMONS_UNCLEAR"]


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for folder, name, text in (("job-a", "x.txt", "one, two"), ("job-a", "empty.txt", ""), ("job-b", "y.txt", "three"), ("_job-c", "z.txt", "under way"), ("other", "w.txt", "no")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(text)
    found = records.read_records(spark, f"file:{tmp_path}/in")
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()  # Spark would list every file in the driver
    assert {(r.file_name, bytes(r.content)) for r in found.collect()} == {("x.txt", b"one, two"), ("y.txt", b"three")}
    assert [r.file_name for r in records.copy_matching(spark, found, str(tmp_path / "out"), lambda t: F.contains(t, F.lit(","))).collect()] == ["x.txt"]
    assert [r.file_name for r in records.copy_matching(spark, f"{tmp_path}/in/job-*", str(tmp_path / "out2"), lambda t: F.contains(t, F.lit("thr"))).collect()] == ["y.txt"]
    assert [bytes(r.content) for r in records.read_records(spark, str(tmp_path / "out")).collect()] == [b"one, two"]
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0
