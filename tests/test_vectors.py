"""Vector searches and the stored collection against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import vector


def brute(rows, queries, k, least=-2.0, digits=5):
    ok = lambda rs: [(i, np.array(x, float)) for i, x in rs if x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x)]
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    out = set()
    for q, x in ok(queries):
        near = sorted((-round(float(unit(x) @ unit(y)), digits), i) for i, y in ok(rows))
        out |= {(q, i, -s, n) for n, (s, i) in enumerate([p for p in near if -p[0] >= least][:k], 1)}
    return out


def plain(df):
    return {(r.query_id, r.id, round(r.similarity, 5), r["rank"]) for r in df.collect()}


def vectors(n=700, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    near = centres[rng.integers(0, 12, n)] + 0.35 * rng.standard_normal((n, dim))
    near[n // 2 : n // 2 + 120] = near[0]  # a hot vector
    return [(int(i), [round(float(x), 4) for x in v]) for i, v in zip(rng.permutation(n), near)]


ODD = [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 10), (9004, [float("nan")] * 12), (9005, [0.0] * 12), (9006, [float("inf")] + [1.0] * 11)]
SCHEMA = "id long, embedding array<double>"


@pytest.mark.parametrize("least,pivots", [(0.95, 9), (0.6, 40), (-2.0, None)])
def test_neighbours_are_those_of_all_pairs(spark, least, pivots):
    rows = vectors(300 if least < 0 else 700) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    got = plain(vector.neighbours(df, 5, least, pivots=pivots))
    assert got == brute(rows, rows, 5, least)


def test_visits_leave_cells_out():
    points = vector.matrix(vector.pa.array([v for _, v in vectors()], vector.pa.list_(vector.pa.float64())))
    batch = vector.pa.RecordBatch.from_arrays([vector.pa.array(range(len(points))), vector.pa.array(points.tolist(), vector.pa.list_(vector.pa.float64()))], ["id", "embedding"])
    pivots = points[:20]
    homes, visits = (next(iter(vector._cells_within(pivots, 0.3, only)([batch]))) for only in (True, False))
    home = dict(zip(homes.column(0).to_pylist(), homes.column(1).to_pylist()))
    cells = defaultdict(set)
    for i, c in zip(visits.column(0).to_pylist(), visits.column(1).to_pylist()):
        cells[i].add(c)
    close = np.argwhere(2 - 2 * points @ points.T <= 0.09)
    assert all(home[j] in cells[i] for i, j in close.tolist())
    assert visits.num_rows < 0.5 * len(points) * 20


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_in_blocks_and_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK_QUERIES", block)
    monkeypatch.setattr(vector, "CHUNK_ROWS", 50)
    rows = vectors(260) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    queries = df.where("id % 9 = 0 or id > 9000").withColumnRenamed("id", "query_id")
    assert plain(vector.nearest(queries, df, 6)) == brute(rows, [r for r in rows if r[0] % 9 == 0 or r[0] > 9000], 6)
    assert vector.nearest(queries.limit(0), df, 3).count() == vector.nearest(queries, df.limit(0), 3).count() == 0


# --- the stored collection
@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from loomstone.sources.collection import Collection

    rows = [(*r, "doc" + str(r[0])) for r in vectors() + ODD]
    df = spark.createDataFrame(rows, SCHEMA + ", document string")
    path = str(tmp_path_factory.mktemp("collection") / "c")
    return Collection(spark, path).build(df, lists=24), rows, path


def test_collection_keeps_rows_and_reaches_the_recall(spark, stored):
    made, rows, _ = stored
    assert {(r.id, r.document) for r in made.rows().collect()} == {(i, d) for i, _, d in rows}
    entries = made._entries()
    assert len(entries) > 8 and 1 <= entries[0].probes < 24
    queries = spark.createDataFrame([r[:2] for r in rows if r[0] % 7 == 0], "query_id long, embedding array<double>")
    want = brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 7 == 0], 5)
    assert plain(made.search(queries, 5, probes=24)) == want
    found = plain(made.search(queries, 5))
    assert len({x[:2] for x in found} & {x[:2] for x in want}) >= 0.9 * len(want)


def test_collection_upsert_touches_few_lists(spark, stored):
    from loomstone.sources.collection import Collection
    from loomstone.sources.versions import VersionExists, publish

    made, rows, path = stored
    before = {e.list: e.folder for e in made._entries()}
    some = [r for r in rows if r[0] < 500][:2]
    changes = [(some[0][0], some[1][1], "moved", 1), (10_000, some[1][1], "new", 1), (10_000, some[1][1], "newer", 2), (some[1][0], None, "blank", 1)]
    written = made.upsert(spark.createDataFrame(changes, SCHEMA + ", document string, at int"), order="at")
    again = Collection(spark, path)
    after = {e.list: e.folder for e in again._entries()}
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert 1 <= written == len(changed) <= 4 and again.version == 2
    want = {i: d for i, _, d in rows} | {some[0][0]: "moved", 10_000: "newer", some[1][0]: "blank"}
    assert {r.id: r.document for r in again.rows().collect()} == want
    vectors_now = {r[0]: r[1] for r in rows} | {some[0][0]: some[1][1], 10_000: some[1][1], some[1][0]: None}
    q = spark.createDataFrame([(1, some[1][1])], "query_id long, embedding array<double>")
    assert plain(again.search(q, 4, probes=24)) == brute(list(vectors_now.items()), [(1, some[1][1])], 4)
    with pytest.raises(VersionExists):
        publish(again.store, spark.range(1), 2)
    assert again.delete(spark.createDataFrame([(10_000,)], "id long")) == 1 and again.delete(spark.createDataFrame([(77_777,)], "id long")) == 0
    assert 10_000 not in {r.id for r in again.rows().collect()}
    again.rebuild(again.rows().drop("list").where("id % 2 = 0"), lists=5)
    assert again.vacuum() >= 2 and again.version == 4
    assert {r.id for r in Collection(spark, path).rows().collect()} == {i for i in want if i % 2 == 0 and i != 10_000}


def test_collection_of_nothing(spark, tmp_path):
    from loomstone.sources.collection import Collection

    empty = Collection(spark, str(tmp_path / "none")).build(spark.createDataFrame([], SCHEMA))
    assert empty.rows().count() == 0
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert empty.search(q.limit(0), 3).count() == 0
    assert empty.upsert(spark.createDataFrame([(3, None)], SCHEMA)) == 1 and empty.rows().count() == 1


def test_a_search_that_rules_out_nothing_moves_no_row_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 40)).astype(np.float32))] + [(500, [0.0] * 40)]
    seen, searched = [], vector.cell_search

    def counted(queries, corpus, *a, **k):
        seen.append((queries.count(), queries.schema["embedding"].dataType.simpleString()))
        return searched(queries, corpus, *a, **k)

    monkeypatch.setattr(vector, "cell_search", counted)
    got = plain(vector.neighbours(spark.createDataFrame(rows, "id long, embedding array<float>"), 4, 0.3, pivots=30))
    assert got == brute(rows, rows, 4, 0.3)
    assert seen == [(401, "array<float>")]


def test_no_task_holds_a_batch_for_all_cells_or_lists():
    from loomstone.sources.collection import _nearest_lists

    rng = np.random.default_rng(4)
    points = rng.standard_normal((5000, 16))
    batch = vector.pa.RecordBatch.from_arrays([vector.pa.array(range(5000)), vector.pa.array(points.tolist(), vector.pa.list_(vector.pa.float64()))], ["id", "embedding"])
    near = vector.matrix(batch.column(1))
    visits = list(vector._cells_within(near[:256], 1.9, False)([batch]))
    assert sum(b.num_rows for b in visits) == 5000 * 256 and max(b.num_rows for b in visits) <= vector.HELD_ROWS
    assert next(vector._visits(near[:256], 1.9)([batch.select(["embedding"])])).column(0).to_pylist() == [5000 * 256]
    for probes in (1, 200):
        lists = list(_nearest_lists(near[:256], probes, "id")([batch]))
        assert max(b.num_rows for b in lists) <= vector.HELD_NUMBERS // 8
        want = np.argsort(-(near @ near[:256].T), axis=1, kind="stable")[:, :probes]
        assert np.concatenate([b.column(1).to_numpy() for b in lists]).tolist() == want.ravel().tolist()
