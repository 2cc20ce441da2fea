"""Snapshot differences, filter audits and projection passes against brute force, with odd rows."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import filter_audit, projection_passes, snapshot_diff

SNAP = "doc_id long, text string, lang string, source string, k string, nth int, digest string"


# --- op11
def diff_by_hand(old, new):
    """For unique keys."""
    a, b = ({r[0]: r[1:4] for r in rows} for rows in (old, new))
    names = ("text", "lang", "source")
    differ = lambda x, y: ",".join(n for n, u, v in zip(names, x, y) if u != v)
    out = [(k, k, "update" if differ(a[k], b[k]) else "same", differ(a[k], b[k])) for k in a.keys() & b.keys()]
    gone, come = defaultdict(list), defaultdict(list)
    for k in sorted(a.keys() - b.keys()):
        gone[a[k][0]].append(k)
    for k in sorted(b.keys() - a.keys()):
        come[b[k][0]].append(k)
    for t in gone.keys() | come.keys():
        m = min(len(gone[t]), len(come[t]))
        out += [(n, o, "rekey", differ(a[o], b[n])) for o, n in zip(gone[t][:m], come[t][:m])]
        out += [(k, k, "delete", "") for k in gone[t][m:]] + [(k, None, "insert", "") for k in come[t][m:]]
    return Counter(out)


def found(spark, old, new):
    make = lambda rows: spark.createDataFrame([(*r[:4], "x", 1, "y") for r in rows], SNAP)
    df = snapshot_diff.snapshot_diff(make(old), make(new))
    return df, Counter((r.key, r.old_key, r.op, r.changed) for r in df.collect())


def test_snapshot_diff_is_what_pairs_by_hand(spark):
    rng = random.Random(11)
    texts = [None, "", "hot", *[f"t{i}" for i in range(40)]]
    pick = lambda: rng.choices(texts, [3, 3, 60, *[1] * 40])[0]
    row = lambda k: (k, pick(), rng.choice(["en", None]), rng.choice(["s", "t", None]))
    old = [row(k) for k in range(0, 900)]
    new = [r if rng.random() < 0.5 else row(r[0]) for r in old if rng.random() < 0.6] + [row(k) for k in range(-300, 0)]
    df, got = found(spark, old, new)
    assert got == diff_by_hand(old, new)
    assert {r.op for r in df.where("old is null").collect()} == {"insert"} and {r.op for r in df.where("new is null").collect()} == {"delete"}
    held = {r[0]: r[1:4] for r in new}
    assert all(tuple(r.new) == held[r.key] for r in df.where("new is not null").collect())


def test_snapshot_diff_of_odd_tables(spark):
    rows = [(1, "a", "en", "s"), (2, None, None, None), (3, "x " * 200_000, "en", "s")]
    assert found(spark, rows, rows)[1] == Counter({(k, k, "same", ""): 1 for k in (1, 2, 3)})
    assert found(spark, rows, [])[1] == Counter({(k, k, "delete", ""): 1 for k in (1, 2, 3)})
    assert found(spark, [], rows)[1] == Counter({(k, None, "insert", ""): 1 for k in (1, 2, 3)})
    assert found(spark, [], [])[1] == Counter()
    twice = [(1, "a", "en", "s"), (1, "a", "en", "s"), (1, "b", "en", "s"), (None, "n", "en", "s"), (None, "n", "en", "s"), (0, "zero", "en", "s")]
    once = [(1, "a", "en", "s"), (None, "n", "en", "s"), (0, "zero", "en", "s"), (9, "b", "en", "s")]
    assert found(spark, twice, once)[1] == Counter({(1, 1, "update", "text"): 1, (1, 1, "delete", ""): 2, (9, None, "insert", ""): 1, (None, None, "same", ""): 1, (None, None, "delete", ""): 1, (0, 0, "same", ""): 1})


def test_snapshots_meet_without_an_exchange(spark, capsys):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snapshot_diff.snapshot_diff(rows, rows.where("doc_id % 7 > 0")).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loomstone_")]


# --- op12
def audit_by_hand(rows, names):
    """rows: part, set of failed filters, good, toxic."""
    out, shapley = {}, Counter()
    for order in permutations(names):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in whole if f in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in whole), sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("names", ["ABC", "Q"])
def test_audit_counts_what_goes(spark, names):
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "s", None]), {f for f in names if rng.random() < 0.4}, rng.choice([True, False, None]), rng.random() < 0.2) for _ in range(300)]
    rows += [("lost", set(names), True, None)]
    df = spark.createDataFrame([(p, g, t, *[(f in s) or None for f in names], "clash") for p, s, g, t in rows], ", ".join(["s string", "good boolean", "toxic boolean", *[f"x{f} boolean" for f in names], "part string"]))
    edges = filter_audit.audit(df, {f: F.col(f"x{f}") for f in names}, part=F.col("s"), marks={"good": F.col("good"), "toxic": F.col("toxic")})
    assert edges.count() == 4 * len(names) * 2 ** (len(names) - 1)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in filter_audit.orders(edges, list(names)).collect()}
    assert got == audit_by_hand([(p or "", s, g, t) for p, s, g, t in rows], names)


def test_filter_audit_query_on_odd_documents(spark, tmp_path):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(1, words(250), "s"), (2, words(250), "s"), (None, words(250), "s"), (3, None, None), (4, "", ""), (5, "A" * 50 + " " + words(220), "s"), (6, "same " * 300, "t"), (7, words(200) + " #", "t"), (7, words(200) + " #", "t"), (8, "x" * 400_000, "t"), (9, " ".join("ab"), "t")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("fails", F.lit("clash")).withColumn("digest", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (2, 0, 1), (7, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fails = [("s", set(), 0, 0), ("s", {"E"}, 1, 1), ("s", set(), 0, 0), ("", {"A"}, 0, 0), ("", {"A", "E"}, 0, 0), ("s", {"C"}, 0, 0), ("t", {"B"}, 0, 0), ("t", {"D"}, 1, 1), ("t", {"D"}, 1, 1), ("t", {"A"}, 0, 0), ("t", {"A"}, 0, 0)]
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in filter_audit.op12_filter_audit(spark, str(tmp_path)).collect()}
    assert got == audit_by_hand(fails, "ABCDE")


# --- op13
def links_by_hand(rows, threshold=0.9):
    ok = [(i, np.array(x, float)) for i, x in rows if x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    units = [x / np.abs(x).max() for _, x in ok]
    units = [x / np.linalg.norm(x) for x in units]
    up, n = list(range(len(ok))), [0] * len(ok)

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a in range(len(ok)):
        for b in range(a):
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = top(a), top(b)
                up[x] = y
    least = {}
    for k, (i, _) in enumerate(ok):
        r = top(k)
        least[r] = min(i if i is not None else 1 << 60, least.get(r, 1 << 60))
    out = [(i, n[k], None if least[top(k)] == 1 << 60 else least[top(k)]) for k, (i, _) in enumerate(ok)]
    return Counter(out + [(i, 0, i) for i, x in rows if not any(x is y for y in [r[1] for r in rows if r[1] is not None and len(r[1]) and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])])])


def near(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("n", F.lit(1))
    got = projection_passes.near_vectors(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return Counter((r.vec_id, r.n_links, r.component_id) for r in got)


def test_near_vectors_of_odd_rows(spark):
    x, y = [1.0, 2.0, 3.0], [1.0, 2.0, 3.05]
    rows = [(5, x), (4, y), (4, y), (None, x), (3, None), (2, []), (2, [0.0, 0.0, 0.0]), (1, [1.0, None, 2.0]), (0, [float("nan"), 1.0, 1.0]), (-1, [float("inf"), 1.0, 1.0]), (9, [1e308, 2e308 / 1.0 if False else 1.5e308, 1.0]), (8, [1e-300, 1.5e-300, 1e-308]), (7, [1.0, 2.0]), (6, [2.0, 4.0]), (11, [-1.0, -2.0, -3.0]), (12, [-0.0, 0.0, 1.0]), (13, [0.0, -0.0, 1.0])]
    assert near(spark, rows) == links_by_hand(rows)
    assert near(spark, [(None, x), (None, y)]) == Counter({(None, 1, None): 2})
    assert near(spark, []) == Counter()


def test_near_vectors_are_found_at_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    dim, vectors = 24, []
    for k in range(400):  # pairs just above and just below the threshold
        u = rng.standard_normal(dim)
        w = rng.standard_normal(dim)
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.905 if k % 2 else 0.89
        vectors += [u, c * u + np.sqrt(1 - c * c) * w]
    centre = rng.standard_normal(dim)
    vectors += [centre + 0.02 * rng.standard_normal(dim) for _ in range(400)] + [centre] * 50  # wider than window and block
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    monkeypatch.setattr(projection_passes, "BLOCK", 64)
    got, want = near(spark, rows, window=128), links_by_hand(rows)
    assert sum((want - got).values()) <= 8 and sum(n for _, n, _ in want) > 0  # at most 2 % of the pairs at 0.905, both rows of a pair
    assert not [g for g in got - want if g[1] > dict((i, n) for i, n, _ in want)[g[0]]]  # none below the threshold
    assert len([g for g in got if g[1] >= 449]) == 450


def test_passes_grow_with_the_input():
    counts = [projection_passes.pass_count(n) for n in (10, 1024, 10_000, 1_000_000, 10**9)]
    assert counts[:2] == [1, 1] and counts == sorted(counts) and counts[-1] > 50


# --- op3: growth and statistics against slow definitions
def grown_by_hand(rows, labels, trees, depth):
    """Scores of the rows, by trying every cut of every column in every node."""
    from loomstone.llm.boosted_quality import BINS, LEAST_ROWS, RATE, RIDGE

    edges = [sorted(set(np.quantile(rows[:, k], np.linspace(0, 1, BINS)[1:-1], method="lower"))) for k in range(rows.shape[1])]
    raw = [float(np.log(labels.mean() / (1 - labels.mean())))] * len(rows)
    for _ in range(trees):
        p = [1 / (1 + np.exp(-x)) for x in raw]
        grad, hess = [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]
        nodes = [list(range(len(rows)))]
        for _ in range(depth):
            after = []
            for own in nodes:
                gain = lambda part: sum(grad[i] for i in part) ** 2 / (sum(hess[i] for i in part) + RIDGE)
                best = (1e-9, None)
                for k, cuts in enumerate(edges):
                    for cut in cuts:
                        left, right = [i for i in own if rows[i, k] <= cut], [i for i in own if rows[i, k] > cut]
                        if len(left) >= LEAST_ROWS and len(right) >= LEAST_ROWS and gain(left) + gain(right) - gain(own) > best[0] + 1e-12:
                            best = (gain(left) + gain(right) - gain(own), (left, right))
                after += best[1] or (own, [])
            nodes = after
        for own in nodes:
            value = RATE * sum(grad[i] for i in own) / (sum(hess[i] for i in own) + RIDGE)
            for i in own:
                raw[i] += value
    return 1 / (1 + np.exp(-np.array(raw)))


def test_trees_grow_as_by_hand():
    from loomstone.llm.boosted_quality import grow

    rng = np.random.default_rng(7)
    rows = np.column_stack([rng.standard_normal(130), rng.integers(0, 4, 130), np.zeros(130)]).round(3)
    labels = ((rows[:, 0] + 0.5 * rows[:, 1] + 0.3 * rng.standard_normal(130)) > 0.6).astype(float)
    got = grow(rows, labels, trees=4, depth=2).score(rows)
    assert np.allclose(got, grown_by_hand(rows, labels, 4, 2), atol=1e-9)


def test_statistics_are_what_they_are_called():
    from loomstone.llm.boosted_quality import NAMES, statistics

    text = "The cat sat. The cat sat!\nTWO # {x} words-here, and 42 more\nThe cat sat. The cat sat!\n\n" + "é" * 20
    own = dict(zip(NAMES, statistics([text.encode()])[0]))
    raw, words, lines = text.encode(), text.encode().split(), text.encode().split(b"\n")
    share = lambda chars: sum(raw.count(c.encode()) for c in chars) / len(raw)
    pairs = list(zip(words, words[1:]))
    want = {
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share("0123456789"), "line": share("\n"), "stop": share("."), "loud": share("!?"), "symbol": share("#$%&*^~`"), "tag": share("<>{}[]\\"), "joint": share("-_/:;=+@"), "wide": 40 / len(raw),
        "chars": np.log1p(len(raw)), "words": np.log1p(len(words)), "word_chars": np.mean([len(w) for w in words]), "word_long": np.mean([len(w) > 15 for w in words]), "word_short": np.mean([len(w) < 3 for w in words]), "word_distinct": len(set(words)) / len(words),
        "word_top": max(Counter(words).values()) / len(words), "pair_distinct": len(set(pairs)) / len(pairs), "word_repeat": sum(a == b for a, b in pairs) / len(words), "upper_words": sum(w.isupper() for w in words) / len(words), "lines": np.log1p(len(lines)),
        "line_chars": np.log1p(len(raw) / len(lines)), "line_distinct": len(set(lines)) / len(lines), "line_top": max(Counter(lines).values()) / len(lines), "line_ended": sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    }
    assert {k: round(own[k], 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}
    assert not statistics([None, b"", b" \n"])[0].any() and statistics([]).shape == (0, len(NAMES))


def test_quality_of_documents_without_labels(spark, tmp_path):
    from loomstone.llm.boosted_quality import op3_boosted_quality

    spark.createDataFrame([(1, "a text"), (2, None), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_boosted_quality(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
