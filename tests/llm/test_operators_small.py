"""Each training-data operator on small tables: edge cases, brute force, round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import (
    boosted_quality, centroid_langid, chosen_path, host_trust, line_chunks, source_mixing, string_tiling, token_files, warc_archive, weighted_sampling,
)
from loomstone.llm import _graph
from loomstone.llm._shared import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h0 string"
WORDS = [f"w{k}" for k in range(400)]


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or ""), "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def rand_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "x " * 30_000), (5, "x " * 30_000), (7, "Same text here. And a second sentence.\n" * 3), (8, "Same text here. And a second sentence.\n" * 3), (None, "no id at all but some words in it"), (10, "\x00\x01 é ß İ 日本語 !!!")]


# --- op1
def test_warc_round_trip(spark):
    long = "<p>" + "z" * 200
    rows = [(1, "http://a/\n", long), (2, "http://b", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "v", long), (1, "http://a/", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc_archive.write_archives(pages, new_folder(spark, "warc"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc_archive.read_archives(files).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None)]
    assert [g[:3] for g in got] == want
    assert {g[4] for g in got} == {sha(long), sha("short"), sha(None)}
    assert Counter(bytes(r.payload) for r in warc_archive.read_archives(files).collect() if r.record_type == "response") == Counter([long.encode()] * 2 + [b"short"] * 2 + [b""])
    assert warc_archive.read_archives(warc_archive.write_archives(pages.limit(0), new_folder(spark, "warc"))).count() == 0


def test_warc_reader_rejects_broken_frames():
    good = warc_archive.make_record(1, "u", b"p" * 10, None, "2024-01-01T00:00:00Z", False)
    assert warc_archive.parse_record(good)["payload"] == b"p" * 10
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"pppp", b"pqpp"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc_archive.WarcError):
            warc_archive.parse_record(bad)


def test_other_records_pass_through():
    block = b"software: x\r\n"
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(block)
    got = warc_archive.parse_record(record + block + b"\r\n\r\n")
    assert (got["record_type"], got["payload"], got["payload_bytes"]) == ("warcinfo", block, len(block))
    with pytest.raises(warc_archive.WarcError):
        warc_archive.parse_record(record + block + b"more\r\n\r\n")


# --- op2
def test_tokens_equal_the_library_on_whole_texts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.default_tokenizer())
    docs = documents(spark, ODD + [(20, "don't I'LL it's, a<|endoftext|>b ...! 3.5 ﬁ Å x́")])
    files = token_files.write_tokens(docs, new_folder(spark, "tokens"), tokenizer=token_files.default_tokenizer(), length=64, rows=4)
    got = sorted(token_files.read_tokens(files).collect(), key=lambda r: (r.start))
    texts = sorted(((-1 if i is None else i), t or "") for i, t in ODD + [(20, "don't I'LL it's, a<|endoftext|>b ...! 3.5 ﬁ Å x́")])
    start = 0
    for row, (i, t) in zip(got, texts, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (-1 if row.doc_id is None else row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    first = token_files.SequenceFile(files.orderBy("part").first().file)
    assert first.ids(0).shape == (64,) and not first.ids(0).flags.owndata
    assert first.mask(0).true_count == 64 or len(first) == 1


def test_tokenizers_that_keep_white_space_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    made = Tokenizer(models.BPE({c: k for k, c in enumerate(alphabet)}, []))
    made.pre_tokenizer, made.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    made.save(str(tmp_path / "kept.json"))
    kept = token_files.WordEncoder(str(tmp_path / "kept.json"), "uint16")
    assert not kept.by_words and token_files.WordEncoder(token_files.default_tokenizer(), "uint16").by_words
    text = "two  words\nof é text "
    assert np.frombuffer(kept.encode(text.encode()), "uint16").tolist() == made.encode(text).ids


# --- op3
def test_trees_learn_and_score(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(800, 6))
    labels = ((rows[:, 1] > 0.2) ^ (rows[:, 3] > 0)).astype(float)
    model = boosted_quality.grow(rows, labels)
    assert ((model.score(rows) >= 0.5) == labels).mean() > 0.95
    slow = []
    for r in rows[:50]:
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(r[f[k]] > t[k])
            total += v[k - len(f)]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(rows[:50]), slow)
    assert boosted_quality.grow(np.zeros((0, 6)), np.zeros(0)).score(np.zeros((2, 6))).tolist() == [0.5, 0.5]
    measured = boosted_quality.document_statistics(documents(spark, ODD))
    labelled = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = boosted_quality.score(measured, boosted_quality.fit(measured, labelled)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


# --- op4
def brute_tiles(item, text, least):
    """The longest common run of free words again and again; the first in the item, then in the text, of equal ones."""
    free_i, free_t, out = [x >= 0 for x in item], [x >= 0 for x in text], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[2]:
                    best = (i, t, n)
        if best[2] < least:
            return out
        i, t, n = best
        free_i[i : i + n] = free_t[t : t + n] = [False] * n
        out.append(best)


def test_tiles_match_brute_force_and_reordering(spark):
    rng = random.Random(5)
    for k in range(200):
        item, text = ([rng.randrange(2 + k % 4) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        if k % 5 == 0:
            text[len(text) // 2] = -1
        assert string_tiling.greedy_tiles(item, text, 3) == brute_tiles(item, text, 3)
    assert string_tiling.greedy_tiles([1] * 1000, [1] * 1_000_000, 5) == [(0, 0, 1000)]
    assert string_tiling.greedy_tiles([1, 2] * 40 + [3], [1, 2] * 60_000, 5) == [(0, 0, 80)]
    passage = rand_text(rng, 30).split()
    moved = " ".join(passage[15:] + ["filler"] * 9 + passage[:15])
    docs = documents(spark, [*ODD, (50, "A " + " ".join(passage).upper() + "!"), (51, moved), (52, " ".join(passage[:9]))])
    bench = spark.createDataFrame([(9, " ".join(passage)), (10, None), (11, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in string_tiling.tile_matches(docs, bench).collect()}
    assert set(got) == {(50, 9), (51, 9)} and got[51, 9].tiles == 2
    short = spark.createDataFrame([(12, "Same text, here"), (13, "words in it"), (14, "text same")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in string_tiling.tile_matches(docs, short).collect()) == [(0, 13), (7, 12), (8, 12)]
    kept = string_tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted([i or 0 for i, _ in ODD] + [52])
    assert string_tiling.tile_matches(docs, bench.limit(0)).count() == 0


def test_tiles_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(string_tiling, "BLOCK_WORDS", 8)
    bench = spark.createDataFrame([(k, " ".join(f"b{k}{j}" for j in range(6))) for k in range(5)], "item_id long, text string")
    docs = documents(spark, [(k, "x " + " ".join(f"b{k}{j}" for j in range(6))) for k in range(5)])
    assert sorted((r.doc_id, r.item_id) for r in string_tiling.tile_matches(docs, bench).collect()) == [(k, k) for k in range(5)]
    assert string_tiling.drop_contaminated(docs, bench).count() == 0


# --- op5
def test_line_chunks(spark):
    rng = random.Random(2)
    shared = "".join(f"{rand_text(rng, 12)}. " for _ in range(12)) + "\n"
    own = ["".join(f"{rand_text(rng, 9)}. " for _ in range(8)) + "\n" for _ in range(6)]
    texts = [(61, own[0] + shared + own[1]), (62, own[2] + shared + own[3]), (63, own[4] + own[5]), (64, "all \x01 of \x02 the \x02a marks \x02b\x02. Here. "), *ODD]
    docs = documents(spark, texts)
    got = line_chunks.drop_repeated_chunks(docs).collect()
    first = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    assert first[61].text == texts[0][1] and first[63].text == texts[2][1] and first[64].text == texts[3][1]
    assert first[62].removed_chunks > 0 and len(first[62].text) < len(texts[1][1]) - len(shared) // 3
    assert first[62].text.startswith(own[2][:60]) and first[62].removed_chars == len(texts[1][1]) - len(first[62].text)
    assert {i: first[i].text for i, t in ODD if i in (1, 2, 3, 4, 10, None)} == {i: t for i, t in ODD if i in (1, 2, 3, 4, 10, None)}
    assert ODD[6][1].startswith(first[7].text) and first[8].text == ""
    assert line_chunks.drop_repeated_chunks(docs.limit(0)).count() == 0


@pytest.mark.parametrize("notice", ["All rights reserved by the owner.\nSee the licence for terms of use.", "Page one.\nEnd."])
def test_short_chunks_of_two_lines_go(spark, notice):
    docs = documents(spark, [(1, notice), (2, notice), (3, "\n\n"), (4, "\n\n")])
    got = {r.doc_id: r.text for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert got == {1: notice, 2: "", 3: "\n\n", 4: "\n\n"}


def test_passages_go_and_phrases_stay(spark):
    rng = random.Random(4)
    passage = "".join(f"{rand_text(rng, 8)}. " for _ in range(16))
    texts = [(k, f"{rand_text(rng, 40)}. {passage if k % 2 else rand_text(rng, 30) + '. As they say. '}{rand_text(rng, 40)}.") for k in range(12)]
    got = {r.doc_id: r for r in line_chunks.drop_repeated_chunks(documents(spark, texts)).collect()}
    assert all((got[k].removed_chars > len(passage) // 3) == (k % 2 == 1 and k > 1) for k in range(12))
    assert all(got[k].removed_chars == 0 for k in range(0, 12, 2))


def test_passages_without_sentences(spark):
    """Clauses cut what has no sentence end; one word over and over is cut by number, one endless word not at all."""
    rng = random.Random(5)
    passage = ", ".join(rand_text(rng, 7) for _ in range(20))
    texts = [(k, f"{rand_text(rng, 30)}, {passage}, {rand_text(rng, 30)}") for k in range(2)]
    texts += [(2, "de " * 200), (3, "de " * 140), (4, "x" * 1_000_000), (5, "x" * 999_999), (6, "de " * 20)]
    got = {r.doc_id: r for r in line_chunks.drop_repeated_chunks(documents(spark, texts)).collect()}
    assert got[0].removed_chars == 0 and got[1].removed_chars > len(passage) // 2
    assert [got[k].removed_chars for k in range(2, 7)] == [150 * 3, 100 * 3, 0, 0, 0]


@pytest.mark.parametrize("few", [0, 10**9])
def test_line_chunks_match_sql(spark, monkeypatch, few):
    """On odd texts, by joins and by broadcasts of repeated hashes."""
    monkeypatch.setattr(line_chunks, "BROADCAST_ROWS", few)
    monkeypatch.setattr(line_chunks, "HEAVY", 20)
    rng = random.Random(8)
    lines = [rand_text(rng, rng.randrange(1, 14)) + rng.choice([". ", "\n", "! ", " ", "。", ".\n\n"]) for _ in range(40)]
    texts = [None, "", " ", "\n", "a\x02\x01a b", "one " * 200, "one " * 300] + ["".join(rng.choice(lines) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = con.execute(line_chunks.OP5_SQL)
    names = [d[0] for d in out.description]
    want = sorted(out.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in line_chunks.drop_repeated_chunks(documents(spark, rows)).collect()) == want


# --- op6
def brute_components(texts, percent=85):
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = top(a), top(b)
                up[max(ra, rb)] = min(ra, rb)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(top(k), []).append(i)
    return {k: (len(sets[k]), min((i for i in groups[top(k)] if i is not None), default=None)) for k in range(len(texts))}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    if small:  # large nodes, large components and many rounds on a small table
        for name, value in (("LEAF", 6), ("UNIT", 8), ("LOOSE", 3), ("LEVELS", 2)):
            monkeypatch.setattr(chosen_path, name, value)
        monkeypatch.setattr(_graph, "LOCAL_EDGES", 0)
    rng = random.Random(11)
    texts, key = [], 0
    for size in (1, 2, 3, 12, 25):
        base = rand_text(rng, 90).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append((key, " ".join(words)))
            key += 1
    texts += [(key, texts[3][1]), (key + 1, texts[3][1].upper()), (key + 2, None), (key + 3, ""), (key + 4, "a b"), (key + 5, "A  b\n")]
    rng.shuffle(texts)
    want = brute_components(texts)
    got = {r.doc_id: r for r in chosen_path.near_duplicates(documents(spark, texts)).collect()}
    for k, (i, _) in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id) == (want[k][0], want[k][1] if want[k][0] else i)
        assert got[i].kept == (i == got[i].component_id)


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark, ODD)
    assert chosen_path.near_duplicates(docs).count() == len(ODD)
    kept = chosen_path.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 8 not in {r.doc_id for r in kept.collect()}
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_is_kept(spark):
    rng = random.Random(5)
    a, b, c, d = (rand_text(rng, 120) for _ in range(4))
    near = f"{c} more"
    docs = documents(spark, [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, near), (3, d), (3, d), (3, f"{d} more")])
    kept = [(r.doc_id, r.text) for r in chosen_path.drop_near_duplicates(docs).collect()]
    assert len(kept) == 4 and {(1, a), (2, b)} < set(kept)
    assert sorted(i == 3 for i, _ in kept) == [False, False, False, True] and {t for i, t in kept if i is None} < {c, near}


# --- op7
def brute_targets(sizes, times=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(times * sizes[s] for s in capped)
        share = sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in names if s not in capped and left / share * weight[s] > times * sizes[s]} if share else set()
        if not over:
            return {s: times * sizes[s] if s in capped else left / share * weight[s] for s in names}
        capped |= over


def test_mixing(spark):
    rng = random.Random(4)
    sources = {i: ("a", "B", "c", "é", None)[min(4, i % 7)] for i in range(300)}
    texts = [(i, rand_text(rng, rng.randrange(0, 3 if sources[i] == "c" else 200))) for i in range(300)]
    docs = spark.createDataFrame([(i, t or None, "en", sources[i], len(t), "x") for i, t in texts], DOCS)
    got = source_mixing.mix(docs, block_words=8).collect()
    sizes = Counter()
    for i, t in texts:
        sizes[sources[i]] += len(t.split())
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r.size == len(texts[r.doc_id][1].split()) and r.source_size == sizes[sources[r.doc_id]]
        assert abs(r.target - want[sources[r.doc_id]]) < 1e-6 and r.taken <= 3 * r.size
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 16 for s in sizes)
    again = source_mixing.mix(docs.repartition(3), block_words=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert source_mixing.mix(docs.limit(0)).count() == 0
    assert source_mixing.mixed_documents(docs).columns == docs.columns
    odd = source_mixing.mix(documents(spark, ODD)).collect()
    assert len(odd) == len(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000, 1024, 4099])
def test_permutation_is_one(spark, n):
    at = source_mixing.with_permuted(spark.range(n), "p", F.col("id"), F.lit(n), F.lit(3))
    got = [r.p for r in at.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n > 900:  # neighbours part, and another key gives another order
        assert np.mean(np.abs(np.diff(got)) > n / 20) > 0.8
        other = [r.p for r in source_mixing.with_permuted(spark.range(n), "p", F.col("id"), F.lit(n), F.lit(4)).orderBy("id").collect()]
        assert np.mean(np.array(got) == np.array(other)) < 0.02


@pytest.mark.parametrize("n", [(1 << 33) + 1, 1 << 40, (1 << 52) - 3])
def test_permutation_of_many_places(spark, n):
    at = source_mixing.with_permuted(spark.range(n - 20_000, n), "p", F.col("id"), F.lit(n), F.lit(3)).agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert 0 <= at[0] < n / 1000 and n - n / 1000 < at[1] < n and at[2] == 20_000


def test_shards_are_dealt_alike(spark):
    sources = spark.createDataFrame([(1, 50, 3000), (2, 10, 0), (3, 500, 1000)], "rank int, blocks long, quota long")
    got = source_mixing.draws(spark, sources, shard_slots=400).collect()
    by = {k: sorted((r.first, r.past) for r in got if r["rank"] == k) for k in (1, 3)}
    for k, quota in ((1, 3000), (3, 1000)):  # numbered without gaps up to the quota
        assert [a for a, _ in by[k]] == [0] + [b for _, b in by[k]][:-1] and by[k][-1][1] == quota
    shards = Counter()
    for r in got:
        shards[r.shard] += r.past - r.first
    assert set(shards.values()) == {400} and len(shards) == 10
    assert all(60 < r.past - r.first < 140 for r in got if r["rank"] == 3)


def test_mixing_of_repeated_rows(spark):
    rows = [(None, "a b c", "en", "s", 0, "x")] * 50 + [(k % 3, "d e", "en", "t", 0, "x") for k in range(60)]
    got = source_mixing.mix(spark.createDataFrame(rows, DOCS), block_words=4).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, len(t.split()), 150 if s == "s" else 120) for i, t, _, s, *_ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert abs(taken[150] - 90) <= 4 and abs(taken[120] - 180) <= 4  # weights 1 and 2 of 270 words


# --- op8
def test_language_id(spark):
    rng = random.Random(6)
    syllables = {"aa": "ba la ma na".split(), "zz": "kri zok tez vul".split()}
    texts, langs = [], {}
    for i in range(120):
        lang = "aa" if i % 2 else "zz"
        texts.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20))))
        langs[i] = lang
    docs = documents(spark, texts, langs)
    model = centroid_langid.fit(docs)
    got = {r.doc_id: r for r in centroid_langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == langs[i] for i in langs)
    odd = {r.doc_id: r for r in centroid_langid.identify(documents(spark, ODD), model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].rejected and odd[1].score == 0
    assert centroid_langid.drop_rejected(docs, model).count() >= 118
    empty = centroid_langid.fit(docs.limit(0))
    assert {r.lang_pred for r in centroid_langid.identify(docs, empty).collect()} == {"und"}


def test_language_model_matches_brute_force(spark):
    """Cosines of dictionaries of weights, not of hashed matrices; foreign texts are rejected at any length."""
    rng = random.Random(7)
    letters = {"en": "etaoinshrdlu", "it": "aeiolnrtscdu", "pl": "aioeznrwstcy"}
    word = lambda own: "".join(rng.choice(own) for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(word(letters[lang]) for _ in range(rng.randrange(1, 200))), lang) for k, lang in enumerate(("en", "it", "pl") * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = centroid_langid.fit(docs)
    texts = [t for _, t, _ in rows[:60]] + ["", None, "123"]
    found, scores, rejected = model.predict(texts)
    for text, lang, score in zip(texts, found, scores, strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        counts = centroid_langid._counts([text])[0][0]
        own = {int(d): float(np.log1p(np.float32(counts[d])) * model.idf[d]) for d in np.flatnonzero(counts)}
        size = sum(v * v for v in own.values()) ** 0.5
        best = {}
        for c, k in zip(model.centroids, model.owner, strict=True):
            best[model.languages[k]] = max(best.get(model.languages[k], -1.0), sum(v * float(c[d]) for d, v in own.items()) / size)
        top = max(best.values())
        assert abs(top - score) < 1e-4 and abs(best[lang] - top) < 1e-4
    assert rejected[:60].mean() < 0.05 and rejected[60:].all()
    foreign = [lambda n: "".join(chr(rng.randrange(0x3041, 0x3090)) for _ in range(n)), lambda n: "".join(rng.choice("бвгджзклмнпр") for _ in range(n)), lambda n: "".join(rng.choice("bfgjkmpqvx") for _ in range(n))]
    for make in foreign:
        for n in (20, 100, 1000):
            assert model.predict([make(n) for _ in range(20)])[2].mean() >= 0.95


# --- op9
def test_fingerprints(spark):
    rng = random.Random(8)
    texts = [(i, rand_text(rng, 60)) for i in range(40)] + [(100, None), (101, ""), (102, "word"), (103, texts_of(rng)), (104, None)]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in weighted_sampling.fingerprint_pairs(docs).collect()}
    weigh = lambda t: Counter(w for w in re.split(r"[\x20\x09-\x0d]+", t.lower()) if w)
    errors = []
    for k, (i, t) in enumerate(texts):
        t, follow = t or "", texts[(k + 1) % len(texts)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        a, b = weigh(t), weigh(edited)
        true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(rows[i].near_edited - true)
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.12
    assert rows[100].fingerprint == rows[101].fingerprint and rows[100].near_next == 1.0
    twice = weighted_sampling.fingerprint_pairs(documents(spark, [(1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 1
    assert weighted_sampling.fingerprint_pairs(docs.limit(0)).count() == 0


def texts_of(rng):
    return "Same Same same " + rand_text(rng, 5)


# --- op10
def test_urls(spark):
    rows = [(1, "http://A.Example.com/x", "<a href='//bad.net/fr/1'>"), (2, None, None), (3, "noscheme/x", ""), (4, "http://bad.net/fr/?q", "<a href=\"http://Q.org/a\">"), (5, "http://q.org/x", ""), (None, "http://example.com/en/#a", ""), (7, "http://www.example.com/en/a", ""), (8, "http://x.com", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in host_trust.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/x", "com/", "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("", "", None) and got[3].host == ""
    assert (got[4].rule, got[4].verdict, got[4].path) == ("net/fr/", "block", "/fr/")
    assert (got[None].rule, got[7].rule, got[8].rule) == ("example.com/en/", "www.example.com/en/", None)
    edges = {(r.src, r.dst) for r in host_trust.host_edges(pages).collect()}
    assert {("a.example.com", "bad.net"), ("bad.net", "q.org"), ("a.example.com", "example.com")} <= edges
    assert host_trust.judge(pages.limit(0)).count() == 0


def test_spread_is_personalised_pagerank(spark):
    pairs = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in host_trust.spread(edges, seeds).collect()}
    names = ["a", "b", "c"]
    w = np.eye(3)
    for s, d, x in pairs:
        w[names.index(s), names.index(d)] += x
    t, d, ts, ds = np.array([1.0, 0, 0]), np.array([0, 0, 1.0]), np.array([1.0, 0, 0]), np.array([0, 0, 1.0])
    for _ in range(host_trust.ROUNDS):
        t = 0.85 * t @ (w / w.sum(1, keepdims=True)) + 0.15 * ts
        d = 0.85 * d @ (w.T / w.T.sum(1, keepdims=True)) + 0.15 * ds
    for k, n in enumerate(names):
        assert np.allclose(got[n], (t[k], d[k]))


def test_distrust_reaches_all_of_a_long_chain(spark):
    n = 14  # each links to the one before; the first is blocked
    rows = [(k, f"http://h{k}.org/", f'<a href="http://h{k - 1}.org/">' if k else "") for k in range(n)] + [(n, "http://far.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in host_trust.judge(pages, (("h0.org", "/", "block"), ("far.net", "/", "allow"))).collect()}
    assert [got[k].verdict for k in range(n + 1)] == ["block"] * n + ["allow"]
    edges = spark.createDataFrame([(f"h{k}", f"h{k - 1}", 1.0) for k in range(1, n)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 0.0, 1.0), ("far", 1.0, 0.0)], "host string, trust double, distrust double")
    back = np.eye(n) + np.eye(n, k=1)
    want = np.linalg.solve(np.eye(n) - 0.85 * (back / back.sum(1, keepdims=True)).T, 0.15 * np.eye(n)[0])
    found = {r.host: r.distrust for r in host_trust.spread(edges, seeds).collect()}
    assert np.allclose([found[f"h{k}"] for k in range(n)], want, rtol=1e-8, atol=0)


@pytest.mark.parametrize("ids", ["unique", "shared", "null"])
def test_mixed_rows_reach_their_targets_whatever_their_ids(spark, ids):
    rng = random.Random(21)
    name = {"unique": lambda i: i, "shared": lambda i: 7, "null": lambda i: None}[ids]
    sizes, rows = Counter(), []
    for i in range(240):
        source = "big" if i % 8 else "small"
        text = "the same words in every row " * 8 if i % 3 == 0 else rand_text(rng, 48)
        rows.append((name(i), text, "en", source, i, "x", 1, None))
        sizes[source] += len(text.split())
    docs = spark.createDataFrame(rows, DOCS + ", key int, row string")
    got = source_mixing.mixed_documents(docs, block_words=8).collect()
    assert [c for c in docs.columns] == got[0].__fields__
    want, taken, times = brute_targets(dict(sizes)), Counter(), Counter(r.n_chars for r in got)
    for r in got:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 0.12 * want[s] for s in sizes) and max(times.values()) <= 3
    assert Counter(map(str, got)) == Counter(map(str, source_mixing.mixed_documents(docs.repartition(3), block_words=8).collect()))


def test_near_duplicates_go_whatever_columns_are_called(spark):
    words = " ".join(WORDS[:60])
    rows = [(1, words, 5, "a", 9), (2, words + " more", 6, "b", 8), (3, "quite another text of seven words", 7, "c", 7), (3, "quite another text of seven words", 7, "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, gone_th string, _th long")
    got = sorted(map(tuple, chosen_path.drop_near_duplicates(docs).collect()))
    assert got == [rows[0], rows[2]] and chosen_path.drop_near_duplicates(docs).columns == docs.columns


def test_every_language_is_learned_or_the_fit_fails(spark, monkeypatch):
    docs = documents(spark, [(i, f"{'abcdefg'[i % 7] * 3} word") for i in range(28)], langs={i: f"l{i % 7}" for i in range(28)})
    assert len(centroid_langid.fit(docs).languages) == 7
    monkeypatch.setattr(centroid_langid, "MOST_LANGUAGES", 6)
    with pytest.raises(ValueError, match="more than 6"):
        centroid_langid.fit(docs)


def test_verdicts_say_what_they_rest_on(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(1, "http://good.com/", link("friend.org")), (2, "http://friend.org/x", link("next.io")), (3, "http://next.io/", None), (4, "http://bad.net/es/", None), (5, "http://shady.org/", link("bad.net", "bad.net")), (6, "http://island.xyz/", None), (7, None, None), (8, "http://both.dev/", link("bad.net"))]
    pages = spark.createDataFrame(rows + [(9, "http://good.com/b", link("both.dev"))], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.reached) for r in host_trust.judge(pages).collect()}
    assert got == {1: ("allow", "rule"), 2: ("allow", "links"), 3: ("allow", "links"), 4: ("block", "rule"), 5: ("block", "links"), 6: ("allow", "nothing"), 7: ("allow", "nothing"), 8: (got[8][0], "links"), 9: ("allow", "rule")}
    scores = {r.page_id: (r.trust, r.distrust) for r in host_trust.judge(pages).collect()}
    assert got[8][0] == ("block" if scores[8][1] > scores[8][0] else "allow")
    lenient = {r.page_id: r.verdict for r in host_trust.judge(pages, margin=1e9).collect()}
    assert lenient[8] == "allow" and lenient[4] == "block"
