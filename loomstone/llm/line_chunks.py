"""Line deduplication by content-defined chunks of lines.

A text is cut into lines, and lines after the ends of sentences and clauses, so that a passage inside a
long line is found as well. Each such part is hashed once, and a rolling hash over the hashes of two
parts stands at each; a chunk ends where it is less than both of its neighbours. So boundaries depend
on nearby parts alone and come back after text has been inserted or taken away, and a chunk has two
parts or more. Chunks of more than ``LONG_CHARS`` characters, which have next to no such ends (one word
over and over), are cut after each ``LONG_WORDS`` words.

Chunks that occur more than once in the corpus are removed everywhere but at their first place, if they
have two lines or sentences, however short, or two clauses and ``CLAUSE_WORDS`` words, or
``LONG_WORDS`` words.

Chunks are told apart by their bytes: hashes only choose the candidates. Chunks of white space alone
stay, as they only part lines. Hashes are counted with partial aggregation; hashes with more than one
in ``HEAVY`` of all occurrences (so fewer than ``HEAVY`` of them) are broadcast, and the others are
joined. Whether a chunk is at its first place is asked by place, so no task gathers the places of one
chunk. Documents move once, into a table bucketed by document, where they meet the chunks that they
lose without an exchange. All of it is DataFrame operations.

Edge cases: null and empty texts are kept as they are. The order of places is doc_id (null first), the
text's hash, place in the text; rows that repeat all of it share what happens to them. Texts may hold
any character; the ``MARKS`` that part chunks while they are computed are escaped. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let_go, stash
from .snapshot_diff import _bucketed

LONG_WORDS, LONG_CHARS, CLAUSE_WORDS, HEAVY = 50, 400, 8, 1000
#: Repeated hashes that are broadcast, at most; more of them are joined.
BROADCAST_ROWS = 500_000
#: The first parts units while they are computed and is escaped in texts, with the second.
MARKS = ("\x01", "\x02")
LINE_END, PART_END = "(\n|[.!?] |[。！？])", "(\n|[.!?,;:] |[。！？，、；：])"
#: What PART_END matches, one by one: none lies within another, so replacing each in turn is as good as the pattern.
PART_ENDS = ("\n", *(f"{c} " for c in ".!?,;:"), *"。！？，、；：")
_TWO_LINES, _TWO_PARTS = LINE_END + "(?s:.)", PART_END + "(?s:.)"
_WORD = r"[^\x20\x09-\x0D]+"
#: Some words and what follows them. It matches at every word's start, so that no place is tried twice.
_WORDS = f"((?:{_WORD}[\\x20\\x09-\\x0D]*){{1,{LONG_WORDS}}})"
#: Factor and prime modulus of the rolling hash; 48 bits of a part's hash times the factor stay a long.
_FACTOR, _PRIME = 31, (1 << 31) - 1
_LEAST_ID = -(1 << 63)


def _lows(rows: DataFrame, parts: str) -> DataFrame:
    """Adds ``low``: whether the rolling hash over two parts is less than both neighbours'.

    Each step uses the last one's columns several times, so that the optimizer keeps them apart and no
    array is computed twice.
    """
    less = F.greatest(F.size(parts) - 1, F.lit(0))
    before, none = (lambda c: F.slice(c, 1, less)), F.array(F.lit(-1).cast("long"))
    rows = rows.select("*", F.transform(parts, lambda x: F.conv(F.substring(F.md5(x), 1, 12), 16, 10).cast("long")).alias("hashed"))
    rows = rows.select("*", F.zip_with(F.concat(F.array(F.lit(0).cast("long")), before("hashed")), "hashed", lambda a, b: (a * _FACTOR + b) % _PRIME).alias("roll"))
    down = F.zip_with(F.concat(none, before("roll")), "roll", lambda a, b: b < a)
    up = F.zip_with("roll", F.concat(F.slice("roll", F.lit(2), less), none), lambda a, b: a < b)
    return rows.select("*", F.zip_with(down, up, lambda a, b: a & b).alias("low")).drop("hashed", "roll")


def _plain(c: Column | str) -> Column:
    """The text itself again, from its escaped form without marks."""
    return F.replace(F.replace(c, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))


def split_documents(docs: DataFrame, *, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, dk, th, chunks (escaped; joined they are the text), hs of each row.

    hs has the hash of each chunk that may be removed and null for the others, so that later steps
    read no text for them.
    """
    escaped = F.replace(F.replace("text", F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    for end in PART_ENDS:
        escaped = F.replace(escaped, F.lit(end), F.lit(f"{end}\x01"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("dk"), F.xxhash64("text").alias("th"), F.split(escaped, "\x01").alias("parts"))
    marked = F.array_join(F.zip_with("parts", "low", lambda x, end: F.when(end, F.concat(x, F.lit("\x01"))).otherwise(x)), "")
    rows = _lows(rows, "parts").select("doc_id", "dk", "th", F.split(marked, "\x01").alias("chunks"))
    is_long = lambda c: F.length(c) > LONG_CHARS
    cut = F.transform("chunks", lambda c: F.when(is_long(c), F.rtrim(F.regexp_replace(c, _WORDS, "$1\x01"), F.lit("\x01"))).otherwise(c))
    cut = F.when(F.exists("chunks", is_long), F.split(F.array_join(cut, "\x01"), "\x01")).otherwise(F.col("chunks"))
    rows = rows.select("doc_id", "dk", "th", cut.alias("chunks"))
    return rows.select("*", F.transform("chunks", lambda c: F.when(_able(c, long_words), F.xxhash64(c))).alias("hs"))


def _able(chunk: Column, long_words: int) -> Column:
    """A word and two lines, or two clauses and some words, or many words."""
    words = F.regexp_count(chunk, F.lit(_WORD))
    enough = words >= F.when(F.rlike(chunk, F.lit(_TWO_PARTS)), min(CLAUSE_WORDS, long_words)).otherwise(long_words)
    return F.rlike(chunk, F.lit(_WORD)) & (F.rlike(chunk, F.lit(_TWO_LINES)) | enough)


def _repeated(parts: DataFrame) -> DataFrame:
    """dk, th, pos, chunk of the chunks whose hash occurs more than once."""
    each = parts.select("dk", "th", F.posexplode("hs").alias("pos", "h")).where("h IS NOT NULL")
    hashes = stash(each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    if hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        with_text = parts.select("dk", "th", F.posexplode(F.arrays_zip("hs", "chunks")).alias("pos", "c")).where("c.hs IS NOT NULL")
        return with_text.select("dk", "th", "pos", F.col("c.hs").alias("h"), F.col("c.chunks").alias("chunk")).join(F.broadcast(hashes.select("h")), "h", "left_semi").drop("h")
    # hashes move with their places alone, then to the buckets of their documents
    all_times = hashes.agg(F.sum("times")).first()[0]
    heavy, light = (hashes.where(c).select("h") for c in (F.col("times") * HEAVY > all_times, F.col("times") * HEAVY <= all_times))
    met = each.join(F.broadcast(heavy), "h", "left_semi").unionByName(each.join(F.broadcast(heavy), "h", "left_anti").join(light, "h", "left_semi"))
    wanted = met.groupBy("dk", "th").agg(F.collect_set("pos").alias("ks"))  # of one document
    found = parts.join(wanted, ["dk", "th"]).select("dk", "th", F.explode("ks").alias("pos"), "chunks")
    return found.select("dk", "th", "pos", F.get("chunks", F.col("pos")).alias("chunk"))


def repeated_places(parts: DataFrame) -> DataFrame:
    """dk, th, pos of every chunk that repeats an earlier one."""
    again = stash(_repeated(parts), "again")
    let_go(parts.sparkSession)
    first = again.groupBy("chunk").agg(F.min(F.struct("dk", "th", "pos")).alias("first")).select("first.*")
    return again.select("dk", "th", "pos").join(first, ["dk", "th", "pos"], "left_anti").distinct()


def drop_repeated_chunks(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text without repeated chunks, chunks, removed_chunks, removed_chars of each row."""
    parts = _bucketed(split_documents(docs, **options), "chunks", "dk", "th")
    gone = repeated_places(parts).groupBy("dk", "th").agg(F.collect_list("pos").alias("gone"))  # of one document
    met = parts.join(gone, ["dk", "th"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("chunks", "")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("chunks", i)), ""))
    met = met.select("doc_id", _plain(text).alias("text"), F.length(_plain(F.array_join("chunks", ""))).alias("chars"), *[F.coalesce(F.size(c), F.lit(0)).alias(n) for c, n in (("chunks", "chunks"), ("gone", "removed_chunks"))])
    return met.select("doc_id", "text", "chunks", "removed_chunks", F.coalesce(F.col("chars") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a'), '{PART_END}', '\\1' || chr(1), 'g'), chr(1)) AS u FROM documents WHERE text IS NOT NULL),
 d_each AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM d),
 d_hash AS (SELECT *, CAST('0x' || substr(md5(x), 1, 12) AS BIGINT) AS h FROM d_each),
 d_roll AS (SELECT *, (lag(h, 1, 0) OVER w * {_FACTOR} + h) % {_PRIME} AS roll FROM d_hash WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 d_low AS (SELECT *, roll < lag(roll, 1, -1) OVER w AND roll < lead(roll, 1, -1) OVER w AS low FROM d_roll WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 q AS (SELECT doc_id, x, i, coalesce(sum(CAST(low AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM d_low),
 joined AS (SELECT doc_id, c, string_agg(x, '' ORDER BY i) AS t FROM q GROUP BY 1, 2),
 cut AS (SELECT doc_id, c, CASE WHEN length(t) > {LONG_CHARS} THEN string_split(rtrim(regexp_replace(t, '{_WORDS}', '\\1' || chr(1), 'g'), chr(1)), chr(1)) ELSE [t] END AS ts FROM joined),
 whole AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c, k) AS c, t FROM (SELECT doc_id, c, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM cut)),
 able AS (SELECT * FROM whole WHERE regexp_matches(t, '{_WORD}') AND (regexp_matches(t, '{LINE_END}(?s:.)')
  OR len(regexp_extract_all(t, '{_WORD}')) >= CASE WHEN regexp_matches(t, '{PART_END}(?s:.)') THEN {CLAUSE_WORDS} ELSE {LONG_WORDS} END)),
 gone AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, c) AS k FROM able) WHERE k > 1),
 made AS (SELECT whole.doc_id, coalesce(string_agg(CASE WHEN gone.c IS NULL THEN t END, '' ORDER BY whole.c), '') AS t, string_agg(t, '' ORDER BY whole.c) AS old, count(*) AS chunks, count(gone.c) AS removed FROM whole LEFT JOIN gone ON gone.doc_id = whole.doc_id AND gone.c = whole.c GROUP BY 1),
 plain AS (SELECT doc_id, replace(replace(t, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2)) AS t, replace(replace(old, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2)) AS old, chunks, removed FROM made)
SELECT documents.doc_id, t AS text, CAST(coalesce(chunks, 0) AS INTEGER) AS chunks, CAST(coalesce(removed, 0) AS INTEGER) AS removed_chunks, CAST(coalesce(length(old) - length(t), 0) AS BIGINT) AS removed_chars
FROM documents LEFT JOIN plain ON plain.doc_id = documents.doc_id
"""
