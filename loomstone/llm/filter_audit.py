"""Audit of how filters interact: what each removes after every order of those before it.

The orders of the filters form a trie. It is walked depth first: the state of a node is a persisted
DataFrame of the documents that all filters above it leave, and one job a state counts, by part, what
each filter still to come removes from it. What is left after some filters doesn't depend on their
order, so all nodes whose prefixes are the same set share one state (2 ** n of them for n filters, where
the trie has more than n! nodes), and a state is let go when the walk leaves it: at most n + 1 are held
at once. The counts of all edges are one narrow table, which the orders are then read off.

Filters judge a document on its own (or on what was computed table-wide before, as ``repeats`` does),
so they are evaluated once; a row of a state holds their verdicts, not the text.

Edge cases: a null text is an empty one, a null part is ''. A verdict that is null keeps the document, so
one without an id repeats nothing; an equal row under an equal id is no repeat either. Repeated rows are
separate documents. Several labels of a document count as one that says all they say. Texts of any
length are judged whole. An empty table gives no rows. Further columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_folder, stash, table

SPACE = r"[\x20\x09-\x0D]+"
#: Fewest words, least percentage of distinct words, largest percentage of capitals, and what no text holds.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def repeats(rows: DataFrame) -> DataFrame:
    """digest, first_id (the smallest) of the digests in rows (doc_id, digest) that stand under several ids."""
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return stash(found.where("last_id > first_id").select("digest", "first_id"), "repeats", narrow=True)


def text_verdicts(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text (not null) fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > CAPITAL_PERCENT * F.length(text),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def audit(docs: DataFrame, fails: Mapping[str, Column], *, part: Column, marks: Mapping[str, Column]) -> DataFrame:
    """part, state, filter, n, failing, removed, unique_fails and, for each mark, <mark>_lost of every edge.

    ``fails`` has for each filter, by a name of one letter, the condition to go; ``state`` has in
    alphabetical order the names of the filters before. n documents of the part reach the edge and
    ``removed`` go there; ``failing`` and ``unique_fails`` count all documents of the part that fail the
    filter, and that fail it alone. Parts that lose all documents stay in, with zeros.
    """
    spark = docs.sparkSession
    names = sorted(fails)
    one = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    flags = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *[one(c).alias(f"m_{m}") for m, c in marks.items()], *[one(fails[f]).alias(f"f_{f}") for f in names])
    flags = stash(flags, "verdicts", narrow=True)
    folder = new_folder(spark, "edges")

    def counted(rows: DataFrame, before: str) -> None:
        """Write the counts of the edges that leave a state."""
        left = [f for f in names if f not in before]
        lost = [F.count_if(F.col(f"f_{f}")).alias(f"removed_{f}") for f in left] + [F.count_if(F.col(f"f_{f}") & F.col(f"m_{m}")).alias(f"{m}_{f}") for f in left for m in marks]
        per = rows.groupBy("part").agg(F.count("*").alias("n"), *lost)
        edges = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"removed_{f}").alias("removed"), *[F.col(f"{m}_{f}").alias(f"{m}_lost") for m in marks]) for f in left])
        per.select("part", F.lit(before).alias("state"), "n", F.explode(edges).alias("e")).select("part", "state", "n", "e.*").coalesce(1 if before else 8).write.mode("append").parquet(folder)

    seen: set[str] = set()

    def walk(rows: DataFrame, before: str) -> None:
        held = rows.persist(StorageLevel.MEMORY_AND_DISK)
        counted(held, before)
        for f in names:
            after = "".join(sorted(before + f))
            if f not in before and after not in seen and len(after) < len(names):
                seen.add(after)
                walk(held.where(~F.col(f"f_{f}")).drop(f"f_{f}"), after)
        held.unpersist()

    walk(flags, "")
    edges = spark.read.parquet(folder)
    alone = lambda f: F.col(f"f_{f}") & ~F.greatest(F.lit(False), F.lit(False), *[F.col(f"f_{g}") for g in names if g != f])
    totals = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"failing_{f}").alias("failing"), F.col(f"unique_{f}").alias("unique_fails")) for f in names])
    whole = flags.groupBy("part").agg(*[F.count_if(F.col(f"f_{f}")).alias(f"failing_{f}") for f in names], *[F.count_if(alone(f)).alias(f"unique_{f}") for f in names])
    states = {"".join(sorted(o[:k])) for o in permutations(names) for k in range(len(names))}
    ends = F.filter(F.array(*[F.lit(s) for s in sorted(states)]), lambda s: ~F.contains(s, F.col("filter")))
    frame = whole.select("part", F.explode(totals).alias("t")).select("part", "t.*").withColumn("state", F.explode(ends))
    out = frame.join(edges, ["part", "state", "filter"], "left")
    return out.select("part", "state", "filter", "failing", "unique_fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "removed", *[f"{m}_lost" for m in marks])])


def orders(edges: DataFrame, names: list[str]) -> DataFrame:
    """The edges of ``audit`` read off along every order: part, filter_order, step, the counts, shapley.

    ``shapley`` sums what the filter removes over all orders, at whatever step it stands.
    """
    edges = stash(edges, "audit", narrow=True)
    before = F.length("state")
    weights = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), (before + 1).cast("int"))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weights).alias("shapley"))
    steps = [(o[k], "".join(sorted(o[:k])), "".join(o), k + 1) for o in permutations(sorted(names)) for k in range(len(names))]
    steps = edges.sparkSession.createDataFrame(steps, "filter string, state string, filter_order string, step int")  # n! * n rows, whatever the input
    lost = [c for c in edges.columns if c.endswith("_lost")]
    counts = [(F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"]
    return edges.join(F.broadcast(steps), ["filter", "state"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *counts)


def quality_marks(labels: DataFrame) -> DataFrame:
    """id, good, toxic: whether any label of a document says so."""
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.unhex(F.sha2(text, 256)).alias("digest"), F.struct(*[c.alias(n) for n, c in text_verdicts(text).items()]).alias("fails"))
    rows = stash(rows, "judged", narrow=True)
    rows = rows.join(repeats(rows), "digest", "left").join(quality_marks(table(spark, sf_dir, "labels")), F.col("doc_id") == F.col("id"), "left")
    fails = {n: F.col(f"fails.{n}") for n in "ABCD"} | {"E": F.col("first_id") < F.col("doc_id")}
    edges = audit(rows, fails, part=F.col("source"), marks={"good": F.col("good"), "toxic": F.col("toxic")})
    return orders(edges, list("ABCDE"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP12_SQL = f"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.replace('(t,', "(coalesce(text, ''),")} AS w FROM documents),
 v AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
   CAST(len(w) < {LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > {CAPITAL_PERCENT} * length(t) AS INT)
   + 8 * CAST(regexp_matches(t, '{MARKS}') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS m FROM t LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM v GROUP BY 1, 2),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 s AS (SELECT o, step, substr(o, step, 1) AS f, 1 << (ascii(substr(o, step, 1)) - 65) AS bit,
   coalesce(list_sum(list_transform(string_split(substr(o, 1, step - 1), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 r AS (SELECT part, o AS filter_order, step, f, coalesce(sum(n) FILTER (WHERE m & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0) AS removed,
   coalesce(sum(n) FILTER (WHERE m & before <> 0 AND m & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE m = bit), 0) AS unique_fails,
   coalesce(sum(good) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE m & before = 0 AND m & bit <> 0), 0) AS toxic_lost FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
