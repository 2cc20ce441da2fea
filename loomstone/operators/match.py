"""Record linkage: build sides, prioritised cascades, variants, substring candidates, best of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, name_variants
from .patterns import found_in


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; ties need a last term that is unique."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(at)).where("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_one(df, keys, [F.col(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_one(df, keys, [F.col(c).desc() for c in order])


def lookup(probe: DataFrame, build: DataFrame, key: str, order: str, first: bool = True) -> DataFrame:
    """Left join to one build row per key; ``matched`` says whether there was one. Null keys never match."""
    one = (keep_first if first else keep_last)(build.where(F.col(key).isNotNull()), [key], order)
    return probe.join(one.withColumn("_hit", F.lit(True)), key, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_of_keys(probe: DataFrame, builds: list[tuple[str, DataFrame, str, str]], value: str) -> DataFrame:
    """Probe rows with the value of the first build that has their key, and its name in ``match_type``.

    builds: (name, build, probe key, build key) in order; a build has a row per key at most.
    """
    values, names = [], []
    for n, (name, build, own, theirs) in enumerate(builds):
        side = build.select(F.col(theirs).alias(f"_k{n}"), F.col(value).alias(f"_v{n}"))
        probe = probe.join(side, F.col(own) == F.col(f"_k{n}"), "left")
        values.append(F.col(f"_v{n}"))
        names.append(F.when(F.col(f"_v{n}").isNotNull(), F.lit(name)))
    out = probe.withColumn(value, F.coalesce(*values)).withColumn("match_type", F.coalesce(*names, F.lit("none")))
    return out.drop(*[f"_{c}{n}" for n in range(len(builds)) for c in "kv"])


def cascade(probe_keys: DataFrame, build_keys: DataFrame, valid: Column, rank: list[Column]) -> DataFrame:
    """Prioritised match on tagged keys.

    probe_keys: (probe_id, rule, pos, key …); build_keys: (key, build_id …). A probe's first key, by rule
    then pos, that the build has decides; later keys aren't tried. Of its candidates those that are
    ``valid`` are ranked. Result: probe_id, rule, candidates, build_id (null where none is valid).
    """
    indexed = build_keys.select("key").distinct()
    by = Window.partitionBy("probe_id").orderBy("rule", "pos", "key")
    winner = probe_keys.join(indexed, "key", "left_semi").withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")
    met = winner.join(build_keys, "key").withColumn("_valid", valid)
    best = Window.partitionBy("probe_id").orderBy(F.col("_valid").desc(), *rank)
    met = met.withColumn("_n", F.row_number().over(best)).withColumn("candidates", F.count("*").over(Window.partitionBy("probe_id")))
    return met.where("_n = 1").select("probe_id", "rule", "candidates", F.when(F.col("_valid"), F.col("build_id")).alias("build_id"))


def substring_candidates(queries: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """query_id, name_id, score: the ``most`` names that hold most of a query's tokens as substrings.

    All tokens of the queries (query_id, token) are searched in each name (name_id, name) at once; a
    record may have several names, the best of which counts. Only tokens found meet their queries.
    """
    tokens = queries.select("query_id", "token").where("token <> ''").distinct()
    keyed = names.select(F.struct("name_id", "name").alias("id"), F.col("name").alias("text")).distinct()
    hits = found_in(keyed, tokens.select(F.col("token").alias("pattern"))).withColumnRenamed("pattern", "token")
    scored = hits.join(tokens, "token").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    best = scored.groupBy("query_id", F.col("id.name_id").alias("name_id")).agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name_id")  # the plan keeps so many of a query before they move
    return best.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= most).drop("_n")


def name_tokens(df: DataFrame, id_col: str, name: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """query_id, token: the words of a name's variants and of the synonyms that its key has."""
    known = {k: v for k, v in (synonyms or {}).items() if v}
    variants = name_variants(F.col(name))
    if known:
        more = F.create_map(*[x for k, v in known.items() for x in (name_key(F.lit(k)), F.transform(F.array(*[F.lit(s) for s in v]), name_key))])
        variants = F.concat(variants, F.coalesce(F.try_element_at(more, name_key(F.col(name))), F.array().cast("array<string>")))
    words = F.flatten(F.transform(variants, lambda v: F.split(v, " ")))
    return df.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(words)).alias("token")).where("token <> ''").distinct()


def best_of(df: DataFrame, group: list[str], rank: list[Column]) -> DataFrame:
    return keep_one(df, group, rank)
