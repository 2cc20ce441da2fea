"""JSON of any shape and depth as VARIANT: flattened to rows, and pruned by a tree of what to keep."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import write_and_read


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def leaves(df: DataFrame, key: str, value: str, *, joint: str = "_") -> DataFrame:
    """key, path, kind, text for every leaf of the objects in a VARIANT column, however deep.

    A path is the names of the objects above, joined. Lists are leaves, as JSON with the names of their
    objects in order; nulls, empty objects and what is no object at the top have no leaf. Each level is
    one pass over the objects of the level above it, which are written, so depth has no bound.
    """
    level = df.select(F.col(key).alias("key"), F.lit("").alias("above"), F.col(value).alias("v")).where(_kind(F.col("v")) == "OBJECT")
    out = None
    while True:
        inner = df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), F.col("value").alias("inner"))
        met = level.lateralJoin(inner).select("key", F.concat("above", "name").alias("path"), "inner", _kind(F.col("inner")).alias("kind"))
        text = F.when(F.col("kind") == "ARRAY", F.to_json("inner")).when(F.col("kind") != "OBJECT", F.try_variant_get("inner", "$", "string"))
        made = write_and_read(met.where("kind <> 'VOID'").select("key", "path", "kind", text.alias("text"), F.when(F.col("kind") == "OBJECT", F.col("inner")).alias("v")), "level")
        own = made.where("kind <> 'OBJECT'").select("key", "path", "kind", "text")
        out = own if out is None else out.union(own)
        level = made.where("kind = 'OBJECT'").select("key", F.concat("path", F.lit(joint)).alias("above"), "v")
        if not level.limit(1).count():
            return out.select(F.col("key").alias(key), "path", "kind", "text")


def flat_json(df: DataFrame, key: str, value: str, *, joint: str = "_") -> DataFrame:
    """key, flat: the leaves of each row's object as one map of texts, its keys in order."""
    own = leaves(df, key, value, joint=joint).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("e"))  # one object's
    return own.select(key, F.map_from_entries("e").alias("flat"))


#: What a tree says of a leaf: keep it as it is, or as a function of its text.
KEEP = None
Tree = Mapping[str, "Tree | Callable[[Column], Column] | None"]


def pruned(v: Column, tree: Tree, at: str = "$") -> Column:
    """A struct with the parts of a VARIANT that a tree names; what is missing is null.

    A name leads to a tree of names, to ``KEEP``, or to a function of the part's text (a clamp).
    """
    cells = []
    for name, below in tree.items():
        path = f"{at}['{name}']"
        if isinstance(below, Mapping):
            cell = pruned(v, below, path)
        elif below is KEEP:
            cell = F.try_variant_get(v, path, "variant")
        else:
            cell = below(F.try_variant_get(v, path, "string"))
        cells.append(cell.alias(name))
    return F.struct(*cells)


def pruned_json(v: Column, tree: Tree) -> Column:
    """The pruned parts as JSON, nulls included."""
    return F.to_json(pruned(v, tree), {"ignoreNullFields": "false"})
