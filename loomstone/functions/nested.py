"""Nested values: first non-empty, scalar or list, flattening by schema, field updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def first_string(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: F.trim(x) != ""), F.lit(1))


def as_list(c: Column, is_array: bool) -> Column:
    """An array column as it is (null: empty), a scalar as a list of one."""
    return F.coalesce(c, F.array()) if is_array else F.when(c.isNotNull(), F.array(c)).otherwise(F.array())


def pick(m: Column, *keys: str) -> Column:
    """The first non-empty value of a map under any of the keys, whatever their case."""
    low = F.transform_keys(m, lambda k, v: F.lower(k))
    return first_non_empty(*[F.try_element_at(low, F.lit(k.lower())) for k in keys])


def flatten(df: DataFrame, column: str, arrays: str = "json", prefix: str = "") -> list[Column]:
    """Columns a_b_c of a struct's leaves; arrays as JSON or joined by ' | '."""
    out: list[Column] = []

    def walk(kind: T.DataType, path: str, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", f"{name}_{f.name}" if name else f.name)
        elif isinstance(kind, T.ArrayType):
            out.append((F.to_json(path) if arrays == "json" else F.array_join(F.transform(path, lambda x: x.cast("string")), " | ")).alias(name))
        else:
            out.append(F.col(path).cast("string").alias(name))

    walk(df.schema[column].dataType, column, prefix)
    return out


def drop_field(c: str, field: str) -> Column:
    return F.col(c).dropFields(field)


def set_field(c: str, field: str, value: Column) -> Column:
    return F.col(c).withField(field, value)


def latest(values: Column) -> Column:
    """The largest string of an array, '' without any."""
    return F.coalesce(F.array_max(values), F.lit(""))
