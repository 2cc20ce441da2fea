"""From documents of factoids (VARIANT: metadata, factoids) to the rows of a vector collection.

A row is a factoid with a text: id (the file's stem and the factoid's own id), document (the text), embedding_text
(what is embedded: fields of the document before the text), metadata (a flat map of texts). Documents come as
rows (file_name, doc); file names are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from ..functions.nested import first_non_empty, pick

# The fields before the text in what is embedded.
LITERATURE_METADATA = ("source_family", "document_title", "document_type", "document_year", "journal", "publication_year", "pmcid", "pmid", "doi", "title")
LITERATURE_ITEM = ("section", "section_title", "factoid_type", "topic")
GUIDELINE_METADATA = ("source_family", "document_title", "document_type", "document_year")


def _said(v: Column) -> Column:
    """A scalar's text, or a list or object as JSON with sorted names; null for what says nothing."""
    kind = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    text = F.when(kind.isin("ARRAY", "OBJECT"), F.nullif(F.nullif(F.to_json(v), F.lit("[]")), F.lit("{}"))).otherwise(F.trim(F.try_variant_get(v, "$", "string")))
    return F.nullif(text, F.lit(""))


def _map(v: Column) -> Column:
    """An object as a map of its names to what they say; empty for anything else."""
    said = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: _said(x))
    return F.coalesce(F.map_filter(said, lambda k, x: x.isNotNull()), F.create_map().cast("map<string,string>"))


def _joined(*values: Column) -> Column:
    """Values with a bar between them; empty ones and the word None are left out."""
    return F.concat_ws(" | ", *[F.when(~v.isin("", "None"), v) for v in values])


def _get(m: str, *names: str) -> list[Column]:
    return [F.try_element_at(F.col(m), F.lit(n)) for n in names]


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _items(docs: DataFrame) -> DataFrame:
    """file_name, pos, m (the document's metadata as a map), item (a factoid as a map), text."""
    each = docs.select("file_name", _map(F.try_variant_get("doc", "$.metadata", "variant")).alias("m"), F.posexplode(F.try_variant_get("doc", "$.factoids", "array<variant>")).alias("pos", "v"))
    text = _said(F.try_variant_get("v", "$.factoid_text", "variant"))
    told = each.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))).where(text.isNotNull())  # before the map is made
    return told.select("file_name", "pos", "m", _map(F.col("v")).alias("item"), text.alias("text"))


def literature_rows(docs: DataFrame, *, family: str = "EPMC") -> DataFrame:
    """id, document, embedding_text, metadata: fields that a retriever reads under their own names (whatever their case in
    the document), all of the document's as doc_…, all of the factoid's as factoid_….

    A factoid without an id is numbered by its place. The factoid's own id stands under factoid_id, as a factoid's
    field comes after the others of the same name.
    """
    own = _items(docs).withColumn("name", F.coalesce(*_get("m", "file_name"), F.col("file_name"))).withColumn("fid", F.coalesce(*_get("item", "id"), (F.col("pos") + 1).cast("string")))
    own = own.withColumn("row_id", F.concat_ws("_", _stem(F.col("name")), "fid"))
    read = {
        "factoid_id": F.when(~F.map_contains_key("item", F.lit("id")), F.col("row_id")), "source_json": F.col("file_name"), "source_family": F.coalesce(pick(F.col("m"), "source_family"), F.lit(family)), "document_title": pick(F.col("m"), "document_title", "title"), "document_type": pick(F.col("m"), "document_type"),
        "document_year": pick(F.col("m"), "document_year", "year", "publication_year"), "file_name": F.col("name"), "doi": pick(F.col("m"), "doi"), "source_pdf_name": pick(F.col("m"), "source_pdf_name"),
    }
    named = F.map_filter(F.create_map(*[x for k, c in read.items() for x in (F.lit(k), c)]), lambda k, x: x.isNotNull())
    doc = F.transform_keys("m", lambda k, x: F.concat(F.lit("doc_"), k))
    item = F.transform_keys(F.map_filter("item", lambda k, x: k != "factoid_text"), lambda k, x: F.concat(F.lit("factoid_"), k))
    made = F.map_concat(named, doc, item)  # a factoid's own id apart, their names differ by what they begin with
    return own.select(F.col("row_id").alias("id"), F.col("text").alias("document"), _joined(*_get("m", *LITERATURE_METADATA), *_get("item", *LITERATURE_ITEM), F.col("text")).alias("embedding_text"), made.alias("metadata"))


def guideline_rows(docs: DataFrame) -> DataFrame:
    """id, document, embedding_text, metadata: the document's flattened to any depth, factoid_id and local_id.

    Factoids without an id (or with 0) are left out.
    """
    own = _items(docs).withColumn("fid", F.nullif(F.col("item").getItem("id"), F.lit("0"))).where("fid is not null")
    row_id = F.concat_ws("_", _stem(first_non_empty(*_get("m", "file_name"), F.lit("unknown"))), "fid")
    flat = variants.flat_json(docs.select("file_name", F.try_variant_get("doc", "$.metadata", "variant").alias("meta")), "file_name", "meta")
    met = own.join(flat, "file_name", "left")
    named = F.create_map(F.lit("factoid_id"), row_id, F.lit("local_id"), F.col("fid"))
    kept = F.map_filter(F.coalesce("flat", F.create_map().cast("map<string,string>")), lambda k, x: ~k.isin("factoid_id", "local_id"))
    return met.select(row_id.alias("id"), F.col("text").alias("document"), _joined(*_get("m", *GUIDELINE_METADATA), F.col("text")).alias("embedding_text"), F.map_concat(kept, named).alias("metadata"))
