"""Linkage of drug labels with application records by prioritised identifiers.

applications: application_number, sponsor_name, submissions (submission_status_date), products,
openfda (spl_set_id, spl_id, generic_name, brand_name, substance_name, …); labels: set_id, id, openfda, …
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nested import first_non_empty, first_string, latest

#: The methods of the rules in order: nested set id, the label's own, nested label id, the label's own, names.
RULES = ("matched_by_spl_set_id", "matched_by_spl_set_id", "matched_by_spl_id", "matched_by_spl_id", "matched_by_name_fallback")
# Sections of a label that are kept.
SECTIONS = (
    "effective_time", "indications_and_usage", "dosage_and_administration", "warnings", "warnings_and_cautions", "boxed_warning", "contraindications", "drug_interactions", "adverse_reactions", "pregnancy", "pregnancy_or_breast_feeding", "teratogenic_effects", "nursing_mothers", "breastfeeding", "pediatric_use", "geriatric_use",
    "renal_impairment", "hepatic_impairment", "use_in_specific_populations", "special_populations", "description", "clinical_pharmacology", "how_supplied", "package_label_principal_display_panel", "spl_product_data_elements", "active_ingredient", "inactive_ingredient", "purpose", "openfda", "set_id", "id", "version",
)


def _names(openfda: str) -> Column:
    parts = [F.coalesce(F.col(f"{openfda}.{n}"), F.array()) for n in ("generic_name", "brand_name", "substance_name")]
    return F.filter(F.array_distinct(F.transform(F.concat(*parts), text.name_key)), lambda x: x != "")


def _all_names(openfda: str, products: str) -> Column:
    """Names of an application: openfda's, its products' brands, and their active ingredients."""
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    brands = texts(F.transform(products, lambda p: p["brand_name"]))
    parts = texts(F.flatten(F.transform(products, lambda p: texts(F.transform(p["active_ingredients"], lambda i: i["name"])))))
    more = F.transform(F.array_compact(F.concat(brands, parts)), text.name_key)
    return F.filter(F.array_distinct(F.concat(_names(openfda), more)), lambda x: x != "")


def _listed(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array()), lambda x: F.trim(x) != "")


def unique_applications(apps: DataFrame, order: str) -> DataFrame:
    """The first of equal (application, sponsor, set ids, label ids), with app_id."""
    key = [F.coalesce("application_number", F.lit("")), F.coalesce("sponsor_name", F.lit("")), F.to_json(_listed("openfda.spl_set_id")), F.to_json(_listed("openfda.spl_id"))]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return apps.withColumn("_n", nth).where("_n = 1").drop("_n").withColumnRenamed(order, "app_id")


def _label_keys(labels: DataFrame, with_names: bool) -> DataFrame:
    one = lambda c: F.filter(F.array(F.trim(c)), lambda x: x != "")
    kinds = [_listed("openfda.spl_set_id"), one("set_id"), _listed("openfda.spl_id"), one("id")]
    if with_names:
        own = F.transform(F.coalesce("active_ingredient", F.array()), lambda x: text.name_key(text.ingredient_name(x)))
        kinds.append(F.filter(F.array_distinct(F.concat(_names("openfda"), own)), lambda x: x != ""))
    parts = [labels.select("label_id", F.lit(k).alias("rule"), F.posexplode(keys).alias("pos", "key")) for k, keys in enumerate(kinds)]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    space = F.when(F.col("rule") < 2, "set").when(F.col("rule") < 4, "label").otherwise("name")
    return out.withColumn("space", space)


def link(labels: DataFrame, apps: DataFrame, *, with_names: bool = False) -> DataFrame:
    """label_id, method, candidates, app_id of each label.

    A label's first id that the applications have decides, even if none of its candidates passes
    validation (they share the ids that the rule is about); that method then ends in
    ``_validation_failed``. Labels without such an id match by all of their names together; more than one
    candidate ends in ``_ambiguous``. Of valid candidates: prescription products first, then any products,
    then the latest submission, then the application number, then the first. ``candidates`` counts the
    valid ones, or all where none is valid.
    """
    has = apps.schema["products"].dataType.elementType.fieldNames()
    names = _all_names("openfda", "products") if {"brand_name", "active_ingredients"} <= set(has) else _names("openfda")
    rank = apps.select(
        "app_id", "application_number", _listed("openfda.spl_set_id").alias("set_ids"), _listed("openfda.spl_id").alias("label_ids"), names.alias("names"), F.coalesce(F.exists("products", lambda p: p["marketing_status"] == "Prescription"), F.lit(False)).alias("rx"),
        (F.coalesce(F.size("products"), F.lit(0)) > 0).alias("has_products"), latest(F.transform("submissions", lambda s: s["submission_status_date"])).alias("last_date"),
    )
    index = rank.select("app_id", F.lit("set").alias("space"), F.explode("set_ids").alias("key"))
    index = index.union(rank.select("app_id", F.lit("label"), F.explode("label_ids"))).union(rank.select("app_id", F.lit("name"), F.explode("names")))
    keys = _label_keys(labels, with_names)
    known = keys.join(index.select("space", "key").distinct(), ["space", "key"], "left_semi")
    first = F.first(F.struct("rule", "pos")).over(Window.partitionBy("label_id").orderBy("rule", "pos"))
    winner = known.withColumn("_first", first).where((F.col("rule") == F.col("_first.rule")) & ((F.col("space") == "name") | (F.col("pos") == F.col("_first.pos")))).drop("_first", "pos")
    nested = lambda c, top: F.when(F.size(_listed(c)) > 0, _listed(c)).otherwise(F.array(F.trim(F.coalesce(top, F.lit("")))))
    ids = labels.select("label_id", nested("openfda.spl_set_id", "set_id").alias("own_sets"), nested("openfda.spl_id", "id").alias("own_labels"))
    met = winner.join(index, ["space", "key"]).drop("key").distinct().join(rank, "app_id").join(ids, "label_id")
    valid = F.when(F.col("space") == "set", F.arrays_overlap("own_sets", "set_ids")).when(F.col("space") == "label", F.arrays_overlap("own_labels", "label_ids")).otherwise(F.lit(True))
    best = Window.partitionBy("label_id").orderBy(F.col("ok").desc(), F.col("rx").desc(), F.col("has_products").desc(), F.col("last_date").desc(), F.col("application_number").desc(), "app_id")
    own, count = Window.partitionBy("label_id"), F.count("*")
    met = met.withColumn("ok", F.coalesce(valid, F.lit(False))).withColumn("_n", F.row_number().over(best))
    met = met.withColumn("_ok", F.count_if("ok").over(own)).withColumn("candidates", F.when(F.col("_ok") > 0, F.col("_ok")).otherwise(count.over(own))).where("_n = 1")
    ending = F.when(~F.col("ok"), "_validation_failed").when((F.col("space") == "name") & (F.col("candidates") > 1), "_ambiguous").otherwise("")
    method = F.concat(F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1), ending)
    found = met.select("label_id", method.alias("method"), "candidates", F.when(F.col("ok"), F.col("app_id")).alias("app_id"))
    out = labels.select("label_id").join(found, "label_id", "left")
    return out.select("label_id", F.coalesce("method", F.lit("unmatched")).alias("method"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "app_id")


def merged(labels: DataFrame, apps: DataFrame, links: DataFrame) -> DataFrame:
    """label_id, status, method, candidates, metadata (null if unmatched), label (the kept sections)."""
    kept = [c for c in labels.columns if c in SECTIONS]
    first = F.try_element_at("products", F.lit(1))
    meta = F.struct(
        F.lit("FDA").alias("source_family"), F.col("l.set_id").alias("source_label_set_id"), F.col("l.id").alias("source_label_id"), F.col("a.application_number").alias("application_number"), F.col("a.sponsor_name").alias("sponsor_name"),
        first_non_empty(first["brand_name"], first_string(F.col("a.openfda.brand_name"))).alias("brand_name"), first_non_empty(first_string(F.col("a.openfda.generic_name")), first["brand_name"]).alias("generic_name"), F.coalesce(F.col("a.openfda.substance_name"), F.array()).alias("substance_names"), F.col("a.products").alias("products"),
    )
    met = labels.alias("l").join(links.alias("k"), "label_id").join(apps.alias("a"), F.col("k.app_id") == F.col("a.app_id"), "left")
    status = F.when(F.col("k.app_id").isNotNull(), "matched").otherwise("unmatched")
    return met.select("label_id", status.alias("status"), "k.method", "k.candidates", F.when(F.col("k.app_id").isNotNull(), meta).alias("metadata"), F.struct(*[F.col(f"l.{c}") for c in kept]).alias("label"))


def output_name(generic: Column, brand: Column, record_id: Column) -> Column:
    """A file name of name and id; equal names overwrite, so keep the last of each."""
    return F.concat_ws("_", text.slug(first_non_empty(generic, brand, F.lit("unknown")), 120), record_id)


# Sections that make up two curated fields, in order.
PREGNANCY = ("pregnancy", "pregnancy_or_breast_feeding", "breastfeeding", "nursing_mothers", "teratogenic_effects")
POPULATIONS = ("renal_impairment", "hepatic_impairment", "pediatric_use", "geriatric_use", "use_in_specific_populations", "special_populations")


def seed_records(rows: DataFrame, today: Column) -> DataFrame:
    """metadata, curated_fields of rows (csv: a map of a list's row; record: a merged record as VARIANT; file_name).

    Names come from the list first, then from the metadata, then from the label; brand names once each, as first written;
    sections of several parts with a blank line between them.
    """
    get = lambda path: F.try_variant_get("record", path, "string")

    def parts(path: str) -> Column:
        """A text, or the texts of a list, without blank ones."""
        listed = F.coalesce(F.try_variant_get("record", path, "array<string>"), F.array(get(path)))
        return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")

    first = lambda *paths: F.coalesce(*[F.try_element_at(parts(p), F.lit(1)) for p in paths], F.lit(""))
    section = lambda name: F.array_join(parts(f"$.label.{name}"), "\n\n")
    several = lambda names: F.array_join(F.filter(F.array(*[section(n) for n in names]), lambda x: x != ""), "\n\n")
    listed = lambda name: F.coalesce(F.try_element_at("csv", F.lit(name)), F.lit(""))
    brands = F.concat(parts("$.metadata.brand_name"), parts("$.label.openfda.brand_name"))
    keys = F.transform(brands, text.name_key)
    once = F.filter(brands, lambda x, i: F.array_position(keys, text.name_key(x)) == i + 1)
    generic = F.coalesce(F.nullif(F.trim(listed("generic_name")), F.lit("")), F.nullif(first("$.metadata.generic_name", "$.label.openfda.generic_name", "$.metadata.brand_name", "$.label.openfda.brand_name"), F.lit("")), F.lit(""))
    metadata = {
        "source_family": F.lit("FDA"), "source_format": F.lit("JSON"), "file_name": F.col("file_name"), "data_source": F.lit("FDA_label"), "last_updated": today.cast("string"), "reviewed": F.lit(False),
        "source_label_set_id": first("$.metadata.source_label_set_id", "$.label.set_id"), "source_label_id": first("$.metadata.source_label_id", "$.label.id"), "spl_id": first("$.metadata.spl_id", "$.label.openfda.spl_id"), "spl_set_id": first("$.metadata.spl_set_id", "$.label.openfda.spl_set_id"),
        "application_number": first("$.metadata.application_number", "$.label.openfda.application_number"), "manufacturer_name": first("$.metadata.manufacturer_name", "$.label.openfda.manufacturer_name"),
        "metadata_link_status": get("$.metadata_link_status"), "metadata_link_method": get("$.metadata_link_method"), "metadata_match_candidates": F.try_variant_get("record", "$.metadata_match_candidates", "int"),
    }
    curated = {
        "generic_name": generic, "brand_names": once, "drug_class": listed("drug_class"), "indications_and_usage": section("indications_and_usage"), "dosage_and_administration": section("dosage_and_administration"),
        "warnings": F.coalesce(F.nullif(section("warnings"), F.lit("")), section("warnings_and_cautions")), "black_box_warning": section("boxed_warning"), "pregnancy_or_breastfeeding": several(PREGNANCY), "adverse_reactions": section("adverse_reactions"),
        "special_populations": several(POPULATIONS), "contraindications": section("contraindications"), "drug_interactions": section("drug_interactions"), "label_date": first("$.metadata.effective_time", "$.label.effective_time"),
        "fda_bc_indication": listed("fda_bc_indication"), "ema_bc_indication": listed("ema_bc_indication"), "fda_ema_status": listed("fda_ema_status"), "use_type": listed("use_type"), "bc_notes": listed("notes"),
    }
    pack = lambda cells: F.struct(*[c.alias(n) for n, c in cells.items()])
    return rows.select(pack(metadata).alias("metadata"), pack(curated).alias("curated_fields"))
