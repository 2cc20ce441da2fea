"""One schema for records of several data sets, by tables of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import html_entities, squeeze

# Columns of the common record, and for each data set the fields that fill them, in order.
COMMON = ("entity_name", "active_substance", "therapeutic_indication", "therapeutic_area", "status", "holder", "ema_number", "procedure_number", "regulatory_outcome", "classification", "url", "extra_context")
FIELDS: dict[str, dict[str, tuple[str, ...]]] = {
    "medicines": {
        "entity_name": ("name", "name_of_medicine"), "active_substance": ("active_substance", "international_non_proprietary_name_inn_or_common_name", "international_non_proprietary_name_common_name"), "therapeutic_indication": ("therapeutic_indication",), "therapeutic_area": ("therapeutic_area_mesh",),
        "status": ("authorisation_status", "status", "medicine_status", "opinion_status"), "holder": ("marketing_authorisation_holder", "marketing_authorisation_developer_applicant_holder"), "ema_number": ("ema_number", "ema_medicine_number", "ema_product_number"), "classification": ("pharmacotherapeutic_group_human", "atc_code_human"), "url": ("medicine_url",),
    },
    "dhpcs": {
        "entity_name": ("name_of_medicine",), "active_substance": ("active_substances",), "therapeutic_area": ("therapeutic_area_mesh",), "status": ("dhpc_type",), "procedure_number": ("procedure_number",), "regulatory_outcome": ("regulatory_outcome",),
        "classification": ("category", "atc_code_human"), "url": ("dhpc_url",), "extra_context": ("referral_name", "other_related_medicines_nationally_authorised"),
    },
    "post_authorisation": {
        "entity_name": ("name_of_medicine",), "active_substance": ("active_substance", "international_non_proprietary_name_common_name"), "therapeutic_area": ("therapeutic_area_mesh",), "status": ("post_authorisation_procedure_status", "post_authorisation_opinion_status"),
        "holder": ("marketing_authorisation_developer_applicant_holder",), "ema_number": ("ema_product_number",), "classification": ("atc_code_human", "category"), "url": ("medicine_url",),
    },
    "psusas": {
        "entity_name": ("related_medicines", "active_substances_in_scope_of_procedure", "active_substance"), "active_substance": ("active_substance", "active_substances_in_scope_of_procedure"), "status": ("regulatory_outcome",), "procedure_number": ("procedure_number",), "classification": ("category",), "url": ("psusa_url",),
    },
    "referrals": {
        "entity_name": ("referral_name", "associated_names_centrally_authorised_medicines", "associated_names_non_centrally_authorised_medicines"), "active_substance": ("international_non_proprietary_name_inn_common_name",), "status": ("current_status",), "procedure_number": ("reference_number",),
        "regulatory_outcome": ("prac_recommendation",), "classification": ("referral_type", "class", "authorisation_model"), "url": ("referral_url",),
    },
    "shortages": {
        "entity_name": ("name_of_medicine", "medicine_name", "name"), "active_substance": ("active_substance", "active_substances", "international_non_proprietary_name_common_name"), "therapeutic_area": ("therapeutic_area_mesh",), "status": ("current_status", "shortage_status", "status"),
        "procedure_number": ("procedure_number",), "classification": ("category", "atc_code_human"), "url": ("shortage_url", "medicine_url"),
    },
}
# Data sets whose extra context is all of these fields, joined by blanks.
EXTRA = {
    "post_authorisation": ("orphan_medicine", "conditional_approval", "advanced_therapy", "biosimilar"),
    "referrals": ("safety_referral", "associated_names_centrally_authorised_medicines", "associated_names_non_centrally_authorised_medicines"),
    "shortages": ("reason", "other_related_medicines_nationally_authorised"),
}
# The fields that any other data set is searched for.
FALLBACK = {
    "entity_name": ("name", "name_of_medicine", "referral_name"), "active_substance": ("active_substance", "active_substances", "international_non_proprietary_name_common_name", "international_non_proprietary_name_inn_common_name"), "therapeutic_indication": ("therapeutic_indication",), "therapeutic_area": ("therapeutic_area_mesh",),
    "status": ("status", "current_status"), "holder": ("marketing_authorisation_holder",), "ema_number": ("ema_number", "ema_product_number"), "procedure_number": ("procedure_number", "reference_number"), "regulatory_outcome": ("regulatory_outcome",), "classification": ("category", "class"), "url": ("url", "medicine_url", "referral_url"),
}
# Columns of what a factoid's prompt is made of. For each data set, fields of the summary, then, after "/", fields of the record.
CONTEXT = ("entity_name", "active_substance", "therapeutic_indication", "therapeutic_area", "classification", "status", "opinion_status", "holder", "ema_number", "procedure_number", "regulatory_outcome", "first_published_date", "last_updated_date", "marketing_authorisation_date", "url", "extra_context")
CONTEXT_FIELDS: dict[str, dict[str, str]] = {
    "medicines": {
        "entity_name": "entity_name name / name_of_medicine name", "active_substance": "active_substance / active_substance international_non_proprietary_name_common_name", "therapeutic_indication": "therapeutic_indication / therapeutic_indication", "therapeutic_area": "therapeutic_area / therapeutic_area_mesh",
        "classification": "classification / pharmacotherapeutic_group_human atc_code_human", "status": "/ medicine_status", "opinion_status": "/ opinion_status", "holder": "/ marketing_authorisation_developer_applicant_holder", "ema_number": "/ ema_product_number", "marketing_authorisation_date": "/ marketing_authorisation_date", "url": "/ medicine_url",
    },
    "dhpcs": {
        "entity_name": "entity_name / name_of_medicine", "active_substance": "active_substance / active_substances", "therapeutic_area": "therapeutic_area / therapeutic_area_mesh", "classification": "classification / atc_code_human dhpc_type", "status": "status / dhpc_type", "procedure_number": "/ procedure_number",
        "regulatory_outcome": "/ regulatory_outcome", "url": "/ dhpc_url", "extra_context": "extra_context referral_name /",
    },
    "post_authorisation": {
        "entity_name": "entity_name / name_of_medicine", "active_substance": "active_substance / active_substance international_non_proprietary_name_common_name", "therapeutic_area": "therapeutic_area / therapeutic_area_mesh", "classification": "classification / atc_code_human", "status": "/ post_authorisation_procedure_status",
        "opinion_status": "/ post_authorisation_opinion_status", "holder": "/ marketing_authorisation_developer_applicant_holder", "ema_number": "/ ema_product_number", "marketing_authorisation_date": "/ marketing_authorisation_date", "url": "/ medicine_url",
    },
    "psusas": {
        "entity_name": "entity_name / active_substances_in_scope_of_procedure active_substance", "active_substance": "active_substance / active_substance", "classification": "classification category /", "status": "status / regulatory_outcome", "procedure_number": "/ procedure_number", "regulatory_outcome": "/ regulatory_outcome",
        "url": "/ psusa_url", "extra_context": "/ related_medicines",
    },
    "referrals": {
        "entity_name": "entity_name / referral_name", "active_substance": "active_substance / international_non_proprietary_name_inn_common_name", "classification": "classification / referral_type", "status": "status / current_status", "procedure_number": "/ reference_number", "url": "/ referral_url",
        "extra_context": "/ associated_names_centrally_authorised_medicines associated_names_non_centrally_authorised_medicines",
    },
    "shortages": {
        "entity_name": "entity_name / medicine_affected", "active_substance": "active_substance / international_non_proprietary_name_inn_or_common_name", "therapeutic_area": "/ therapeutic_area_mesh", "classification": "classification category /", "status": "/ supply_shortage_status", "url": "/ shortage_url",
    },
}
DATES = ("first_published_date", "last_updated_date")
ALTERNATIVES = "Alternatives available: "


def _field(record: Column, name: str) -> Column:
    """A field of a VARIANT record as text; a list as its parts joined by blanks; null if empty."""
    parts = F.try_variant_get(record, f"$.{name}", "array<string>")
    return F.nullif(squeeze(F.coalesce(F.array_join(parts, " "), F.try_variant_get(record, f"$.{name}", "string"))), F.lit(""))


def common_record(df: DataFrame, record: str, dataset: str) -> DataFrame:
    """Adds dataset_key and COMMON from a VARIANT column; '' where a record has nothing."""
    table = FIELDS.get(dataset, FALLBACK)
    filled = {name: F.coalesce(*[_field(F.col(record), f) for f in table.get(name, ())], F.lit("")) for name in COMMON}
    if dataset in EXTRA:
        filled["extra_context"] = F.concat_ws(" ", *[_field(F.col(record), f) for f in EXTRA[dataset]])
    return df.select("*", F.lit(dataset).alias("dataset_key"), *[c.alias(name) for name, c in filled.items()])


def context_record(df: DataFrame, summary: str, record: str, dataset: str) -> DataFrame:
    """Adds CONTEXT from two VARIANT columns, the summary's fields before the record's; '' where neither has any.

    A null or other value than an object has no fields. An unknown data set is a KeyError.
    """
    plain = lambda c, f: F.nullif(squeeze(html_entities(_field(F.col(c), f))), F.lit(""))
    table = CONTEXT_FIELDS[dataset] | {d: f"/ {d}" for d in DATES}
    filled = {}
    for name in CONTEXT:
        before, _, after = table.get(name, "/").partition("/")
        filled[name] = F.coalesce(*[plain(summary, f) for f in before.split()], *[plain(record, f) for f in after.split()], F.lit(""))
    if dataset == "shortages":
        affected = [plain(record, f"{kind}_affected") for kind in ("pharmaceutical_forms", "strengths")]
        filled["extra_context"] = F.concat_ws(" ", *affected, F.concat(F.lit(ALTERNATIVES), plain(record, "availability_of_alternatives")))
    return df.select("*", *[c.alias(name) for name, c in filled.items()])


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def latest_year(df: DataFrame, fields: list[str], default: int) -> Column:
    """The largest year from 1900 to 2100 that the fields' first four digits (a word of their own) give."""
    years = [F.regexp_extract(F.coalesce(f, F.lit("")), r"\b(\d{4})\b", 1).try_cast("int") for f in fields]
    return F.coalesce(F.max(F.greatest(*[F.when(y.between(1900, 2100), y) for y in years], F.lit(None).cast("int"))), F.lit(default))
