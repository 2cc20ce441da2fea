"""Metadata of documents and records from file names, headers, links and JSON, as expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import squeeze, truncated

# The order of a seed record's metadata fields and of its curated ones; the last are long texts.
SEED_METADATA = ("application_number", "manufacturer_name", "source_label_set_id", "source_label_id", "spl_id", "spl_set_id", "last_updated", "data_source", "source_family", "source_format", "metadata_link_status", "metadata_link_method")
SEED_FIELDS = ("drug_class", "label_date", "fda_bc_indication", "ema_bc_indication", "fda_ema_status", "use_type", "bc_notes")
SEED_TEXTS = (
    "indications_and_usage", "dosage_and_administration", "warnings", "black_box_warning", "pregnancy_or_breastfeeding", "adverse_reactions", "special_populations", "contraindications", "drug_interactions",
)
# The lines of a displayed factoid.
DISPLAY_LINES = {
    "Generic name": "generic_name",
    "Brand name": "brand_name",
    "Drug class": "drug_class",
    "FDA BC indication": "fda_bc_indication",
    "EMA BC indication": "ema_bc_indication",
    "FDA EMA status": "fda_ema_status",
    "Use type": "use_type",
    "BC notes": "bc_notes",
    "Label date": "label_date",
    "Application number": "application_number",
    "Manufacturer name": "manufacturer_name",
}
PRODUCT_FIELDS = ("product_number", "brand_name", "dosage_form", "route", "marketing_status", "reference_drug", "reference_standard", "te_code", "active_ingredients")


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def html_text(c: Column) -> Column:
    """All entities resolved, no-break spaces as spaces, white space collapsed; only texts with an ampersand leave the JVM."""
    escaped = F.when(F.contains(c, F.lit("&")), c)
    return squeeze(F.translate(F.coalesce(F.pandas_udf(_unescape, "string")(escaped), c), " ", " "))


def scopus_id(c: Column) -> Column:
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("SCOPUS_ID:"), F.lit("")))


def next_link(header: Column) -> Column:
    """The target of a Link header's next page; null without one."""
    return F.nullif(F.regexp_extract(header, r'<([^>]+)>\s*;\s*rel="next"', 1), F.lit(""))


def repaired_link(url: Column, query: str, count: int) -> Column:
    """A next-page link with its query and count put back where they are missing or empty."""
    out = url
    for name, value in (("query", F.url_encode(F.lit(query))), ("count", F.lit(str(count)))):
        has = F.coalesce(F.regexp_extract(F.regexp_extract(out, r"\?([^#]*)", 1), rf"(?:^|&){name}=([^&]+)", 1), F.lit("")) != ""
        bare = F.regexp_replace(out, rf"(?<=[?&]){name}=(?:&|$)", "")
        joint = F.when(~F.contains(bare, F.lit("?")), "?").when(F.rlike(bare, F.lit("[?&]$")), "").otherwise("&")
        out = F.when(has, out).otherwise(F.concat(bare, joint, F.lit(f"{name}="), value))
    return out


def dataset_key(path: Column) -> Column:
    """A file's name without its ending, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def stem_metadata(stem: Column) -> Column:
    """year and title of a guideline file named PREFIX_year_number_title[_REF]."""
    year = F.regexp_extract(stem, r"_(\d{4})[A-Z]?_", 1).try_cast("int")
    title = F.trim(F.translate(F.regexp_replace(F.regexp_replace(stem, r"^AGO_\d{4}[A-Z]?_\d+_", ""), r"_REF$", ""), "_", " "))
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), F.translate(stem, "_", " ")).alias("title"), year.alias("year"))


def document_type(title: Column, source: Column) -> Column:
    joined = F.lower(F.concat_ws(" ", title, source))
    has = lambda word: F.contains(joined, F.lit(word))
    return F.when(has("consensus"), "Consensus Statement").when(has("living"), "Living Guideline Update").when(has("guideline"), "Guideline").otherwise("ESMO Breast Cancer Document")


def header_metadata(markdown: Column, stem: Column) -> Column:
    """title, type, year, source and family of a Markdown document from its header lines, else from its file's name."""
    quoted = lambda name: F.nullif(F.trim(F.regexp_extract(markdown, rf"(?m)^{name}:\s*`([^`]+)`", 1)), F.lit(""))
    source, heading = quoted("Source PDF"), F.nullif(squeeze(F.regexp_extract(markdown, r"(?m)^\s*#\s+(.+?)\s*$", 1)), F.lit(""))
    source_stem = F.regexp_replace(source, r"(?<=.)\.[^.]*$", "")
    title = F.coalesce(heading, squeeze(F.translate(F.coalesce(source_stem, stem), "_-", "  ")))
    year = F.coalesce(*[F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int") for c in (stem, source_stem)])
    return F.struct(title.alias("title"), document_type(title, source).alias("type"), year.alias("year"), source.alias("source"), F.coalesce(quoted("Document family"), F.lit("ESMO")).alias("family"))


def trial_metadata(study: Column, stem: Column) -> Column:
    """title and year of a trial's JSON: official title, else its id, else the file; the first date that begins with a year."""
    get = lambda *path: F.nullif(F.get_json_object(study, "$.protocolSection." + ".".join(path)), F.lit(""))
    dates = ("studyFirstPostDateStruct", "lastUpdatePostDateStruct", "startDateStruct", "completionDateStruct")
    years = [F.regexp_extract(F.trim(get("statusModule", d, "date")), r"^(\d{4})", 1).try_cast("int") for d in dates]
    return F.struct(F.coalesce(get("identificationModule", "officialTitle"), get("identificationModule", "nctId"), stem).alias("title"), F.coalesce(*years).alias("year"))


def seed_summary(record: Column, number: Column, most: int = 4000, curated: str = "curated_fields") -> Column:
    """A seed record's JSON as one flat struct of 35 fields: its number, names, metadata, curated fields (under the key
    ``curated``), and long texts cut to ``most``; without a file name it is named after its number."""

    def at(path: str) -> Column:
        return F.get_json_object(record, path)

    def first(path: str) -> Column:  # a list gives its first non-blank text
        raw = at(path)
        listed = F.try_element_at(F.filter(F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw), "array<string>"), lambda x: F.trim(x) != ""), F.lit(1))
        return F.trim(F.coalesce(F.when(~F.startswith(F.ltrim(raw), F.lit("[")), raw), listed, F.lit("")))

    own = [first(f"$.{curated}.{n}").alias(n) for n in SEED_FIELDS]
    texts = [truncated(squeeze(first(f"$.{curated}.{n}")), most, " ...[truncated]").alias(n) for n in SEED_TEXTS]
    meta = [first(f"$.metadata.{n}").alias(n) for n in SEED_METADATA]
    file_name = F.coalesce(F.nullif(first("$.metadata.file_name"), F.lit("")), F.concat(F.lit("record_"), number.cast("string"), F.lit(".json")))
    brands = F.coalesce(F.from_json(at(f"$.{curated}.brand_names"), "array<string>"), F.array().cast("array<string>"))
    names = [file_name.alias("file_name"), first(f"$.{curated}.generic_name").alias("generic_name"), first(f"$.{curated}.brand_names").alias("brand_name"), brands.alias("brand_names")]
    count = F.coalesce(at("$.metadata.metadata_match_candidates").try_cast("int"), F.lit(0)).alias("metadata_match_candidates")
    return F.struct(number.alias("record_index"), *names, *meta, *own, *texts, at("$.metadata.reviewed").try_cast("boolean").alias("reviewed"), count)


def display_text(fields: dict[str, Column], factoid: Column) -> Column:
    """A factoid under the lines of its drug."""
    lines = [F.concat(F.lit(f"{label}: "), F.trim(F.coalesce(fields.get(name, F.lit("")), F.lit("")))) for label, name in DISPLAY_LINES.items()]
    return F.trim(F.concat_ws("\n", *lines, F.lit(""), F.concat(F.lit("Factoid: "), squeeze(F.coalesce(factoid, F.lit(""))))))


def product_summary(products: Column) -> Column:
    """Products with their nine fields; null entries go."""
    return F.transform(F.array_compact(products), lambda p: F.struct(*[p[n].alias(n) for n in PRODUCT_FIELDS]))


def distinct_names(df: DataFrame, group: str, name: str, order: str, key: Column) -> DataFrame:
    """The first of names that are alike after normalisation, as written."""
    nth = F.row_number().over(Window.partitionBy(group, "_key").orderBy(order))
    return df.withColumn("_key", key).where("_key <> ''").withColumn("_n", nth).where("_n = 1").select(group, name)
