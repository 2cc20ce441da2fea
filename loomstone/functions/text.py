"""Text expressions: normalisation, keys, truncation, extraction. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space (Unicode) collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def name_key(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column, most: int | None = None) -> Column:
    """``name_key`` with underscores, cut after ``most`` characters."""
    out = F.replace(name_key(c), F.lit(" "), F.lit("_"))
    return F.left(out, F.lit(most)) if most else out


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def truncated(c: Column, most: int, suffix: str, strip: bool = True) -> Column:
    """A longer text is cut to ``most`` characters, stripped at its end, and gets the suffix."""
    cut = F.left(c, F.lit(most))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(cut) if strip else cut, F.lit(suffix)))


def html_entities(c: Column) -> Column:
    """The four entities that labels carry, in this order."""
    for entity, plain in (("&nbsp;", " "), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def doi_found(c: Column) -> Column:
    """The first DOI in a text, lower-cased; null without one."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"10\.\d{4,9}/\S+", 0), F.lit(""))


def doi_stripped(c: Column) -> Column:
    """Lower case, without one leading resolver or scheme."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)", "")
    return F.trim(out)


def title_key(c: Column) -> Column:
    """Only a-z and 0-9; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))


def pmcid_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), "(?i)^PMC", ""))


def ingredient_name(c: Column) -> Column:
    """An active ingredient without its heading, parentheses and doses."""
    out = F.regexp_replace(c, r"(?i)^\s*active ingredients?\s*[:\-]?\s*", "")
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?i)\b\d+(\.\d+)?\s*(mg|mcg|g|ml|%|units?)\b", " ")
    return F.btrim(squeeze(out), F.lit(" ,;:-"))


def name_variants(c: Column) -> Column:
    """Sorted distinct keys of a name: whole, without parentheses, and what stands in them."""
    inside = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1)), name_key)
    keys = F.concat(F.array(name_key(c), name_key(F.regexp_replace(c, r"\([^)]*\)", " "))), inside)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: x != "")))


def tagged_blocks(c: Column, open_tag: str = "<<<FACTOID>>>", close_tag: str = "<<<END_FACTOID>>>") -> Column:
    """The trimmed texts between tags, across lines."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"(?s){open_tag}(.*?){close_tag}"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))


def split_blocks(c: Column) -> Column:
    """The non-empty texts between tags, or the whole text where there are none; an empty array for null or blank."""
    found = F.filter(F.transform(tagged_blocks(c), squeeze), lambda x: x != "")
    whole = F.filter(F.array(squeeze(c)), lambda x: x != "")
    return F.coalesce(F.when(F.size(found) > 0, found), whole)


def as_sentence(c: Column) -> Column:
    """A block without bullets, with a full stop where it ends without a mark; null if empty."""
    out = F.regexp_replace(squeeze(c), r"^[\s\-*•]+", "")
    return F.when(out == "", None).when(out.rlike("[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))


def pages(c: Column) -> Column:
    """Structs (page, content) between paired page markers; a text without any is page 1."""
    marker = r"(?s)<!-- PAGE (\d+) START -->(.*?)<!-- PAGE \1 END -->"
    found = F.zip_with(F.regexp_extract_all(c, F.lit(marker), F.lit(1)), F.regexp_extract_all(c, F.lit(marker), F.lit(2)), lambda n, t: F.struct(n.cast("int").alias("page"), F.trim(t).alias("content")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(1).alias("page"), F.trim(c).alias("content"))))


def header_fields(c: Column) -> Column:
    """The map of ``KEY: value`` lines above the first line of dashes."""
    head = F.regexp_replace(F.split_part(c, F.lit("\n---"), F.lit(1)), r"\r", "")
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))))


def header_body(c: Column) -> Column:
    return F.btrim(F.regexp_extract(c, r"(?s)\n-{3,}[^\n]*\n(.*)$", 1), F.lit(" \n\r\t"))


def prettified(c: Column) -> Column:
    return squeeze(F.translate(c, "_-", "  "))


def joined(separator: str, *parts: Column) -> Column:
    """Non-empty parts, joined; blanks and the literal None are left out."""
    return F.concat_ws(separator, *[F.nullif(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit("None")) for p in parts])


def yes_no(c: Column) -> Column:
    """true, false or null: the whole answer, else its first whole word YES or NO."""
    found = F.regexp_extract(F.upper(squeeze(c)), r"\b(YES|NO)\b", 1)
    return F.when(found == "YES", True).when(found == "NO", False)


def boolish(values: Column) -> Column:
    """'true', 'false' or '' of an array of words; true goes first."""
    all_words = F.array_join(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != ""), " ")
    return F.when(all_words.rlike(r"\b(true|yes|y|1|full)\b"), "true").when(all_words.rlike(r"\b(false|no|n|0|none)\b"), "false").otherwise("")


def year_in(c: Column) -> Column:
    """The first four digits that are a year from 1900 to 2100; null without any."""
    year = F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def leading_year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


def level_digit(c: Column) -> Column:
    """The first of 3, 4, 5 and 7 in an answer."""
    return F.nullif(F.regexp_extract(c, "[3457]", 0), F.lit("")).try_cast("int")


def contains_any(c: Column, parts: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(c, F.lit(part))
    return out


def data_url(c: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(c))


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
