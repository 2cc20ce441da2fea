"""Ordered rules: license labels, evidence levels, page and sentence filters. The first match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import boolish, contains_any, squeeze

# License labels and the texts that give them, in order.
LICENSE_TEXTS = (
    ("CC_BY_NC_ND_4_0", ("creativecommons.org/licenses/by-nc-nd/4.0", "cc by-nc-nd 4.0", "creative commons attribution-noncommercial-noderivs 4.0", "creative commons attribution-noncommercial-no derivatives 4.0")),
    ("CC_BY_NC_SA_4_0", ("creativecommons.org/licenses/by-nc-sa/4.0", "cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0")),
    ("CC_BY_ND_4_0", ("creativecommons.org/licenses/by-nd/4.0", "cc by-nd 4.0", "creative commons attribution-noderivs 4.0", "creative commons attribution-no derivatives 4.0")),
    ("CC_BY_SA_4_0", ("creativecommons.org/licenses/by-sa/4.0", "cc by-sa 4.0", "creative commons attribution-sharealike 4.0")),
    ("CC_BY_NC_4_0", ("creativecommons.org/licenses/by-nc/4.0", "cc by-nc 4.0", "creative commons attribution-noncommercial 4.0")),
    ("CC_BY_4_0", ("creativecommons.org/licenses/by/4.0", "cc by 4.0", "cc-by 4.0", "creative commons attribution 4.0", "licensed under a creative commons attribution 4.0 international license", "creative commons attribution license (cc by)")),
    ("CC_BY_NC_ND_3_0", ("creativecommons.org/licenses/by-nc-nd/3.0", "cc by-nc-nd 3.0")),
    ("CC_BY_NC_SA_3_0", ("creativecommons.org/licenses/by-nc-sa/3.0", "cc by-nc-sa 3.0")),
    ("CC_BY_ND_3_0", ("creativecommons.org/licenses/by-nd/3.0", "cc by-nd 3.0")),
    ("CC_BY_SA_3_0", ("creativecommons.org/licenses/by-sa/3.0", "cc by-sa 3.0")),
    ("CC_BY_NC_3_0", ("creativecommons.org/licenses/by-nc/3.0", "cc by-nc 3.0")),
    ("CC_BY_3_0", ("creativecommons.org/licenses/by/3.0", "cc by 3.0", "cc-by 3.0")),
    ("CC_BY_2_0", ("creativecommons.org/licenses/by/2.0", "cc by 2.0", "cc-by 2.0")),
    ("CC_BY_NC_SA_1_0", ("creativecommons.org/licenses/by-nc-sa/1.0", "cc by-nc-sa 1.0", "cc-by-nc-sa 1.0")),
    ("PUBLIC_DOMAIN_MARK_1_0", ("creativecommons.org/publicdomain/mark/1.0",)),
    ("CC0_1_0", ("creativecommons.org/publicdomain/zero/1.0", "cc0 1.0", "creative commons public domain dedication waiver")),
    ("CREATIVE_COMMONS_UNCLEAR", ("creative commons",)),
    ("OPEN_ACCESS_UNCLEAR", ("open access",)),
)
TEMPORARY_TEXTS = ("world health organization (who) declaration of covid-19 as a global pandemic", "duration of the covid-19 pandemic", "until permissions are revoked in writing")
# License families and the texts that give them, in order.
FAMILY_TEXTS = (
    ("CC_BY_NC_ND", ("creativecommons.org/licenses/by-nc-nd/", "cc by-nc-nd", "cc-by-nc-nd", "creative commons attribution-noncommercial-noderivs", "creative commons attribution-noncommercial-no derivatives", "creative commons attribution non-commercial no-derivatives", "creative commons attribution noncommercial noderivatives")),
    ("CC_BY_NC_SA", ("creativecommons.org/licenses/by-nc-sa/", "cc by-nc-sa", "cc-by-nc-sa", "creative commons attribution-noncommercial-sharealike", "creative commons attribution non-commercial sharealike")),
    ("CC_BY_ND", ("creativecommons.org/licenses/by-nd/", "cc by-nd", "cc-by-nd", "creative commons attribution-noderivs", "creative commons attribution-no derivatives", "creative commons attribution no-derivatives")),
    ("CC_BY_SA", ("creativecommons.org/licenses/by-sa/", "cc by-sa", "cc-by-sa", "creative commons attribution-sharealike")),
    ("CC_BY_NC", ("creativecommons.org/licenses/by-nc/", "cc by-nc", "cc-by-nc", "creative commons attribution-noncommercial", "creative commons attribution non-commercial")),
    ("CC_BY", ("creativecommons.org/licenses/by/", "cc by ", "cc-by ", "creative commons attribution license", "creative commons attribution 4.0", "creative commons attribution international license")),
)
# Versions, and the patterns that find one, in order.
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
VERSION_PATTERNS = (
    r"creativecommons\.org/licenses/by-nc-nd/(\d\.\d)", r"creativecommons\.org/licenses/by-nc-sa/(\d\.\d)", r"creativecommons\.org/licenses/by-nc/(\d\.\d)",
    r"creativecommons\.org/licenses/by-nd/(\d\.\d)", r"creativecommons\.org/licenses/by-sa/(\d\.\d)", r"creativecommons\.org/licenses/by/(\d\.\d)",
    r"\bcc[- ]by[- ]nc[- ]nd\s+(\d\.\d)\b", r"\bcc[- ]by[- ]nc[- ]sa\s+(\d\.\d)\b", r"\bcc[- ]by[- ]nc\s+(\d\.\d)\b",
    r"\bcc[- ]by[- ]nd\s+(\d\.\d)\b", r"\bcc[- ]by[- ]sa\s+(\d\.\d)\b", r"\bcc[- ]by\s+(\d\.\d)\b",
    r"creative commons attribution-noncommercial-noderivs\s+(\d\.\d)", r"creative commons attribution-noncommercial-no derivatives\s+(\d\.\d)",
    r"creative commons attribution-noncommercial-sharealike\s+(\d\.\d)", r"creative commons attribution-noncommercial\s+(\d\.\d)",
    r"creative commons attribution-no derivatives\s+(\d\.\d)", r"creative commons attribution-noderivs\s+(\d\.\d)",
    r"creative commons attribution-sharealike\s+(\d\.\d)", r"creative commons attribution\s+(\d\.\d)",
)
# Evidence levels, and those that a model may choose.
LEVELS = {
    1: "Guidelines",
    2: "Regulatory documents",
    3: "Systematic reviews and meta-analyses",
    4: "Randomized clinical trials",
    5: "Observational and registry studies",
    6: "Trial registry entries",
    7: "Narrative reviews, commentaries, case reports",
}
MODEL_LEVELS = (3, 4, 5, 7)
# Marks of pages without clinical content.
JUNK_MARKS = (
    "references",
    "acknowledgements",
    "acknowledgments",
    "disclosures",
    "disclosure",
    "funding",
    "author contributions",
    "conflicts of interest",
    "manuscript editing support",
)
# Patterns of sentences of low value.
LOW_VALUE = (
    r"ask a health professional before use",
    r"children younger than",
    r"does not list any boxed warning",
    r"does not list any contraindications",
    r"does not list any adverse reactions",
    r"does not list any drug interactions",
)


def first_match(c: Column, rules, otherwise) -> Column:
    """The label of the first rule any of whose texts the column contains."""
    return reduce(lambda rest, rule: F.when(contains_any(c, rule[1]), F.lit(rule[0])).otherwise(rest), reversed(rules), otherwise)


def article_license(text: Column) -> Column:
    """Label of a permissions text."""
    t = F.lower(text)
    label = first_match(t, LICENSE_TEXTS, F.lit("UNKNOWN"))
    any_sign = text.rlike("(?i)creative|cc[ -]by|cc0|open access")  # one pass over the texts that have none
    return F.when(~F.coalesce(any_sign, F.lit(False)), F.lit("UNKNOWN")).when(F.contains(t, F.lit("pmc open access subset")) & contains_any(t, TEMPORARY_TEXTS), F.lit("PMC_OPEN_ACCESS_TEMP")).otherwise(label)


def license_version(text: Column) -> Column:
    """The first supported version that a pattern finds, whatever family it stands with; else null."""
    found = [F.regexp_extract(F.lower(text), p, 1) for p in VERSION_PATTERNS]
    return F.coalesce(*[F.when(v.isin(*VERSIONS), v) for v in found])


def with_version(family: Column, version: Column) -> Column:
    return F.concat(family, F.lit("_"), F.coalesce(F.replace(version, F.lit("."), F.lit("_")), F.lit("UNSPECIFIED")))


def license_family(text: Column) -> Column:
    """Family with version; CREATIVE_COMMONS_UNCLEAR or '' without a family."""
    return _family_label(F.lower(text), first_match(F.lower(text), FAMILY_TEXTS, F.lit(None).cast("string")))


def _family_label(text: Column, family: Column) -> Column:
    """The same, of a text in lower case and the family that it names, if any."""
    unclear = F.when(contains_any(text, ("creativecommons.org/licenses/", "creative commons")), F.lit("CREATIVE_COMMONS_UNCLEAR")).otherwise(F.lit(""))
    return F.when(family.isNull(), unclear).otherwise(with_version(family, license_version(text)))


def publisher_labels(records: DataFrame, raw: str, user_texts: str, self_archiving: str, open_access: str, open_archive: str) -> DataFrame:
    """The records with ``label``, that of a publisher's record: columns of raw text and of arrays of its fields' values.

    The current open-access license goes before any other text, which counts for open articles alone;
    self-archiving terms come after the open-access flag. Texts, versions and families are made one after
    the other, each once; as one expression every rule would make its text again.
    """
    from_texts = {"own": F.array_join(user_texts, " "), "broad": F.col(raw), "kept": F.array_join(self_archiving, " ")}
    out = records.withColumns({"_text": F.lower(F.coalesce(F.col(raw), F.lit("")))} | {f"_{n}": F.lower(squeeze(F.coalesce(c, F.lit("")))) for n, c in from_texts.items()})
    out = out.withColumns({f"_{n}_family": first_match(F.col(f"_{n}"), FAMILY_TEXTS, F.lit(None).cast("string")) for n in from_texts} | {"_open": boolish(F.col(open_access)), "_archive": boolish(F.col(open_archive))})
    out = out.withColumns({f"_{n}": _family_label(F.col(f"_{n}"), F.col(f"_{n}_family")) for n in from_texts})
    text, own, broad, kept, is_open, archive = (F.col(f"_{n}") for n in ("text", "own", "broad", "kept", "open", "archive"))
    proprietary = contains_any(text, ("elsevier.com/open-access/userlicense", "elsevier user license", "userlicense/1.0"))
    closed = contains_any(text, ("all rights reserved", "all rights are reserved", "text and data mining", "ai training")) | (is_open == "false") | (archive == "false")
    label = (
        F.when(own != "", own)
        .when((broad != "") & (is_open == "true"), broad)
        .when(proprietary & ((is_open == "true") | F.contains(text, F.lit("open access"))), F.lit("ELSEVIER_USER_LICENSE"))
        .when(is_open == "true", F.lit("OPEN_ACCESS_LICENSE_UNSURE"))
        .when(kept != "", F.concat(F.lit("SELF_ARCHIVING_"), kept))
        .when(closed, F.lit("NO_OPEN_ACCESS"))
        .when((archive == "true") | F.contains(text, F.lit("open access")), F.lit("OPEN_ACCESS_LICENSE_UNSURE"))
        .otherwise(F.lit("NO_OPEN_ACCESS"))
    )
    return out.select(*records.columns, label.alias("label"))


def refined_license(label: Column, rule: Column, family: Column, text: Column) -> Column:
    """An unspecified label gets the version that its text has."""
    families = [f for f, _ in FAMILY_TEXTS]
    able = F.endswith(label, F.lit("_UNSPECIFIED")) & (rule == "CREATIVE_COMMONS_UNCLEAR") & F.upper(family).isin(*families) & (F.trim(text) != "")
    return F.when(able, with_version(F.upper(family), license_version(text))).otherwise(label)


def level_struct(level: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.when(level.isNotNull(), F.struct(level.alias("level"), F.try_element_at(names, level).alias("label")))


def is_reference_page(content: Column, marks: tuple[str, ...] = JUNK_MARKS, least_numbered: int = 8) -> Column:
    """Whether a page has any of the marks, or many numbered reference lines."""
    return contains_any(F.lower(content), marks) | (F.size(F.regexp_extract_all(content, F.lit(r"(?m)^\s*\d+\.\s"), F.lit(0))) >= least_numbered)


def is_low_value(sentence: Column, patterns: tuple[str, ...] = LOW_VALUE) -> Column:
    return sentence.rlike("(?i)(" + "|".join(patterns) + ")")


# What a page's text layer may have, and what begins a table.
LEAST_CHARS, MOST_LIGATURES, MOST_HYPHENS, SHORT_LINE, MOST_SHORT = 1000, 12, 18, 35, 0.55
LIGATURES, SOFT_HYPHEN, TABLE_LINE, CONTINUED = ("ﬁ", "ﬂ"), "­", r"(?im)^\s*table\s", "continued"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"


def text_quality(c: Column) -> Column:
    """char_count, line_count (non-blank), ligatures, soft_artifacts, hyphen_ends, short_line_ratio, weird_ratio of a text layer."""
    text = F.coalesce(c, F.lit(""))
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    times = lambda *marks: F.length(text) - F.length(F.translate(text, "".join(marks), ""))
    short = F.size(F.filter(lines, lambda x: F.length(x) < SHORT_LINE))
    ligatures, soft = times(*LIGATURES), times(SOFT_HYPHEN)
    return F.struct(
        F.length(text).alias("char_count"), F.size(lines).alias("line_count"), ligatures.alias("ligatures"), soft.alias("soft_artifacts"), F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("-")))).alias("hyphen_ends"),
        F.when(F.size(lines) > 0, short / F.size(lines)).otherwise(1.0).alias("short_line_ratio"), ((ligatures + soft) / F.greatest(F.length(text), F.lit(1))).alias("weird_ratio"),
    )


def is_continued_table(c: Column) -> Column:
    return F.rlike(c, F.lit(TABLE_LINE)) | F.contains(F.lower(c), F.lit(CONTINUED))


def is_usable_text(c: Column, quality: Column) -> Column:
    """Whether a page's own text layer will do, by its quality and as no table goes on in it."""
    good = (quality["char_count"] >= LEAST_CHARS) & (quality["ligatures"] <= MOST_LIGATURES) & (quality["hyphen_ends"] <= MOST_HYPHENS) & (quality["short_line_ratio"] <= MOST_SHORT)
    return F.coalesce(good & ~is_continued_table(c), F.lit(False))
