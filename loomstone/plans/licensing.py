"""License analysis of articles, with a model's answer for what the rules leave unclear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .hooks import apply

UNCLEAR = "CREATIVE_COMMONS_UNCLEAR"


def analyse(articles: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds rule_label, license_label and license_label_source to rows with license_text.

    Only unclear texts go to the model, each different one once. Its answer is a license family, the
    first one that it names; the version comes from the text.
    """
    rows = articles.withColumn("rule_label", F.when(F.coalesce("license_text", F.lit("")) != "", rules.article_license(F.col("license_text"))))
    label = F.coalesce("rule_label", F.lit("NO_LICENSE_TEXT"))
    if model is None:
        return rows.withColumn("license_label", label).withColumn("license_label_source", F.lit("rule"))
    unclear = F.coalesce(F.col("rule_label") == UNCLEAR, F.lit(False))
    plain = rows.where(~unclear).withColumn("license_label", label).withColumn("license_label_source", F.lit("rule"))
    asked = apply(rows.where(unclear), "license_text", model, "_answer", "string")
    family = F.nullif(F.regexp_extract(F.upper("_answer"), "(" + "|".join(f for f, _ in rules.FAMILY_TEXTS) + ")", 1), F.lit(""))
    named = F.coalesce(rules.with_version(family, rules.license_version(F.col("license_text"))), F.lit(UNCLEAR))
    return plain.unionByName(asked.withColumn("license_label", named).withColumn("license_label_source", F.lit("model")).drop("_answer"))


def copy_to_documents(documents: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Documents with license_label of the last label (by ``at``) of their key, and a status.

    Blank labels aren't looked up. Statuses: updated, unchanged, no_key, not_found.
    """
    last = labels.where(F.trim("license_label") != "").groupBy(key).agg(F.max_by("license_label", "at").alias("_label"))
    met = documents.join(last, key, "left")
    status = F.when(F.coalesce(F.trim(F.col(key)), F.lit("")) == "", "no_key").when(F.col("_label").isNull(), "not_found").when(F.col("license_label").eqNullSafe(F.col("_label")), "unchanged").otherwise("updated")
    return met.withColumn("status", status).withColumn("license_label", F.coalesce("_label", "license_label")).drop("_label")


def label_levels(documents: DataFrame, direct: dict[str, int], model: Callable[[list[str]], list[str]], signals: str, force: bool = False) -> DataFrame:
    """Adds level (struct) and level_status: by source where it decides, else by the model's answer.

    Rows that have a level keep it unless forced; the model sees rows of other sources alone.
    """
    has = F.lit(False) if force or "level" not in documents.columns else F.col("level.level").isNotNull()
    table = F.create_map(*[F.lit(x) for pair in direct.items() for x in pair])
    rows = documents.withColumn("_direct", F.try_element_at(table, "source")).withColumn("_has", has)
    if "level" not in rows.columns:
        rows = rows.withColumn("level", F.lit(None).cast("struct<level:int,label:string>"))
    kept = rows.where("_has").withColumn("level_status", F.lit("skipped"))
    ruled = rows.where("not _has and _direct is not null").withColumn("level", rules.level_struct(F.col("_direct"))).withColumn("level_status", F.lit("direct"))
    asked = apply(rows.where("not _has and _direct is null"), signals, model, "_answer", "string")
    digit = F.nullif(F.regexp_extract("_answer", "[3457]", 0), F.lit("")).try_cast("int")
    asked = asked.withColumn("level", rules.level_struct(digit)).withColumn("level_status", F.when(digit.isNull(), "failed").otherwise("model")).drop("_answer")
    return kept.unionByName(ruled).unionByName(asked).drop("_has", "_direct")
