"""From documents to token files: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs. All but the last return the columns of documents, and further columns of any name.

Edge cases, the same in every stage: an empty table gives an empty one. A null doc_id, source or lang is a
value like others. Null texts count as empty. Rows that repeat are rows of their own, but for the
near-dedup, which keeps one of equal rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import centroid_langid, chosen_path, source_mixing, string_tiling, token_files
from loomstone.llm._shared import new_folder, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language like those learned; the others go, as do null, empty and letterless texts.

    Without any labelled row outside the held-out ones nothing is learned, and all go.
    """
    return centroid_langid.drop_rejected(docs, centroid_langid.fit(docs.where(~centroid_langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 alike or more in runs of five words), that with
    the smallest doc_id (null last); texts without words stay, as they are near nothing."""
    return chosen_path.drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null, empty and wordless texts and items cover nothing."""
    return string_tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, row by row; texts without words are never taken."""
    return source_mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 read back from the token files."""
    return token_files.read_tokens(token_files.write_tokens(docs, new_folder(spark, "tokens"), tokenizer=token_files.default_tokenizer()))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_ids", token_ids)]
#: No SQL: the language model, the near-duplicate join and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
