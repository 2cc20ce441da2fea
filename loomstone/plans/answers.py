"""Prompts from columns, and what becomes of a model's answers: levels, structured records, answers from retrieved rows.

The model is a coroutine that the caller gives (see ``hooks.ask``).
"""

from __future__ import annotations

from collections.abc import Awaitable, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import level_digit
from ..operators.vector import context_block
from .hooks import ask

Call = Callable[[str], Awaitable[str]]

# The lines of what a level is decided by, and their columns.
SIGNAL_LINES = {"Title": "title", "Journal": "journal", "Article-type hint": "article_type", "Document subtype": "document_subtype"}
SIGNAL_LISTS = {"Categories": "categories", "Keywords": "keywords"}


def level_prompt(columns: list[str], *, sample: str = "factoid_sample") -> Column:
    """A document's signals as text: lines, then abstract (else a sample of its factoids) and methods; what is missing is N/A."""
    has = set(columns)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(blank(F.col(c)) if c in has else F.lit(None), F.lit("N/A"))) for label, c in SIGNAL_LINES.items()]
    lines += [F.concat(F.lit(f"{label}: "), F.coalesce(blank(F.array_join(c, ", ")) if c in has else F.lit(None), F.lit("N/A"))) for label, c in SIGNAL_LISTS.items()]
    some = lambda c: blank(F.col(c)) if c in has else F.lit(None).cast("string")
    listed = F.when(F.size(sample) > 0, F.array_join(F.transform(sample, lambda s: F.concat(F.lit("- "), s)), "\n")) if sample in has else F.lit(None).cast("string")
    abstract = F.coalesce(F.concat(F.lit("\nAbstract:\n"), some("abstract")), F.concat(F.lit("\nNo abstract. Factoids of the document, a weak signal:\n"), listed))
    return F.concat_ws("\n", *lines, abstract, F.concat(F.lit("\nMethods:\n"), some("methods")), F.lit("\nReply with one digit: 3, 4, 5 or 7."))


def levels(signals: DataFrame, call: Call, **options) -> tuple[DataFrame, DataFrame]:
    """The rows with ``level`` (3, 4, 5 or 7; null where the answer has none of them), and what was asked."""
    answered, asked = ask(signals.withColumn("_prompt", level_prompt(signals.columns)), "_prompt", call, **options)
    return answered.withColumn("level", level_digit(F.col("answer"))).drop("_prompt", "answer"), asked


def structured(df: DataFrame, prompt: str, call: Call, schema: str, required: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """The rows with ``record`` (of ``schema``), and failures: prompt, error, answer.

    An answer that is no JSON, or lacks a required field (a dotted path), is a failure like a call that failed.
    """
    answered, asked = ask(df, prompt, call, **options)
    record = F.from_json("answer", schema)
    given = lambda path: F.try_variant_get(F.try_parse_json("answer"), f"$.{path}", "variant")
    lacks = F.coalesce(*[F.when(given(p).isNull() | F.coalesce(F.is_variant_null(given(p)), F.lit(True)), F.lit(f"no {p}")) for p in required], F.lit(None).cast("string"))
    why = F.when(F.col("answer").isNotNull() & F.try_parse_json("answer").isNull(), "no JSON").when(F.col("answer").isNotNull(), lacks)
    failed = asked.withColumn("error", F.coalesce("error", why)).where("error is not null").select("prompt", "error", "answer")
    return answered.withColumn("record", F.when(why.isNull(), record)).drop("answer"), failed


def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question by these factoids alone and cite them; say so where they don't tell.\n\nQuestion:\n"), question, F.lit("\n\nFactoids:\n"), context)


def rag_answers(questions: DataFrame, hits: DataFrame, call: Call, *fields: str, **options) -> tuple[DataFrame, DataFrame]:
    """query_id, question, answer (null without any hit or where the call failed), and what was asked.

    hits: query_id, rank, document and the fields to show, of the rows found for each question.
    """
    context = context_block(hits, "query_id", "rank", *fields)
    asked = questions.select("query_id", "question").join(context, "query_id", "left").withColumn("_prompt", rag_prompt(F.col("question"), F.col("context")))
    answered, log = ask(asked, "_prompt", call, **options)
    return answered.select("query_id", "question", "answer"), log
