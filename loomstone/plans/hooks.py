"""Calls to external models as pluggable functions, each with a deterministic default."""

from __future__ import annotations

import asyncio
import re
from collections.abc import Awaitable, Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.nested import first_non_empty
from ..functions.text import squeeze, tagged_blocks, yes_no
from ..operators.sequence import char_chunks
from ..sources.tables import write_and_read

DIMS = 64


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Bags of hashed words, of length 1."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh3_64_intdigest(w.encode())
            out[row, h % DIMS] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()


def sentences(texts: list[str]) -> list[list[str]]:
    return [[s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] for t in texts]


def keyword_answer(*words: str) -> Callable[[list[str]], list[str]]:
    """YES where a text has one of the words."""
    return lambda texts: ["YES" if any(w in t.lower() for w in words) else "NO" for t in texts]


def apply(df: DataFrame, text: str, hook: Callable[[list[str]], list], name: str, kind: str) -> DataFrame:
    """Adds the hook's answer for each different text; the hook sees each text once."""
    schema = f"{text} string, {name} {kind}"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(hook(texts), arrow_kind)], [text, name])

    arrow_kind = to_arrow_type(_parse_datatype_string(kind))
    answers = df.where(F.col(text).isNotNull()).select(text).distinct().mapInArrow(call, schema)
    return df.join(answers, text, "left")


#: Errors that another try may not meet.
PASSING = (ConnectionError, TimeoutError, asyncio.TimeoutError)
#: Bytes of prompts that a task holds, with their answers, at a time.
ASKED_BYTES = 4 << 20
ASKED = "prompt string, answer string, error string, tries int, retryable boolean"


async def _answers(prompts: list[str], call: Callable[[str], Awaitable[str]], at_once: int, tries: int, seconds: float, pause: float) -> list[tuple]:
    """(answer, error, tries, retryable) of each prompt; so many are under way at once, and no more are begun."""
    out: list = [None] * len(prompts)
    waiting = iter(enumerate(prompts))

    async def one(prompt: str) -> tuple:
        for k in range(1, tries + 1):
            try:
                return await asyncio.wait_for(call(prompt), seconds), None, k, None
            except Exception as e:  # noqa: BLE001 whatever a call raises is its row's error
                passing = isinstance(e, PASSING)
                if not passing or k == tries:
                    return None, f"{type(e).__name__}: {e}", k, passing
            await asyncio.sleep(pause * 2 ** (k - 1))
        raise AssertionError

    async def some() -> None:
        for place, prompt in waiting:
            out[place] = await one(prompt)

    await asyncio.gather(*[some() for _ in range(min(at_once, len(prompts)))])
    return out


def _within(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Array]:
    """The texts of batches' first column in runs of at most so many bytes (or one text)."""
    for batch in batches:
        texts = batch.column(0)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield texts.slice(lo, hi - lo)
            lo = hi


def ask(df: DataFrame, prompt: str, call: Callable[[str], Awaitable[str]], *, at_once: int = 16, tries: int = 4, seconds: float = 120.0, pause: float = 1.0, memo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with ``answer``, and what was asked: prompt, answer, error, tries, retryable.

    ``call`` is a coroutine; a task has ``at_once`` of them under way, tries again what failed in passing,
    and gives the rest up with its error, so no prompt costs a batch. Each different prompt is asked once,
    and none that ``memo`` (prompt, answer) knows; what was asked is written before it is used, so nothing
    is asked again by a later plan. Append its answers to the memo for the next run. Null prompts aren't asked.
    """
    new = df.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct()
    if memo is not None:
        new = new.join(memo.select("prompt"), "prompt", "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _within(batches, ASKED_BYTES):
            prompts = texts.to_pylist()
            rows = asyncio.run(_answers(prompts, call, at_once, tries, seconds, pause))
            cells = [pa.array(prompts, pa.string()), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_()))]]
            yield pa.RecordBatch.from_arrays(cells, ["prompt", "answer", "error", "tries", "retryable"])

    asked = write_and_read(new.mapInArrow(work, ASKED), "asked")
    known = asked.where("error is null").select("prompt", "answer")
    known = known if memo is None else known.union(memo.select("prompt", "answer"))
    return df.join(known.withColumnRenamed("prompt", "_asked"), F.col(prompt) == F.col("_asked"), "left").drop("_asked"), asked


def relevance(df: DataFrame, title: str, abstract: str, hook: Callable[[list[str]], list[str]]) -> DataFrame:
    """status of each row: relevant, not_relevant, unclear, or no_abstract for rows with neither text."""
    asked = df.withColumn("_ask", first_non_empty(F.concat_ws(". ", title, abstract), F.col(title)))
    some = apply(asked.where("_ask is not null"), "_ask", hook, "_answer", "string")
    said = yes_no(F.col("_answer"))
    some = some.withColumn("status", F.when(said, "relevant").when(~said, "not_relevant").otherwise("unclear")).select(*df.columns, "status")
    return some.union(asked.where("_ask is null").select(*df.columns, F.lit("no_abstract").alias("status")))


def safely(hook: Callable[[list[str]], list]) -> Callable[[list[str]], list]:
    """The hook with null for texts that it fails on; a failed batch is asked again one by one."""

    def call(texts: list[str]) -> list:
        try:
            return hook(texts)
        except Exception:
            return [None] if len(texts) == 1 else [answer for t in texts for answer in call([t])]

    return call


def _first_of_alike(blocks: Column) -> Column:
    """Blocks without white-space runs, empty ones and those that differ from an earlier one in case alone."""
    own = F.filter(F.transform(blocks, squeeze), lambda x: x != "")
    low = F.transform(own, F.lower)
    return F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def extract(df: DataFrame, key: str, text: str, hook: Callable[[list[str]], list[str]], *, most: int = 110_000, size: int = 80_000, overlap: int = 5_000) -> DataFrame:
    """key, factoids, way of each row: the tagged blocks of the model's answer, in order, each once.

    Texts of up to ``most`` characters are asked whole. Longer ones, and those for which the hook gives null
    (no room for them, or an error under ``safely``), are asked in windows of ``size`` that share
    ``overlap``; a window without an answer adds nothing. ``way`` is single, chunked, or none for null and
    blank texts, which aren't asked. ``key`` must be unique. A document's windows meet in one row.
    """
    rows = df.select(key, F.col(text).alias("_text"))
    some = F.coalesce(F.trim("_text") != "", F.lit(False))
    whole = apply(rows.where(some & (F.length("_text") <= most)), "_text", hook, "_answer", "string")
    single = whole.where("_answer is not null").select(key, _first_of_alike(tagged_blocks(F.col("_answer"))).alias("factoids"), F.lit("single").alias("way"))
    again = whole.where("_answer is null").select(key, "_text").unionByName(rows.where(some & (F.length("_text") > most)))
    asked = apply(char_chunks(again, "_text", size, overlap).select(key, "chunk_no", "chunk"), "chunk", hook, "_answer", "string")
    found = F.struct("chunk_no", F.coalesce(tagged_blocks(F.col("_answer")), F.array().cast("array<string>")).alias("blocks"))
    in_order = asked.groupBy(key).agg(F.array_sort(F.collect_list(found)).alias("parts"))
    chunked = in_order.select(key, _first_of_alike(F.flatten(F.transform("parts", lambda p: p["blocks"]))).alias("factoids"), F.lit("chunked").alias("way"))
    return single.unionByName(chunked).unionByName(rows.where(~some).select(key, F.array().cast("array<string>").alias("factoids"), F.lit("none").alias("way")))


def resolve_match(df: DataFrame, target: str, candidates: str, hook: Callable[[list[str]], list[str]], most: int = 20) -> DataFrame:
    """Adds matched_file_name: which of the first ``most`` candidates (ranked structs) is the target, by the model.

    The hook sees JSON with target and candidates and answers JSON with matched_file_name; null without
    candidates, for null, and where the answer isn't such JSON.
    """
    listed = F.slice(candidates, 1, most)
    prompt = F.when(F.size(candidates) > 0, F.to_json(F.struct(F.col(target).alias("target"), listed.alias("candidates"))))
    asked = apply(df.withColumn("_prompt", prompt), "_prompt", hook, "_answer", "string")
    name = F.nullif(F.trim(F.get_json_object("_answer", "$.matched_file_name")), F.lit(""))
    return asked.withColumn("matched_file_name", name).drop("_prompt", "_answer")
