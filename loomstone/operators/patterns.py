"""Many patterns searched in many texts at once, by automata that are built once in each worker.

Patterns come in blocks of at most ``BLOCK_BYTES``, and only one block is broadcast at a time: more patterns
take more passes over the texts, each written before the next begins, with the same result. A pass reads
each text once, however many patterns there are, and moves no text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import write_and_read

#: UTF-8 bytes of the patterns of one broadcast block, and what a pattern takes besides.
BLOCK_BYTES, EACH = 8 << 20, 16
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block; a worker keeps the last one."""
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for p in patterns:
            made.add_word(p, p)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def _blocks(patterns: DataFrame) -> Iterator[list[str]]:
    block, size = [], 0
    for (p,) in patterns.toLocalIterator():
        own = len(p.encode()) + EACH
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(p)
        size += own
    if block:
        yield block


def found_in(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """id, pattern for each text (id, text) and each different pattern (pattern) that is a part of it.

    Null texts hold nothing, null and empty patterns are nowhere. A text that stands twice is searched twice.
    """
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType
    schema = f"id {kind.simpleString()}, pattern string"
    out = last = None
    for block in _blocks(patterns.where("pattern <> ''").select("pattern").distinct()):
        if last is not None:
            out = write_and_read(out, "found")
            last.destroy()
        last = shared = spark.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            machine = _automaton(name, shared.value)
            for batch in batches:
                hits = [sorted({p for _, p in machine.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
                rows = [k for k, h in enumerate(hits) for _ in h]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([p for h in hits for p in h], pa.string())], ["id", "pattern"])

        found = texts.select("id", "text").mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else texts.limit(0).select("id", F.lit("").alias("pattern"))
