"""Token ids in Arrow stream files of equal-length sequences and masks.

A file holds record batches with two columns, ``ids`` and ``mask``: fixed-size lists of ``length``
entries, so that a mapped file gives sequence ``k`` as a view, without a copy. Ids are unsigned, 16
bits wide where the vocabulary allows it. Documents follow one another, each with its end id; only
the last sequence of a file is padded, with mask false. Beside it, an Arrow stream file of documents
(doc_id, start within the file, n_tokens) tells where each one lies.

Documents are range-partitioned by doc_id, so files in order of their number, read one after another,
hold all documents in ascending doc_id order (nulls first, equal ids by the text's hash).

Edge cases: a null or empty text is its end id alone. Rows that repeat are encoded as often. An empty
table gives no files and no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import arrow_batches, held, local_path, new_folder, opened, qualified, replacing, stash

#: Words that a worker keeps with their ids.
KEPT_WORDS = 600_000
#: Letters below U+0300 but for the one that lower-cases to two, then ASCII marks that no contraction starts with.
_LETTERS_THEN_MARKS = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af]+)([!-&(-/:-@\\[-`{-~]*)")
_PLAIN_VOCABULARY = r"[\p{L}]+"
WRITTEN = "part int, file string, docs long, tokens long, sequences long"
#: Texts by which a tokenizer shows whether it drops white space.
PROBES = ("A b", " a", "a ", "a  b\n\nc\td", "It's 12 3.4, (x) !? Ünï \u0130 \u65e5\u672c \u8a9e\u3002 e\u0301 ...", "\n", "don 't  ##a \u00b5\u00aa")
#: Bytes of text that one file takes, about.
FILE_BYTES = 1 << 30
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class WordEncoder(dict):
    """Encodes whole texts through the ids of their words; maps a word's UTF-8 to its ids' bytes.

    The word vocabulary's pre-tokenizer drops white space and never joins what stands on either side of
    it, and its normalizer works within such pieces. So the ids of a text are those of its pieces
    between ASCII white space. A piece of letters below U+0300, with or without punctuation after
    it, is in normal form but for its case and parts there, so its letters go to the library's merges
    alone. All other pieces go through the whole tokenizer. A tokenizer that doesn't give the same ids for
    PROBES and for their pieces keeps white space; with it, texts are encoded whole.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.tokenizer, self.dtype, self.late = Tokenizer.from_file(path), dtype, {}
        self.model, self.byte_level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = self.tokenizer.normalizer is not None and _PLAIN_VOCABULARY in repr(self.tokenizer.pre_tokenizer)
        self.by_words = all(b"".join(map(self.__getitem__, t.encode().split())) == self._whole(t) for t in PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a UTF-8 text as little-endian integers."""
        if not self.by_words:
            return self._whole(text.decode()) if text else b""
        return b"".join(map(self.__getitem__, text.split())) if text else b""

    def __missing__(self, word: bytes) -> bytes:
        found = self.late.get(word)
        if found is None:
            text = word.decode()
            parts = _LETTERS_THEN_MARKS.fullmatch(text) if self.plain else None
            if parts is None:
                found = self._whole(text)
            elif (letters := parts[1].lower()) != text:
                found = self[letters.encode()] + (self[parts[2].encode()] if parts[2] else b"")
            else:
                piece = text if text.isascii() else self.byte_level.pre_tokenize_str(text)[0][0]
                found = np.array([t.id for t in self.model.tokenize(piece)], self.dtype).tobytes()
            if len(self) < KEPT_WORDS:
                self[word] = found
            else:  # the first words to come are the frequent ones; of others, some at a time
                if len(self.late) >= KEPT_WORDS // 4:
                    self.late.clear()
                self.late[word] = found
        return found


def encoder(path: str, dtype: str) -> WordEncoder:
    return held("encoder", path, dtype, build=lambda: WordEncoder(path, dtype))


class SequenceWriter:
    """Fills sequences of ``length`` ids and writes them in batches of ``rows``."""

    def __init__(self, sink, length: int, rows: int, dtype: str):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream, self.parts, self.held, self.sequences = pa.ipc.new_stream(sink, self.schema), [], 0, 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.rows * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        full = self.rows * self.length
        while len(ids) >= full or (last and len(ids)):
            part, ids = ids[:full], ids[full:]
            n = -(-len(part) // self.length)
            block, mask = np.zeros(n * self.length, self.dtype), np.zeros(n * self.length, bool)
            block[: len(part)], mask[: len(part)] = part, True
            bits = pa.BooleanArray.from_buffers(pa.bool_(), len(mask), [None, pa.py_buffer(np.packbits(mask, bitorder="little"))])
            columns = [pa.FixedSizeListArray.from_arrays(a, self.length) for a in (pa.array(block), bits)]
            self.stream.write_batch(pa.record_batch([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema))
            self.sequences += n
        self.parts, self.held = [ids.tobytes()], ids.nbytes

    def close(self) -> None:
        self._flush(True)
        self.stream.close()


class SequenceFile:
    """Random access to a file: sequence k and its mask as views of the mapped file's pages (or, of a file in a
    store that can't be mapped, of its batches in memory)."""

    def __init__(self, uri: str):
        path = local_path(uri)
        self.source = opened(uri) if path is None else pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.first = np.cumsum([0] + [b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.first[-1])

    def _at(self, k: int, column: str):
        if not 0 <= k < len(self):
            raise IndexError(k)
        b = int(np.searchsorted(self.first, k, "right")) - 1
        cells = self.batches[b].column(column)
        return cells.values.slice(int(k - self.first[b]) * cells.type.list_size, cells.type.list_size)

    def ids(self, k: int) -> np.ndarray:
        return self._at(k, "ids").to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> pa.BooleanArray:
        return self._at(k, "mask")


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 1, length: int = 2048, rows: int = 64, dtype: str = "uint16") -> DataFrame:
    """Encode doc_id, text and write the files; part, file, docs, tokens and sequences of each."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = qualified(spark, folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (batch := next(batches, None)) is None:
            return
        task, width, start, n_docs = TaskContext.get(), np.dtype(dtype).itemsize, 0, 0
        part, attempt, words = task.partitionId(), str(task.taskAttemptId()), encoder(tokenizer, dtype)
        uri = f"{folder}/tokens-{part:06d}.arrow"
        with replacing(uri, attempt) as sink, replacing(f"{folder}/docs-{part:06d}.arrow", attempt) as beside:
            out, index = SequenceWriter(sink, length, rows, dtype), pa.ipc.new_stream(beside, INDEX)
            while batch is not None:
                sizes = []
                for ids in map(words.encode, batch.column(1).cast(pa.binary()).to_pylist()):
                    out.add(ids + end)
                    sizes.append(len(ids) // width + 1)
                starts = start + np.cumsum([0] + sizes)
                index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
                start, n_docs = int(starts[-1]), n_docs + batch.num_rows
                batch = next(batches, None)
            out.close()
            index.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [uri], "docs": [n_docs], "tokens": [start], "sequences": [out.sequences]})

    order = ["doc_id", F.xxhash64("text")]  # rows that share an id are dealt out by their texts
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stash(ordered.mapInArrow(write, WRITTEN), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids_crc32 of each document, from the files' bytes."""
    placed = files.withColumn("before", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).select("file", "before", "tokens", "sequences")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uri = row["file"]
                sequences = tokens = 0
                ids, more = np.zeros(0, np.uint32), None
                with opened(uri) as source, opened("/docs-".join(uri.rsplit("/tokens-", 1))) as beside:
                    more = iter(pa.ipc.open_stream(source))
                    for docs in pa.ipc.open_stream(beside):
                        crcs = []
                        for n in docs.column("n_tokens").to_pylist():
                            crc = 0
                            while n > len(ids):
                                crc, n = zlib.crc32(ids.tobytes(), crc), n - len(ids)
                                block = next(more)
                                kept = block.column("mask").flatten().true_count
                                ids = block.column("ids").flatten().to_numpy()[:kept].astype("<u4")
                                sequences, tokens = sequences + block.num_rows, tokens + kept
                            crcs.append(zlib.crc32(ids[:n].tobytes(), crc))
                            ids = ids[n:]
                        starts = pa.array(docs.column("start").to_numpy() + row["before"], pa.int64())
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                if len(ids) or (sequences, tokens) != (row["sequences"], row["tokens"]):
                    raise ValueError(f"{uri} has {tokens} ids in {sequences} sequences, not {row['tokens']} in {row['sequences']}")

    return placed.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, new_folder(spark, "tokens"), tokenizer=default_tokenizer()))
