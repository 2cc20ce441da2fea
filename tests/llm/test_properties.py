"""Properties on generated values."""

import io
import struct

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import chosen_path, string_tiling, token_files, warc_archive

ODD = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \t\n\r\x0b\x0cabzABZéÉßİıĳŉ'’<|>.,!?-019́̊\xa0 Kſ"))), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_ids_of_words_are_the_ids_of_the_text(text):
    words = token_files.encoder(token_files.default_tokenizer(), "uint16")
    want = np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "uint16").tobytes()
    assert words.encode(text.encode()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6), st.binary(max_size=400).map(lambda d: d and b"d" + d), st.integers(1, 50))
def test_frames_come_back_one_by_one(records, dictionary, piece):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    data = struct.pack("<II", warc_archive.DICT_MAGIC, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, piece) if self.tell() >= 8 + len(dictionary) else n)

    got = list(warc_archive.read_frames(Slow(data)))
    assert [d for _, d in got] == records
    assert [at for at, _ in got] == sorted({at for at, _ in got})


def test_reader_wants_the_dictionary_frame():
    with pytest.raises(warc_archive.WarcError):
        list(warc_archive.read_frames(io.BytesIO(zstandard.compress(b"x"))))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8), st.sampled_from([50, 85, 100]))
def test_similar_pairs_are_exact(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert set(chosen_path._similar(arrays, percent)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(2, 5))
def test_tiles_do_not_overlap(item, text, least):
    seen_i, seen_t = set(), set()
    for i, t, n in string_tiling.greedy_tiles(item, text, least):
        assert n >= least and item[i : i + n] == text[t : t + n]
        assert not seen_i & set(range(i, i + n)) and not seen_t & set(range(t, t + n))
        seen_i |= set(range(i, i + n))
        seen_t |= set(range(t, t + n))
