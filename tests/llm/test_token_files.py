from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clonarium.llm import token_files
from clonarium.llm.token_files import BLOCK, Encoder, pack_block, pack_section, read_token_files, round_trip, sections, unpack_block, write_token_files
from tests.llm.fixtures import SCHEMA, corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(5, 9)), min_size=1, max_size=300))
def test_block_round_trip(ids):
    x = np.array(ids, np.uint32)
    packed = pack_block(x)
    back, end = unpack_block(memoryview(packed), 0)
    assert back.tolist() == ids and end == len(packed)


def test_outliers_are_exceptions():
    x = np.r_[np.arange(1000) % 7, [2**31]].astype(np.uint32)
    assert len(pack_block(x)) < 1000 * 4 // 8 + 40


def test_section_round_trip_over_several_blocks():
    counts = np.array([0, BLOCK + 5, 1, BLOCK])
    ids = np.random.default_rng(1).integers(0, 50257, counts.sum(), dtype=np.uint32)
    (part,) = sections(pack_section(np.arange(4), counts, ids, 1) + b"\n")
    assert part.docs.tolist() == [0, 1, 2, 3] and part.counts.tolist() == counts.tolist() and (part.ids() == ids).all()
    assert part.named(1, 2) == (1, 3) and part.named(2, None) == (2, 3) and part.named(None, None) == (0, 4)


def test_only_blocks_of_the_range_are_decoded(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 50257, 10 * BLOCK, dtype=np.uint32)
    (part,) = sections(pack_section(np.arange(1), np.array([len(ids)]), ids) + b"\n")
    asked = []
    plain = token_files.unpack_block
    monkeypatch.setattr(token_files, "unpack_block", lambda view, at: asked.append(at) or plain(view, at))
    for lo, hi in ((0, 1), (BLOCK - 1, BLOCK + 1), (3 * BLOCK, 5 * BLOCK), (7, 7), (9 * BLOCK + 5, 10 * BLOCK)):
        asked.clear()
        assert (part.ids(lo, hi) == ids[lo:hi]).all()
        assert len(asked) == (0 if lo == hi else (hi - 1) // BLOCK - lo // BLOCK + 1)


_encoder, _library = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'.s1 \n\t\r\x0b\x1c\x85\xa0 é日🙂")), max_size=14), max_size=6))
def test_encoder_equals_the_library(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(r) for r in raw])
    ids, counts = _encoder.encode(np.frombuffer(b"".join(raw), np.uint8), at, 2)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    assert got == [_library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_special_token_in_a_text():
    data = b"a <|endoftext|>\n<|endoftext|> b<|endoftext|>"
    assert 50256 in _encoder.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()


@pytest.mark.parametrize("want_ids", [False, True])
def test_round_trip_equals_the_library(spark, want_ids):
    rows = corpus() + [(5000, "x <|endoftext|> y<|endoftext|>", "a"), (5001, "<|endoftext|>", None)]
    tool = Tokenizer.from_file(PATH)
    got = round_trip(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "start"), PATH, want_ids=want_ids).collect()
    have = {(r.doc_id, r.start): r for r in got}
    at, seen = 0, 0
    # Documents without an id come last, in the order of a hash.
    last = {r.n_tokens: r.start for r in got if r.doc_id is None}
    encoded = lambda t: tool.encode(t, add_special_tokens=False).ids + [2]
    unnamed = sorted([(None, t or "") for d, t, _ in rows if d is None], key=lambda x: last[len(encoded(x[1]))])
    for d, t in sorted((d, t or "") for d, t, _ in rows if d is not None) + unnamed:
        ids = encoded(t)
        r = have[d, at]
        assert r.n_tokens == len(ids)
        assert (r.ids == ids) if want_ids else (r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        seen += 1
    assert seen == len(got)


def test_a_range_of_documents_is_read_alone(spark, tmp_path):
    rows = corpus()
    path = f"file://{tmp_path}/tokens"
    write_token_files(spark.createDataFrame(rows, SCHEMA), path, PATH)
    whole = [r for r in read_token_files(spark, path).collect() if r.doc_id is not None and 1003 <= r.doc_id <= 2004]
    assert whole and sorted(read_token_files(spark, path, low=1003, high=2004).collect()) == sorted(whole)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []
