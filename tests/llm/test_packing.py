import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelloom.llm import packing
from pixelloom.llm.common import text_bytes
from pixelloom.llm.queries import WORD_BPE


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    """The library itself, untouched by the module."""
    return Tokenizer.from_file(WORD_BPE)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_differencing_deals_every_item_out_once(sizes, k):
    parts = packing.differencing(sizes, k)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) == k


def test_differencing_of_two_parts_is_the_classic():
    parts = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_windows_rise_with_overflow():
    parts = packing.pack([6, 6, 6], 10)
    assert len(parts) == 3


@given(st.lists(st.text(alphabet="abAB .,'é\n\t!1²ß—İ<|日🙂", max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_ids_are_the_library_s(tokenizer, library, texts):
    got = tokenizer.encode(*text_bytes(pa.array(texts, pa.string())))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, docs, library):
    """rows: the pieces of some documents; every id in one piece, sequences gapless."""
    want = defaultdict(list)
    for id_, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[id_].append(np.array(ids, "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for id_, texts in want.items():
        assert sum(r.length for r in by_doc[id_]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[id_], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0]) and r.ids_crc32 == zlib.crc32(texts[0][at : at + r.length])
                at += r.length
    pad = total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    return pad, total


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    pad, total = check(packing.pack_documents(docs, WORD_BPE).collect(), [(r.doc_id, r.text) for r in docs.collect()], library)
    assert pad <= 0.03 * total


def test_odd_rows(odd_docs, no_docs, library):
    check(packing.pack_documents(odd_docs, WORD_BPE).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], library)
    assert packing.pack_documents(no_docs, WORD_BPE).count() == 0


def test_special_tokens_and_words_of_opposite_bits(tokenizer, library):
    """Names of special tokens in a text are those tokens, as in the library; long words that polynomial hashes confuse stay apart."""
    texts = ["hello <|startoftext|> world", "a<|endoftext|>b <|other|>", "<|startoftext|><|endoftext|>"]
    for n in (1024, 2048, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    got = tokenizer.encode(*text_bytes(pa.array(texts)))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49406 in got[0].tolist()


def test_equal_codes_go_to_the_library(tokenizer, library, monkeypatch):
    """If codes collide, bytes decide."""
    monkeypatch.setattr(packing, "hash_spans", lambda buf, s, e: np.full(len(s), 7, np.uint64))
    texts = ["comfortable understanding of everything", "comfortable", "incompatible comfortable", "short words only"]
    assert [g.tolist() for g in tokenizer.encode(*text_bytes(pa.array(texts)))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_count_of_windows_rises_inside_the_packer(monkeypatch):
    packer = packing.Packer(0, capacity=10, windows=3, piece=6)
    packer.room = 24
    for t, n in enumerate([6, 6, 6, 6]):  # three windows of 8 on average, but four items of 6
        packer.add(t, n)
    assert not packer.items and len({q for _, _, _, q, _ in packer.out}) == 4


def test_text_larger_than_a_batch(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 1 << 10)
    docs = spark.createDataFrame([(1, "some words. " * 4000), (2, "x"), (3, None), (3, "y z")], "doc_id long, text string").coalesce(1)
    check(packing.pack_documents(docs, WORD_BPE).collect(), [(r.doc_id, r.text) for r in docs.collect()], library)
