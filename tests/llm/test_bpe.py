import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import bpe
from pixelloom.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def pair():
    e = bpe.Encoder(BYTE_BPE, public_tokenizers.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.v.rank, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_same_ids_and_back(pair, text):
    e, library = pair
    ids = e.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 10))
@settings(max_examples=100, deadline=None)
def test_prefixes_appends_and_edits(pair, data, more, at, drop):
    v = pair[0].v
    t = bpe.PrefixTable(v, data)
    for n in range(len(data) + 1):
        assert t.ids(n) == bpe.PrefixTable(v, data[:n]).ids()
    t.append(more)
    assert t.ids() == bpe.PrefixTable(v, data + more).ids()
    whole = data + more
    at = min(at, len(whole))
    t.replace(at, min(len(whole), at + drop), b"xy")
    assert t.ids() == bpe.PrefixTable(v, whole[:at] + b"xy" + whole[min(len(whole), at + drop) :]).ids()


def test_editable_text(pair):
    e, library = pair
    rng = random.Random(4)
    t = bpe.EditableText(e, "the start of it")
    for _ in range(60):
        a = rng.randint(0, len(t.text))
        t.edit(a, min(len(t.text), a + rng.randint(0, 4)), rng.choice([" and", "ing", "  ", "'s", "é", "7", "", "\n"]))
        assert t.ids() == library.encode_ordinary(t.text)
    t.append("ly done")
    assert t.ids() == library.encode_ordinary(t.text)


def test_documents(spark, sf_dir, odd_docs, no_docs, pair):
    library = pair[1]
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        want = []
        for r in docs.collect():
            ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
            want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, bpe.encode_documents(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(no_docs, BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    assert bpe.token_ids(odd_docs, BYTE_BPE, public_tokenizers.PATTERN).where("doc_id = 8").first().ids == library.encode_ordinary("one")
