import random

import numpy as np
import pytest

from pixelloom.llm import lpf


def brute(rows, length=100):
    seen, out = set(), {}
    for id_, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out[id_] = (len(b), int(gone.sum()), len(runs), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def result(docs, **settings):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in lpf.deduplicate(docs, **settings).collect()}


def made(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "é", "the", "of"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(f"{rng.getrandbits(40):x}" for _ in range(9)) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    rows += [(400, None), (401, ""), (402, "ab" * 3000), (403, "x" * 99), (404, "x" * 100), (405, "x" * 101), (406, "the " * 500)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("settings", [{}, {"max_broadcast": 0}])
def test_brute_force(spark, settings):
    rows, docs = made(spark)
    assert result(docs, **settings) == brute(rows)


def test_common_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(lpf, "HOT", 3)
    rows, docs = made(spark)
    assert result(docs) == brute(rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(docs) == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_odd_rows(odd_docs, no_docs):
    rows = lpf.deduplicate(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    long = next(r for r in rows if r.doc_id == 7)
    assert (long.n_bytes, long.n_removed, long.n_spans) == (150_000, 149_995, 1)
    assert lpf.deduplicate(no_docs).count() == 0


def test_longest_previous_factors():
    for t in (b"", b"a", b"abracadabra abracadabra", b"aaaaaa", b"mississippi"):
        want = [max([k for j in range(i) for k in range(len(t) - i + 1) if t[j : j + k] == t[i : i + k]] or [0]) for i in range(len(t))]
        assert lpf.longest_previous_factors(t) == want


def test_previous_and_next_smaller_in_runs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        run = np.sort(rng.integers(0, 4, 12))
        run = np.unique(run, return_inverse=True)[1]
        pos = rng.permutation(12)
        assert lpf.has_earlier(pos, run).tolist() == [any(pos[j] < pos[i] for j in range(12) if run[j] == run[i]) for i in range(12)]


def test_very_common_anchors_are_split_further(spark, monkeypatch):
    monkeypatch.setattr(lpf, "HOT", 2)
    monkeypatch.setattr(lpf, "VERY_HOT", 2)
    rows, docs = made(spark)
    assert result(docs) == brute(rows)


def test_a_common_line_in_many_texts(spark):
    """A line of 70 bytes in 4,000 texts with differing surroundings: no window repeats but the planted ones, and no anchor keeps all rows."""
    import random

    rng = random.Random(1)
    line = "this very common line of some seventy bytes stands in all texts, yes!!"
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, f"{word(40)} {line} {word(40)}") for i in range(4000)]
    rows += [(5000 + i, rows[i][1]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in lpf.deduplicate(docs).where("n_removed > 0").collect()} == {5000, 5001, 5002}
    counts = lpf.anchor_counts(docs, 100)
    hot = tuple(np.sort(np.array([r.h for r in counts.where(f"c > {c}").collect()], np.int64)) for c in (1000, 2000))
    assert len(hot[1])
    near = lpf.regions(docs, 100, np.sort(np.array([r.h for r in counts.collect()], np.int64)), hot)
    assert near.where("h is not null").groupBy("h").count().agg({"count": "max"}).first()[0] < 400


def test_colliding_hashes_fold_nothing(monkeypatch):
    """Repeats that differ in one byte stay apart even if all hashes of surroundings are equal."""
    import pyarrow as pa

    a = bytes(range(65, 165))
    texts = [a, a[:50] + b"!" + a[51:], a]
    monkeypatch.setattr(lpf, "mix", lambda x: np.zeros(len(x), np.uint64))
    col = lambda *x: pa.array(x, pa.int64())
    t = pa.RecordBatch.from_arrays([col(1, 1, 1), col(1, 2, 3), col(7, 8, 9), col(0, 0, 0), pa.array([3, 3, 3], pa.int32()), pa.array([1, 1, 1], pa.int32()), pa.array(texts, pa.binary())], lpf.REGION_NAMES[:7])
    assert [x.tolist() for x in lpf._group_copies(t, 100)] == [[3], [9], [0], [100]]


def test_text_of_several_segments(spark):
    """Above SEGMENT bytes: parts of a text overlap, and matches across them are found."""
    import random

    rng = random.Random(2)
    piece = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(lpf.SEGMENT - 150))
    text = base + piece + "".join(rng.choice("qrstuvw") for _ in range(1000)) + piece
    docs = spark.createDataFrame([(1, text), (2, piece)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in lpf.deduplicate(docs).collect()}
    assert got == {1: (300, 1), 2: (300, 1)}


@pytest.mark.parametrize("held", [0, 3])
def test_crowded_keys_by_windows(spark, monkeypatch, held):
    """All keys, or those of more than three surroundings, by the digests of their windows."""
    monkeypatch.setattr(lpf, "HELD", held)
    rows, docs = made(spark)
    assert result(docs) == brute(rows)


def test_no_key_gathers_a_row_from_every_batch(spark, monkeypatch):
    """A common line with differing surroundings: whatever the number of batches, what meets under a key stays within the bound."""
    monkeypatch.setattr(lpf, "HELD", 20)
    most, real = [], lpf.copies
    monkeypatch.setattr(lpf, "copies", lambda rows, length: most.append(max([r[1] for r in rows.groupBy("h").count().collect()], default=0)) or real(rows, length))
    rng = random.Random(1)
    line = " ".join(f"{rng.getrandbits(30):x}" for _ in range(15))[:120]
    rows = [(i, f"{rng.getrandbits(64):x} {line} {rng.getrandbits(64):x}") for i in range(600)]
    for parts in (2, 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert result(docs) == brute(rows)
        assert most[-1] <= 20
