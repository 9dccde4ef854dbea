import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pixelloom.llm import jaccard
from pixelloom.llm.common import text_bytes, words


def brute(rows, size, num):
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
            up[max(top(a), top(b))] = min(top(a), top(b))
    ids = collections.defaultdict(list)
    for i, (id_, _) in enumerate(rows):
        ids[top(i)].append(id_)
    low = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    return sorted(((rows[i][0], len(sets[i]), low[top(i)]) for i in range(len(rows))), key=repr)


def result(docs, size, num, **settings):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(docs, size, num, **settings).collect()), key=repr)


def noisy(spark):
    """Few base texts in many mixtures: frequent tokens, near copies around the threshold."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(8)]
    rows = []
    for i in range(260):
        w = " ".join(rng.choice(base) for _ in range(rng.randint(1, 2))).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("size,num", [(3, 90), (2, 60), (5, 80)])
def test_brute_force(spark, monkeypatch, size, num):
    rows, docs = noisy(spark)
    monkeypatch.setattr(jaccard, "RARE", 4)
    assert result(docs, size, num) == brute(rows, size, num)


def test_tokens_that_are_not_sent_out(spark):
    rows, docs = noisy(spark)
    assert result(docs, 3, 90, max_broadcast=0) == brute(rows, 3, 90)


def test_large_entries_of_tokens_that_are_rare_in_full_sets_only(spark, monkeypatch):
    """Near copies read again have too many tokens in common for the bound of the prefixes, and short texts known in part share them."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(602)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(600)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[at : at + 12])) for i, at in enumerate(range(0, 590, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "RARE", 4)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 120)
    monkeypatch.setattr(jaccard, "HOT", 8)
    assert result(docs, 3, 90) == brute(rows, 3, 90)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got, want = result(odd_docs, 3, 90), brute(rows, 3, 90)
    assert got == want and jaccard.groups(no_docs).count() == 0
    clash = odd_docs.withColumnsRenamed({"key": "__row_key", "lang": "__row_id"})
    out = jaccard.keep_one(clash, 3, 90)
    assert out.columns == clash.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 3, 4, 5, None, None, 7, 8, 10], key=repr)
    with pytest.raises(ValueError):
        jaccard.link(odd_docs, 3, 50)


def test_entries_meet_within_reach():
    """Any two sets of enough similarity share an entry where each lies within the other's reach, whatever the frequencies."""
    rng = np.random.default_rng(3)
    for num in (51, 80, 90, 100):
        for n in [*range(1, 40), 70, 300]:
            for share in (0.0, 0.5, 1.0):
                every = np.sort(rng.choice(2**40, 2 * n, replace=False).astype(np.int64))
                often = np.sort(rng.permutation(every)[: int(2 * n * share)])
                x = np.sort(rng.choice(every, n, replace=False))
                drop = int(rng.integers(0, n - -(-num * n // 100) + 1))
                y = np.sort(rng.permutation(x)[drop:])
                if 100 * len(y) < num * n or len(y) == n:
                    continue
                (s, i), (t, j) = jaccard.signatures(x, n, often, num, 100), jaccard.signatures(y, len(y), often, num, 100)
                fx, fy = dict(zip(s.tolist(), jaccard.reach(n, i, num, 100).tolist())), dict(zip(t.tolist(), jaccard.reach(len(y), j, num, 100).tolist()))
                assert any(fx[k] >= len(y) and fy[k] >= n for k in fx.keys() & fy.keys()), (num, n, share)


def thue_morse(n):
    """Two words of n bytes that polynomial hashes modulo powers of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_opposite_bits(n):
    x, y = thue_morse(n)
    buf, off = text_bytes(pa.array([x, y]))
    assert len(set(words(buf, off)[0].tolist())) == 2


def test_links_are_held_against_the_words(spark):
    x, y = thue_morse(2048)
    rows = [(1, f"p q {x}"), (2, f"p q {y}"), (3, f"P q\t{x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs, 3, 90) == brute(rows, 3, 90)
    judge = jaccard._text_judge(3, 90, 100)
    assert not judge(1, pa.scalar(rows[0][1]))(1, pa.scalar(rows[1][1])) and judge(1, pa.scalar(rows[0][1]))(1, pa.scalar(rows[2][1]))


def test_hubs_and_blocks(spark, monkeypatch):
    """A hub of many copies in several buckets, and an entry compared in several blocks."""
    rows, docs = noisy(spark)
    for name, value in (("RARE", 4), ("HUB", 3), ("HOT", 4), ("BLOCK", 16), ("MAX_FREQUENT", 40)):
        monkeypatch.setattr(jaccard, name, value)
    assert result(docs, 3, 90) == brute(rows, 3, 90)


def test_large_collections_of_sets_are_dealt_out_once(spark):
    """A join with bucketed sets moves its other side alone, also where sets read again are kept apart."""
    from pyspark.sql import functions as F

    sets = jaccard._dealt_once(spark.range(1000).select(F.col("id").alias("key"), F.lit(3).cast("long").alias("n"), F.array(F.col("id")).alias("toks")))
    again = spark.range(5).select(F.col("id").alias("key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = jaccard.materialize(spark.range(400).select((F.col("id") * 2).alias("key"), F.col("id").alias("hub")), "pairs")
        met = pairs.join(sets.join(F.broadcast(again), "key", "left_anti"), "key")
        assert met.count() == 397
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning(key") == 1, final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
