import hashlib
import random
import zlib

import pytest

from pixelloom.llm import queries
from pixelloom.llm import sharding as S
from tests.compare import same


def greedy(sizes, capacity):
    """Shard of every size, in order."""
    out, shard, fill = [], 0, 0
    for s in sizes:
        if fill + s > capacity:
            shard, fill = shard + 1, 0
        out.append(shard)
        fill += s
    return out


def least(sizes, shards):
    return next(c for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1) if max(greedy(sizes, c)) < shards)


@pytest.mark.parametrize("kind", ["even", "wild", "hot", "few"])
def test_minimax_by_brute_force(spark, kind):
    """Capacity and cuts, from coarse runs that are refined in several steps."""
    rng = random.Random(kind)
    n = 9 if kind == "few" else 700
    sizes = [rng.randint(90, 110) if kind == "even" else int(rng.paretovariate(0.9)) + 1 for _ in range(n)]
    if kind == "hot":
        sizes[300] = sum(sizes) // 2
    digests = sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in range(n))
    groups = spark.createDataFrame(list(zip(digests, sizes)), "digest string, bytes long").cache()
    want = least(sizes, 16)
    for digits, resolved in ((1, 8), (2, 1024)):
        capacity, cuts = S.minimax(groups, 16, digits, resolved)
        assert capacity == want
        assert [sum(d >= c for c in cuts) for d in digests] == greedy(sizes, want)


def test_assign(spark):
    """Groups stay together, slots are gapless in order, a hot group is spread over tasks, odd rows have a place."""
    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(50) + str(k)) for k in range(300)] + [(1000 + k, "the same") for k in range(200)]
    rows += [(None, None), (None, None), (2000, None), (2001, ""), (2002, "é🙂" * 20_000), (None, "the same")]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, shard string, size int").repartition(5)
    got = S.assign(docs, 16).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by_digest = {}
    for r in got:
        assert by_digest.setdefault(r["digest"], r["shard"]) == r["shard"]
    for s in {r["shard"] for r in got}:
        own = sorted((r["slot"], r["digest"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    sizes = {}
    for r in got:
        sizes[r["digest"]] = sizes.get(r["digest"], 0) + r["size"]
    order = sorted(sizes)
    want = greedy([sizes[d] for d in order], least([sizes[d] for d in order], 16))
    assert [by_digest[d] for d in order] == want
    assert {(r["doc_id"], r["digest"], r["shard"]) for r in got} == {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["n"]) for r in S.with_shards(docs, 16, "n").collect()}


def test_write(spark, odd_docs, tmp_path):
    S.write(odd_docs, 3, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == odd_docs.count()


def test_no_rows(spark, no_docs):
    assert S.assign(no_docs, 16).count() == 0


def test_query(spark, sf_dir):
    same(spark, sf_dir, queries.op13_sharding, queries.oracle_sql()["op13_sharding"])
