import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import dedup
from pixelloom.llm.queries import op1_warc, op6_jaccard, op7_dedup, op10_lattice, oracle_sql

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import same  # noqa: E402


@pytest.mark.parametrize("query", [op1_warc, op6_jaccard, op7_dedup, op10_lattice])
def test_same_as_sql(spark, sf_dir, query):
    same(spark, sf_dir, query, oracle_sql()[query.__name__])


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    moves, slots = dedup.build_hash(keys)
    assert sorted(slots.tolist()) == list(range(n)) and np.array_equal(dedup.find(keys, moves, n), slots)


def strip(text):
    return (text or "").translate({ord(c): None for c in dedup.BLANK})


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = dedup.decide(odd_docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(strip(r.text), []).append(r)
    by = {hashlib.sha256(t.encode()).digest(): g for t, g in groups.items()}
    for r in got:
        g = by[bytes(r.digest)]
        best = min(g, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.keep_id, r.group_size) == (best.doc_id, len(g))
    assert sum(r.kept for r in got) == len(groups) == dedup.keep_first(odd_docs).count()
    clash = odd_docs.withColumnsRenamed({"key": "__key", "lang": "__row_0", "source": "rid"})
    kept = dedup.keep_first(clash)
    assert kept.columns == clash.columns and kept.count() == len(groups)
    assert dedup.decide(no_docs).count() == 0 and dedup.keep_first(no_docs).count() == 0


def test_history(spark, odd_docs):
    """Members join the group of their slot, nonmembers are groups of their own, whichever rows are historical."""
    rows = dedup.digest_rows(odd_docs)
    want = sorted(map(str, dedup.deduplicate(rows).select("digest", "doc_id", "rid", "size").collect()))
    for past in (F.lit(False), F.lit(True), F.col("rid") % 3 == 0):
        assert sorted(map(str, dedup.deduplicate(rows, past).select("digest", "doc_id", "rid", "size").collect())) == want
    assert dedup.deduplicate(rows, F.lit(False)).where("member").count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    out = dedup.decide(docs)
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000 and out.where("kept").count() == 2001


def test_ids_beyond_doubles_next_to_nulls(spark):
    """Longs stay longs: each keep_id is one of its group's ids."""
    big = 1 << 53
    rows = [(big + 1, "a b"), (big + 3, "ab "), (big + 5, "c"), (big + 7, " c"), (None, "c"), ((1 << 62) + 5, "d"), ((1 << 62) + 7, "d"), (-1, "e"), (None, "e"), (None, "f"), (-(1 << 62) - 1, "d "), (0, "g"), (None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t), i is None, i or 0, i))
    want = {(i, min(groups[strip(t)])[3], len(groups[strip(t)])) for i, t in rows}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in dedup.decide(docs).collect()} == want
    digests = dedup.digest_rows(docs)
    for past in (F.lit(False), F.lit(True), F.col("doc_id").isNull(), F.col("rid") % 2 == 0):
        assert {(r.doc_id, r.size) for r in dedup.deduplicate(digests, past).collect()} == {(min(g)[3], len(g)) for g in groups.values()}
