import sys
from pathlib import Path

from pixelloom.llm.graph import components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(1000, k) for k in range(2000, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == 100 and all(got[k] == 1000 for k in range(2000, 2100))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    lost = components(spark.createDataFrame([(None, 5), (6, None), (None, None), (8, 8), (1, 2)], "a long, b long"))
    assert {(r.node, r.component) for r in lost.collect()} == {(1, 1), (2, 1)}


def test_stages(spark, sf_dir):
    sys.path.insert(0, str(Path(__file__).parent.parent.parent))
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    rows = docs
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns
        rows = spark.createDataFrame(rows.collect(), docs.schema)
        seen.append(rows.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0] and seen[4] == seen[3]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert rows.join(labels.where("toxic = 1"), "doc_id").count() <= 0.3 * labels.where("toxic = 1").count()
    pieces = P.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == seen[-1]


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline as P

    for docs in (odd_docs, no_docs):
        rows = docs
        for _, stage in P.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == docs.columns
        assert (P.STAGES[-1][1](spark, rows, sf_dir).count() > 0) == (docs is odd_docs)


def test_run_by_brute_force(spark, sf_dir):
    """The whole pipeline against plain versions of its stages: the chain in numpy, groups of equal texts, all pairs of shingle sets, spans cut
    one by one, and the library's ids in windows."""
    from pyspark.sql import functions as F
    from test_jaccard import brute
    from test_packing import check
    from test_toxicity import plain_chain
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from pixelloom.llm import pii
    from pixelloom.llm.dedup import BLANK
    from pixelloom.llm.queries import CATEGORIES, WORD_BPE

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    order = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("doc_id", F.lit("toxicity")).alias("h")).collect()}
    labels = [(r.doc_id, int(r.quality == 0), int(r.toxic == 1)) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    found, threshold = plain_chain(docs, sorted((m for m in labels if m[0] in order), key=lambda m: order[m[0]]), CATEGORIES)
    clean = [d for d, p in zip(docs, found) if not p[-1] > threshold]
    groups: dict[str, list] = {}
    for id_, text in clean:
        groups.setdefault((text or "").translate({ord(c): None for c in BLANK}), []).append((-len(text or ""), id_, text))
    single = sorted((min(g)[1], min(g)[2]) for g in groups.values())
    lowest = {id_: (n, low) for id_, n, low in brute(single, 5, 80)}
    apart = [(id_, text) for id_, text in single if lowest[id_][0] == 0 or lowest[id_][1] == id_]
    rows = table
    for (_, stage), want in zip(P.STAGES[:3], (clean, single, apart)):
        rows = stage(spark, rows, sf_dir)
        assert sorted((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()) == sorted(want)
    assert len(docs) > len(clean) > len(single) > len(apart)
    kept = spark.createDataFrame(apart, "doc_id long, text string")
    spans = {r.doc_id: r.all_text for r in pii.extract(kept).select("doc_id", "all_text").collect()}
    masked = []
    for id_, text in apart:
        at, out = 0, ""
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[id_].split(",") if s)), key=lambda s: s[1]):
            if a >= at:
                out += f"{text[at:a]}[{kind.upper()}]"
            at = max(at, b)
        masked.append((id_, out + text[at:]))
    assert masked != apart
    check(P.run(spark, sf_dir).collect(), masked, Tokenizer.from_file(WORD_BPE))


def test_stages_begin_with_small_heaps(spark, sf_dir):
    """Heap that earlier work has made the JVM take is given back before a stage begins: in a local run the executor's JVM is this one."""
    import corpus_pipeline as P

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for _, stage in P.STAGES:
        before = full()
        stage(spark, docs, sf_dir)
        assert full() > before
