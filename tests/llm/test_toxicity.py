import numpy as np
from pyspark.sql import functions as F

from pixelloom.llm import toxicity
from pixelloom.llm.queries import CATEGORIES


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labels, judged on the others."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    chain = toxicity.fit(docs, labels.where(~held), CATEGORIES)
    c = toxicity.score(docs, chain).withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id")
    r = c.agg(F.sum((F.col("found") & (F.col("toxic") == 1)).cast("int")).alias("tp"), F.sum((F.col("found") & (F.col("toxic") == 0)).cast("int")).alias("fp"), F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    assert r.tp >= 0.8 * r.p and r.fp <= 0.01 * (r.n - r.p)


def test_later_models_see_earlier_probabilities(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"{'bad' if i % 2 else 'fine'} word{rng.integers(50)} word{rng.integers(50)}", i % 2, int(i % 2 and i % 8)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, a int, b int").withColumn("b", (F.col("b") > 0).cast("int"))
    chain = toxicity.fit(docs, labels, {"a": "a = 1", "b": "b = 1"})
    assert len(chain.models[0].chain) == 0 and len(chain.models[1].chain) == 1 and chain.models[1].chain[0] > 0
    out = toxicity.score(docs, chain)
    assert out.columns == ["doc_id", "key", "p_a", "p_b", "toxic"] and out.where("p_a > 0.5 and doc_id % 2 = 0").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    marks = spark.createDataFrame([(1, 1, 0, 5), (2, None, 1, 5), (None, 1, 1, 5), (8, 1, 1, 5)], "doc_id long, quality int, toxic int, text int")
    chain = toxicity.fit(odd_docs, marks, CATEGORIES)
    assert toxicity.score(odd_docs, chain).count() == odd_docs.count()
    assert toxicity.score(no_docs, chain).count() == 0
    out = toxicity.reject(odd_docs, chain)
    assert out.columns == odd_docs.columns
    nothing = toxicity.fit(no_docs, marks, CATEGORIES)
    assert toxicity.reject(odd_docs, nothing).count() == odd_docs.count()


def plain_chain(docs, marks, categories, folds=5):
    """The chain with dense matrices, loops and sets: (probabilities of every text, threshold). marks: (doc_id, values of the categories)."""
    import re

    from pixelloom.llm.common import hash_spans

    def number(word):  # a feature's number
        return int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    def feature_set(text):
        out = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            out.add(number(w) >> 44)
            if len(w) > 5:
                out.add((number(w[:5]) ^ (2**64 - 1)) >> 44)
        return out

    def logistic(v):
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def fit(sets, y, before):
        n, pos = len(y), sum(y)
        used = []
        for f in sorted(set().union(*sets)):
            has = np.array([f in s for s in sets])
            a, b = has[y == 1].mean(), has[y == 0].mean()
            p = has.mean()
            z = (a - b) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / pos + 1 / (n - pos)))
            if abs(z) > toxicity.SCREEN and has.sum() > 2:
                used.append(f)
        words = np.array([[f in s for f in used] for s in sets], float).reshape(n, len(used))
        x = np.column_stack([words, before, np.ones(n)])
        sizes = words.sum(axis=1)
        rate, t = 4.0 / (sizes.mean() + (sizes**2).mean() / max(sizes.mean(), 1) + before.shape[1] + 1), 1.0
        w = v = np.zeros(x.shape[1])
        for _ in range(120):
            grad = x.T @ (logistic(x @ v) - y) / n + 1e-3 * np.append(v[:-1], 0)
            new, t2 = v - rate * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return lambda s, b: float(logistic(sum(w[used.index(f)] for f in s if f in used) + np.dot(b, w[len(used) : -1]) + w[-1]))

    texts = dict(docs)
    rows = [m for m in marks if m[0] in texts]
    sets, fold = [feature_set(texts[m[0]]) for m in rows], np.arange(len(rows)) % folds
    outside, models = np.zeros((len(rows), 0)), []
    for j in range(len(categories)):
        y = np.array([m[1 + j] for m in rows])
        own = np.zeros(len(rows))
        for f in range(folds):
            rest = np.flatnonzero(fold != f)
            model = fit([sets[i] for i in rest], y[rest], outside[rest])
            for i in np.flatnonzero(fold == f):
                own[i] = model(sets[i], outside[i])
        models.append(fit(sets, y, outside))
        outside = np.column_stack([outside, own])
    p, y = outside[:, -1], np.array([m[-1] for m in rows])
    cuts = sorted(set(p), reverse=True)
    f1 = [2 * ((p >= c) & (y == 1)).sum() / ((p >= c).sum() + y.sum()) for c in cuts]
    k = int(np.argmax(f1))
    made = []
    for _, text in docs:
        s, b = feature_set(text), []
        for m in models:
            b.append(m(s, b))
        made.append(b)
    return made, (cuts[k] + (cuts[k + 1] if k + 1 < len(cuts) else 0)) / 2


def test_chain_by_brute_force(spark):
    """Every probability and the threshold, with ties, a very long text, nulls and repeated labels."""
    rng = np.random.default_rng(4)
    common = [f"word{k}" for k in range(30)]
    docs, marks = [], []
    for i in range(160):
        low, bad = i % 2, int(i % 4 == 1)
        words = rng.choice(common, 8).tolist() + ["Cheapest!"] * (low and rng.random() < 0.8) + ["awfully"] * (bad and rng.random() < 0.9) + ["awful"] * (bad and rng.random() < 0.3) + ["é🙂x"]
        docs.append((i, " ".join(rng.permutation(words).tolist())))
        marks.append((i, low, bad))
    docs += [(500, "word1 cheapest " * 20_000 + "awfully"), (501, None), (502, ""), (503, docs[1][1]), (504, docs[1][1])]
    marks += [(503, 1, 1), (504, 1, 1), (500, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - a, b) for i, a, b in marks] + [(900, 0, 1), (1, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(table, labels, CATEGORIES)
    order = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("doc_id", F.lit("toxicity")).alias("h")).collect()}
    want, threshold = plain_chain(docs, sorted(marks, key=lambda m: order[m[0]]), CATEGORIES)
    assert np.isclose(chain.threshold, threshold, atol=1e-9)
    got = {r.doc_id: (r.p_low_quality, r.p_toxic, r.toxic) for r in toxicity.score(table, chain).collect()}
    for (i, _), (a, b) in zip(docs, want):
        assert np.allclose(got[i][:2], (a, b), atol=1e-8) and got[i][2] == (b > threshold), i
    assert got[503] == got[504] == got[1] and len(chain.models[1].words)
