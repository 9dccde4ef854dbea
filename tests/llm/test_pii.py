import random
import re

from pixelloom.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans(spark, sf_dir, odd_docs, no_docs):
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "@", ".", "-", "1", "4111 1111 1111 1111", "+", "(", ")", " ", "255", "256", "8.8.8.8", "x_y@z.com", "é", "+1 (499) 555-6503", "000", "12345678901234"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    made += ["1" * 40_000, "a" * 40_000 + "@", "1." * 20_000, "+1" * 9_000, "a@b.c_x@d.e a@b.c@d.e", "1.2.3.4.5.6.7.8", "00000255.1.1.1 256.1.1.1"]
    many = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for docs in (many, spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        got = sorted(((r.doc_id, r.base_text) for r in pii.extract(docs).collect()), key=repr)
        assert got == sorted(((r.doc_id, brute(r.text)) for r in docs.collect()), key=repr)
    assert pii.extract(no_docs).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"call me at tel: +1 (415) 555-{1000 + i} now" for i in range(8)]
    unseen = ["my tel: 415-555-1234 is new", "the number 415-555-9999 is no phone", "tel: none"]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert rows[8].all_text == "phone:8:20" and rows[8].base_text == ""
    assert rows[9].all_text == "" and all(rows[i].all_text == rows[i].base_text != "" for i in range(8))
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[8] == "my tel: [PHONE] is new" and masked[9] == unseen[1] and masked[0] == "call me at tel: [PHONE] now"


def test_context_glued_to_the_identifier(spark):
    seeds = [f"write mailto:jo{i}@x.org now" for i in range(8)] + [f'{{"phone":"+1 (415) 555-{1000 + i}"}} and v10.0.0.{i}' for i in range(8)]
    unseen = ["write mailto:jo7[at]x.org now", '{"phone":"415-555-1234"}', "write other:jo7[at]x.org now", "v 1:2:3:4"]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert [rows[16 + i].all_text for i in range(4)] == ["email:13:25", "phone:10:22", "", "ip:2:9"]
    # places of the glued word without an identifier count as well
    more = [f"write mailto:nobody{i} now" for i in range(20)] + [f"v {w}" for w in "abcdefghijkl"]
    docs = docs.union(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert [rows[16 + i].all_text for i in range(4)] == ["", "phone:10:22", "", ""]


def test_shapes_without_decimal_digits(spark):
    """Texts without a decimal digit or an at sign are searched as well: [at], (at) and hex groups need neither."""
    seeds = [f"write mailto: jo{c}@x.org now" for c in "abcdefgh"] + [f"from host: 10.0.0.{i} now" for i in range(8)]
    unseen = ["write mailto: jo[at]x.org now", "write mailto: jo(at)x.org now", "from host: fe:ab:cd:ef now", "from other: fe:ab:cd:ef now"]
    docs = spark.createDataFrame(list(enumerate(seeds + unseen)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert [rows[16 + i].all_text for i in range(4)] == ["email:14:25", "email:14:25", "ip:11:22", ""]
    assert all(rows[i].all_text == rows[i].base_text != "" for i in range(16))


def test_copies_of_a_seed_document_keep_its_pattern(spark):
    seeds = [f"call me at tel: +1 (415) 555-{1000 + i} now" for i in range(8)]
    rows = [*enumerate(seeds + ["my tel: 415-555-1234 is new", "tel: none"]), *((100 + i, seeds[0]) for i in range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.all_text for r in pii.extract(docs).collect()}
    assert got[8] == "phone:8:20" and got[9] == ""
    # copies of one number alone are no support, and copies of other followers count against the pattern
    few = docs.where("doc_id < 2 or doc_id >= 8")
    assert {r.doc_id: r.all_text for r in pii.extract(few).collect()}[8] == ""
    other = docs.union(spark.createDataFrame([(1000 + i, "tel: none") for i in range(120)], "doc_id long, text string"))
    assert {r.doc_id: r.all_text for r in pii.extract(other).collect()}[8] == ""


def test_redaction_keeps_rows_and_columns(odd_docs):
    odd_docs = odd_docs.withColumnsRenamed({"key": "__row_key", "lang": "__spans"})
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    row = out.where("doc_id = 10").first()
    assert row.text == "mail [EMAIL], é ü 🙂" and row.n_chars == len(row.text)
    assert out.where("doc_id = 2").count() == 2 and out.where("text is null").count() == 2


def test_few_values_that_repeat_are_support(spark):
    seeds = [f"call me at tel: 1{'' if i % 2 else ' '}now +1 (415) 555-{1000 + i % 4} tel: +1 (415) 555-{1000 + i % 4}" for i in range(24)]
    docs = spark.createDataFrame([*enumerate(seeds), (99, "my tel: 415-555-1234")], "doc_id long, text string")
    assert {r.doc_id: r.all_text for r in pii.extract(docs).collect()}[99] == ""  # half of what follows is no number
    docs = spark.createDataFrame([*enumerate(x.replace("tel: 1", "now 1", 1) for x in seeds), (99, "my tel: 415-555-1234")], "doc_id long, text string")
    assert {r.doc_id: r.all_text for r in pii.extract(docs).collect()}[99] == "phone:8:20"


def test_scores_by_brute_force(spark):
    """Graph and scores against plain loops over the same texts, to the fixed point."""
    import collections
    import math

    rng = random.Random(11)
    heads, values = ["tel: ", "fax: ", "id ", "call=", "tel:"], ["+1 (415) 555-%d" % (1000 + i) for i in range(9)] + ["415-555-%d" % (2000 + i) for i in range(6)] + ["none"]
    texts = [" ".join(rng.choice(heads) + rng.choice(values) + " so" for _ in range(rng.randint(1, 6))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[^\W]+[^\s\w+(]*")
    edges, total = collections.Counter(), collections.Counter()
    for t in texts:
        total.update(m[0] for m in word.finditer(t))
        for m in re.finditer(r"\+1 \(415\) 555-\d{4}|(?<![^\s:=])415-555-\d{4}", t):
            edges[[x[0] for x in word.finditer(t[: m.start()])][-1], m[0]] += 1
    seeds = {w: len({v for x, v in edges if x == w and v[0] == "+"}) for w, _ in edges}
    edges = {k: n for k, n in edges.items() if seeds[k[0]] >= 3}
    score = {v: float(v[0] == "+") for _, v in edges}
    for _ in range(50):
        confidence = {w: min(1.0, sum(score[v] * n for (x, v), n in edges.items() if x == w) / total[w]) for w, _ in edges}
        score = {v: 1.0 if v[0] == "+" else 1 - math.prod(max(1e-9, 1 - confidence[w]) for w, x in edges if x == v) for v in score}
    scanned = pii.scan(docs).select("key", "doc_id", "base", "unseen").cache()
    graph = pii.pattern_graph(docs, scanned).where("kind = 3").cache()
    got = {r.word: r.confidence for r in pii.score(graph).collect()}
    assert got.keys() == confidence.keys() and all(abs(got[w] - confidence[w]) < 1e-2 for w in got)


def test_scores_of_a_long_chain(spark):
    """Sixty patterns, each of which learns of its values from the one before: scored until nothing moves, far beyond twenty rounds."""
    n, rows = 60, []
    for k in range(n):
        rows += [(0, f"w{k}", f"v{k}", k == 0, 4, 5), (0, f"w{k}", f"v{k + 1}", False, 1, 5)]
    graph = spark.createDataFrame(rows, "kind int, word string, value string, seed boolean, n long, total long")
    values = {v: float(s) for _, _, v, s, _, _ in sorted(rows, key=lambda r: r[3])}
    while True:
        sure = {w: min(1.0, sum(values[v] * c for _, x, v, _, c, _ in rows if x == w) / 5) for w in {r[1] for r in rows}}
        new = {}
        for v in values:
            miss = 1.0
            for _, w, x, _, _, _ in rows:
                if x == v:
                    miss *= max(1e-9, 1 - sure[w])
            new[v] = 1.0 if v == "v0" else 1 - miss
        done = max(abs(new[v] - values[v]) for v in values) < 1e-12
        values = new
        if done:
            break
    got = {r.word: r.confidence for r in pii.score(graph).collect()}
    assert got.keys() == sure.keys() and all(abs(got[w] - sure[w]) < 1e-3 for w in sure)
    assert any(abs(r.confidence - sure[r.word]) > 1e-3 for r in pii.score(graph, rounds=5).collect())
