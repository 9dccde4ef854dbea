import random
import sys
from pathlib import Path

from pixelloom.llm import urls
from pixelloom.llm.queries import RULES, op5_urls, oracle_sql

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import same  # noqa: E402


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    best = None
    for rule, verdict in rules:
        h, p = (rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) if "/" in rule else (rule, "")
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


def test_same_as_sql(spark, sf_dir):
    same(spark, sf_dir, op5_urls, oracle_sql()["op5_urls"])


def test_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "Example.com", "www.example.com", "a.www.example.com", "notexample.com", "x.net", "net", "a.b.c.d.e.net", "", "exämple.com", "com:80"]
    rows = [None, "", "no scheme/com/", "://", "http://com", "ftp://a://b.com/x"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/x', '/es/', '/fr/y?z#q', '#/en/', '?a/en/'])}" for _ in range(300)]
    rows.append("http://" + "a." * 5000 + "com/" + "x" * 50_000)
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(rows)] + [(None, rows[7], None, None), (0, None, None, None)], "page_id long, url string, rule string, host string")
    for rules in (RULES, [("com/en", "block"), ("com/en/x", "allow"), ("example.com", "block"), ("net/", "block"), (None, "block")], []):
        known = [r for r in rules if r[0]]
        got = {(r.url, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
        assert got == {(u, *brute(u, known)) for u in rows}
    assert urls.judge(pages, urls.rule_table(spark, RULES)).count() == pages.count()
    assert urls.judge(pages.where("false"), urls.rule_table(spark, RULES)).count() == 0


def test_many_rules_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(1, "http://a.example.com/en/1")], "page_id long, url string")
    assert urls.judge(pages, urls.rule_table(spark, RULES)).first().rule == "example.com/en/"
