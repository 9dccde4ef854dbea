"""URL filters: every URL is expanded into host suffixes and path prefixes, equi-joined with the rules on a short hash
prefix, and confirmed by full digests; the longest rule that fits wins.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
Defined cases: a null url or one without `://` has an empty host and path and fits no rule; equal urls are judged once;
an empty rule or page table works; extra columns are ignored. Of rules of equal length that of the longer host wins,
then a block before an allow. A url that fits no rule gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rules that are broadcast; more are joined by shuffle.
MAX_BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """(host, path) columns of a url column."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (rule, verdict): a rule is host and path, like `example.com/en/`."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def _digest(x):
    full = F.sha2(x, 256)
    return full, F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict added (a column of pages of these names is replaced)."""
    full, short = _digest(F.col("rule"))
    host = F.substring_index("rule", "/", 1)
    known = rules.select("rule", F.col("verdict").alias("_verdict"), host.alias("_host")).where("rule is not null").withColumns({"_full": full, "_short": short})
    known = known.withColumn("_path", F.expr("length(rule) - length(_host)"))
    row = known.agg(
        F.count("*").alias("n"), F.collect_set("_path").alias("paths"), F.max(F.size(F.split("_host", r"\."))).alias("labels")
    ).first()  # the distinct path lengths of rules, not the rules
    lengths, labels = sorted(row["paths"] or [0]), row["labels"] or 1
    out = pages.drop("host", "path", "rule", "verdict").withColumn("__url", F.coalesce(F.col(url_col), F.lit("")))
    h, p = split_url(F.col("__url"))
    urls = out.select("__url").distinct().withColumns({"host": h, "path": p})
    # host suffixes of as many labels as any rule has, path prefixes of every length that any rule has
    hosts = f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), i -> substring_index(host, '.', -i))"
    paths = f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> left(path, n))"
    tried = urls.where("host <> ''").select("__url", F.explode(F.expr(f"flatten(transform({hosts}, x -> transform({paths}, y -> concat(x, y))))")).alias("_tried"))
    full, short = _digest(F.col("_tried"))
    tried = tried.select("__url", full.alias("_want"), short.alias("_short"))
    side = known.select("_short", "_full", "rule", "_verdict", "_host")
    side = F.broadcast(side) if row["n"] <= MAX_BROADCAST_RULES else side
    hit = tried.join(side, "_short").where("_want = _full")
    best = F.max(F.struct(F.length("rule"), F.length("_host"), F.col("_verdict") == "block", F.col("rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("b")
    hit = hit.groupBy("__url").agg(best).select("__url", "b.rule", "b.verdict")
    found = urls.join(hit, "__url", "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.join(found, "__url").drop("__url")
