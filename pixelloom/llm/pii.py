"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are the spans of four fixed expressions (email, ip, card, phone). The word left of a seed, with the punctuation that
follows it, induces a lexical pattern (kind, word). Patterns and the identifier-like strings that follow them make a bipartite
graph, which is scored in rounds until nothing moves: a pattern by the scores of its occurrences over all occurrences of its word
in the corpus, an instance by the patterns that lead to it. Patterns of high confidence give spans to strings that the expressions miss.

Defined cases: a null text is empty and has no spans; a null id keeps its row; rows that are equal in id and text get
the same spans; an empty table gives no rows; extra columns are ignored; texts are read whole, and neither words nor
identifiers have a greatest length. Offsets count code points and ends are exclusive. A discovered span never overlaps a seed of its text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import drop_scratch, materialize, row_key

KINDS = ("email", "ip", "card", "phone")
#: Scoring ends when all confidences together rise by less than this in a round.
STILL = 1e-4
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.5

# The fixed expressions in a form that needs no backtracking and no deep stack: possessive where the next character
# can't be part of the repetition, and started only where a run starts or the last match ended.
_LOCAL = r"A-Za-z0-9._%+-"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "contains(text, '@')", "ip": "digits", "card": "digits", "phone": "contains(text, '+')"}
#: Strings that look like an identifier of a kind though no fixed expression takes them.
UNSEEN = {
    "email": r"(?<![^\s:=<\"'(])[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9.-]++",
    "ip": r"(?<![^\s:=\"'(])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}){3,7}",
    "card": r"(?<![^\s:=\"'(])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{3,4}(?:[\x20-]?[0-9]{1,4})?",
    "phone": r"(?<![^\s:=\"'(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
}
#: What a text must hold for a shape to be looked for: an [at] needs no sign of its own, and groups of hex digits no decimal one.
UNSEEN_NEEDS = {"email": "contains(text, '@') OR contains(text, '[at]') OR contains(text, '(at)')", "ip": "contains(text, ':')", "card": "digits", "phone": "digits"}
#: A context word: letters, digits and low lines, and the punctuation after them that no span begins with; all such words of a
#: text, and the last one of what stands left of a span.
_WORD = r"[\p{L}\p{N}_]++[^\s\p{L}\p{N}_+(]*+"
WORDS = _WORD
LAST_WORD = rf"(?<![\p{{L}}\p{{N}}_])({_WORD})[^\p{{L}}\p{{N}}_]*+$"
#: Matches of a text whose places are summed up together.
RUN = 128


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _luhn(d: str) -> str:
    x = f"cast(substr({d}, i, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN (length({d}) - i) % 2 = 0 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) % 10 = 0"


def _holds(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
        "card": f"(length({digits}) BETWEEN 14 AND 19) AND ({_luhn(digits)})",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }[kind]


def _found(pattern: str, kind: str, keep: str | None, when: str) -> str:
    """SQL for the array of (start, kind_no, end, value, word, glued) of a pattern's matches in `text`. word: the context word;
    glued: whether it touches the match, so that the corpus has it as part of a longer word."""
    no, p = KINDS.index(kind), _sql(pattern)
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string,left:string>>)"
    none = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string,word:string,glued:boolean>>)"
    # gaps and matches by turns; places are summed up in runs, so the work stays near linear in the matches
    parts = f"transform(slice(split(text, {p}, -1), 1, size(m)), (g, i) -> struct(length(g) AS g, m[i] AS v, length(m[i]) AS k, CASE WHEN i = 0 THEN g ELSE concat(m[i - 1], g) END AS left))"
    runs = f"transform(array({parts}), l -> transform(sequence(1, size(l), {RUN}), i -> slice(l, i, {RUN})))[0]"
    starts = "aggregate(r, struct(0 AS at, cast(array() AS array<int>) AS o), (a, b) -> struct(a.at + aggregate(b, 0, (t, x) -> t + x.g + x.k) AS at, concat(a.o, array(a.at)) AS o), a -> a.o)"
    placed = (
        f"flatten(zip_with(r, {starts}, (b, o) -> aggregate(b, struct(o AS at, {empty} AS found),"
        f" (a, x) -> struct(a.at + x.g + x.k AS at, concat(a.found, array(struct(a.at + x.g AS start, {no} AS kind, a.at + x.g + x.k AS end, x.v AS value, x.left AS left))) AS found), a -> a.found)))"
    )
    word = f"lower(regexp_extract(s.left, {_sql(LAST_WORD)}, 1))"
    named = f"transform(filter({placed}, s -> {keep or 'true'}), s -> struct(s.start AS start, s.kind AS kind, s.end AS end, lower(s.value) AS value, {word} AS word, s.left rlike {_sql('[\\p{L}\\p{N}_]$')} AS glued))"
    # m and r are bound once through one-element arrays
    return f"CASE WHEN {when} THEN transform(array(regexp_extract_all(text, {p}, 0)), m -> CASE WHEN size(m) = 0 THEN {none} ELSE transform(array({runs}), r -> {named})[0] END)[0] ELSE {none} END"


def scan(docs: DataFrame) -> DataFrame:
    """Rows (key, doc_id, text, base, unseen): base and unseen are arrays of (start, kind, end, value, word, glued); base is ordered by
    start and kind, unseen ones overlap no base span."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key("doc_id", "text").alias("key")
    ).withColumn("digits", F.expr("text rlike '[0-9]'"))
    base = ", ".join(_found(EXPRESSIONS[k], k, _holds(k, "s.value"), NEEDS[k]) for k in KINDS)
    unseen = ", ".join(_found(UNSEEN[k], k, None, UNSEEN_NEEDS[k]) for k in KINDS)
    rows = rows.withColumn("base", F.expr(f"sort_array(concat({base}))"))
    rows = rows.withColumn("unseen", F.expr(f"concat({unseen})"))
    return rows.withColumn(
        "unseen", F.expr("CASE WHEN size(unseen) = 0 THEN unseen ELSE filter(unseen, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end)) END")
    )


def pattern_graph(docs: DataFrame, scanned: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Materialized edges (kind, word, value, seed, n, total): n occurrences of a value after a pattern that enough distinct seeds
    induce, total occurrences of its word in the corpus. scanned: a materialized table with base and unseen."""
    nodes = scanned.select(F.explode(F.expr("concat(transform(base, s -> struct(s.kind, s.word, s.value, s.glued, true AS seed)), transform(unseen, s -> struct(s.kind, s.word, s.value, s.glued, false AS seed)))")).alias("s"))
    edges = materialize(
        nodes.where("s.word <> ''").groupBy("s.kind", "s.word", "s.value").agg(F.max("s.seed").alias("seed"), F.count("*").alias("n"), F.count_if("s.glued").alias("glued")), "pii-edges"
    )
    # only patterns that enough seeds induce can pass; the corpus is counted for their words alone
    induced = edges.groupBy("kind", "word").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum("n").alias("n"), F.sum("glued").alias("glued"))
    induced = materialize(induced.where(F.col("seeds") >= min_support).select("kind", "word", "n", "glued"), "pii-patterns")
    every = docs.select(F.explode(F.expr(f"regexp_extract_all(coalesce(cast(text AS string), ''), {_sql(WORDS)}, 0)")).alias("word")).select(F.lower("word").alias("word"))
    every = every.join(induced.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    # a word that touches its identifier is part of a longer one in the corpus
    total = F.greatest(F.coalesce("places", F.lit(0)) + F.col("glued"), F.col("n")).alias("total")
    graph = materialize(edges.drop("glued").join(induced.join(every, "word", "left").select("kind", "word", total), ["kind", "word"]), "pii-graph")
    drop_scratch(edges, induced)
    return graph


def score(graph: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (kind, word, support, confidence) of the patterns of a graph. Seeds have score 1, other values 1 - product of (1 - confidence)
    over their patterns; support is the sum of the scores of distinct values, confidence the scores of a pattern's occurrences over
    all occurrences of its word. Scores only rise and none exceeds 1, so the rounds end: when the sum of confidences stands still, however
    many that takes. rounds: an earlier end, for experiments."""
    values = graph.select("kind", "value", F.col("seed").cast("double").alias("score")).groupBy("kind", "value").agg(F.max("score").alias("score"))
    before, old = -1.0, None
    for _ in itertools.count() if rounds is None else range(rounds):
        patterns = graph.join(values, ["kind", "value"]).groupBy("kind", "word").agg(F.sum("score").alias("support"), F.sum(F.col("score") * F.col("n")).alias("sure"), F.max("total").alias("total"))
        patterns = materialize(patterns.select("kind", "word", "support", F.least(F.lit(1.0), F.col("sure") / F.col("total")).alias("confidence")), "pii-scores")
        if old is not None:
            drop_scratch(old)
        old, now = patterns, patterns.agg(F.sum("confidence")).first()[0] or 0.0
        if now - before < STILL:
            break
        before = now
        miss = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        seed = graph.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
        values = graph.join(patterns, ["kind", "word"]).groupBy("kind", "value").agg(miss.alias("miss")).join(seed, ["kind", "value"])
        values = values.select("kind", "value", F.when(F.col("seed"), F.lit(1.0)).otherwise(1 - F.exp("miss")).alias("score"))
    return old


def discover(docs: DataFrame, scanned: DataFrame, rounds: int | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rows (key, doc_id, found): spans that patterns of high confidence give. scanned: a materialized table with key, doc_id, base, unseen."""
    graph = pattern_graph(docs, scanned, min_support)
    patterns = score(graph, rounds)
    drop_scratch(graph)
    good = patterns.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).select("kind", "word")
    spans = scanned.where("size(unseen) > 0").select("key", "doc_id", F.explode("unseen").alias("s")).select("key", "doc_id", F.col("s.kind").alias("kind"), F.col("s.word").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    spans = spans.join(good, ["kind", "word"]).select("key", "doc_id", F.struct("start", "kind", "end").alias("s")).distinct()
    return spans.groupBy("key", "doc_id").agg(F.collect_list("s").alias("found"))


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)))"


def extract(docs: DataFrame, **settings) -> DataFrame:
    """Per document its spans: columns doc_id, key, base, found (arrays of start, kind, end) and the joined forms."""
    scanned = materialize(scan(docs).select("key", "doc_id", "base", "unseen"), "pii-scan")
    found = discover(docs, scanned, **settings).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "found")
    short = "transform(base, s -> struct(s.start AS start, s.kind AS kind, s.end AS end))"
    out = scanned.select("key", "doc_id", F.expr(short).alias("base")).join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("k", "d")
    out = out.withColumn("found", F.expr("sort_array(coalesce(found, array()))"))
    out = out.withColumn("all", F.expr("sort_array(concat(base, found))"))
    return out.withColumns({"base_text": F.expr(_joined("base")), "all_text": F.expr(_joined("all"))})


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span replaced by its kind in brackets and n_chars counted anew; all rows and columns stay, whatever their
    names; null texts stay null."""
    spans = extract(docs, **settings).where("size(all) > 0").select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), F.col("all").alias("__spans")).dropDuplicates(["__key", "__id"])
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    own = docs.toDF(*(f"__row_{i}" for i in range(len(docs.columns))))  # so that no column has a name that is used here
    at = {c: f"__row_{i}" for i, c in enumerate(docs.columns)}
    text = at["text"]
    cut = (
        f"aggregate(__spans, struct(0 AS at, '' AS out), (a, s) -> CASE WHEN s.start < a.at THEN struct(greatest(a.at, s.end) AS at, a.out AS out)"
        f" ELSE struct(s.end AS at, concat(a.out, substring({text}, a.at + 1, s.start - a.at), {names}[s.kind]) AS out) END,"
        f" a -> concat(a.out, substring({text}, a.at + 1)))"
    )
    rows = own.join(spans, (F.xxhash64(at["doc_id"], text) == F.col("__key")) & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("__id")), "left")
    rows = rows.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.expr(cut)))
    if n := at.get("n_chars"):
        rows = rows.withColumn(n, F.when(F.col("__spans").isNull(), F.col(n)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.select(*own.columns).toDF(*docs.columns)
