"""N-gram Jaccard join by token-combination prefixes.

A text's tokens (hashes of its word n-grams) are ordered rare ones first, then by hash. A prefix long enough that two similar
texts must share part of it is indexed: rare tokens singly; where a text hasn't enough of them, its prefix is extended by
frequent tokens, indexed in pairs within classes by a second hash. A class with i tokens loses one, so rare tokens plus
frequent ones less the number of their classes must reach p = size - least overlap + 1. An entry carries the largest size that
a partner found there first can have (its reach), so two texts are compared only where both lie within the other's reach.

Only the tokens of lowest hash are kept at first; texts that need more of them are read again in full. Texts that share an index entry
are first compared with the entry's representative, the text whose tokens are shared most; then, where an entry's texts are
still in different components, those outside its largest component are compared with the others: in blocks inside tasks if
the entry is large, else in random slots of a few texts, and at last every such pair that wasn't compared yet. So a large group
of near copies costs about as many comparisons as it has texts, no pair of it becomes a row, and no link between components is
lost. A comparison takes place at its hub, the text that many others are compared with: a hub's texts are dealt into buckets of
HUB, and the hub's own text goes to each bucket once. Links are verified word by word on whole texts, but for those inside
blocks, which compare 64-bit hashes of all tokens.

Defined cases: a null text is empty; texts without words link with nothing; texts of fewer words than n are one token;
equal sets are one class (128-bit identity) and link; repeated rows and repeated or null ids are allowed, a component's id is
its smallest non-null id; empty tables give no rows; extra columns are ignored. Thresholds lie above one half.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import MULTIPLIER, chunks, drop_scratch, few_rows, free_shuffles, materialize, member, mix, row_key, scratch_path, shingle_sets, small_counts, small_keys, text_bytes, tidy
from pixelloom.llm.graph import components

#: Tokens that more texts than this have in their prefixes are frequent.
RARE = 32
#: Most frequent tokens; beyond it the bound above is doubled, which changes no result. Also the most keys that are broadcast.
MAX_FREQUENT = 1_000_000
#: Texts of a random slot, and rounds of slots before all pairs that are left.
SLOT = 8
ROUNDS = 1
#: Texts of an entry beyond which its pairs are compared inside tasks, at most BLOCK texts and about BLOCK_TOKENS tokens a side.
HOT = 256
BLOCK = 1024
BLOCK_TOKENS = 1_000_000
#: Texts that are compared with a hub in one place.
HUB = 256
SETS = "rid long, doc_id long, key long, n long, cls long, cls2 long, toks array<long>"


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of which two sets of similarity num/den, one of size n, share one at least."""
    return n - -(-num * n // den) + 1


def classes(scheme: int, num: int, den: int) -> int:
    """Classes of frequent tokens: fewer than the least overlap of sets of this scheme, so that two such sets share two tokens of a class."""
    return max(1, min((1 << scheme) // 2, -(-(num << scheme) // den) - 1))


def schemes(n: int, num: int, den: int) -> list[int]:
    """Size classes under which a set is indexed: its own, and the next if a partner may lie there."""
    b = n.bit_length() - 1
    return [b, b + 1] if n * den >= num << (b + 1) else [b]


def signatures(toks: np.ndarray, n: int, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set of size n from its lowest tokens, and their places in the prefix: what must be missing before an entry
    for it to be the first that is shared."""
    p = prefix_length(n, num, den)
    often = member(toks, frequent)
    rare = toks[~often][:p]
    sigs, places = [rare], [np.arange(len(rare))]
    if len(rare) < p:
        toks = toks[often]
        kind = mix(toks.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
        for scheme in schemes(n, num, den):
            own = (kind % np.uint64(classes(scheme, num, den))).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(own[order]) > 0)), len(order)) if len(order) else np.zeros(1, np.int64)
            gain = len(rare)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # class by class
                if gain >= p:
                    break
                if y - x < 2:
                    continue
                t = toks[order[x:y]][: p - gain + 1].view(np.uint64)
                i, j = np.triu_indices(len(t), 1)
                sigs.append(mix(t[i] * np.uint64(MULTIPLIER) + mix(t[j]) + np.uint64(scheme + 1)).view(np.int64))
                places.append(gain + j - 1)
                gain += len(t) - 1
    return np.concatenate(sigs), np.concatenate(places)


def reach(n: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest partner of a set of size n whose first shared entry has this place: num (n + m) <= (n - place) (num + den)."""
    return (n - place) * (num + den) // num - n


def kept(n: int, num: int, den: int) -> int:
    """Tokens of a set that are kept at first: the prefix and room for some frequent ones."""
    p = prefix_length(n, num, den)
    return p + p // 4 + 6


def token_sets(docs: DataFrame, size: int, num: int, den: int, whole: bool = False) -> DataFrame:
    """Per row (rid, doc_id, key, n, cls, cls2, toks): a unique number, the row's key, set size, identity of the set, and its lowest
    tokens or all of them. docs may carry a column __rid."""

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(3))
            ns, cls, toks = [], [], []
            for i, j in chunks(off):
                for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size):
                    n = len(s)
                    ns.append(n)
                    both = np.array([mix(s).sum(), mix(s ^ np.uint64(0xA24BAED4963EE407)).sum()], np.uint64)
                    cls.append(mix(both + np.uint64(n)).view(np.int64))
                    s = np.sort(s.view(np.int64))
                    toks.append(s if whole or not n else s[: kept(n, num, den)])
            ends = np.cumsum([0, *map(len, toks)]).astype(np.int32)
            flat = np.concatenate(toks) if toks else np.zeros(0, np.int64)
            one, two = np.array(cls, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(ns, pa.int64()), pa.array(one), pa.array(two), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                [c.split()[0] for c in SETS.split(", ")],
            )

    rid = F.col("__rid") if "__rid" in docs.columns else F.monotonically_increasing_id()
    return docs.select(rid, F.col("doc_id").cast("long"), row_key("doc_id", "text"), F.col("text").cast("string")).mapInArrow(tidy(run), SETS)


def _signature_rows(sets: DataFrame, sent, num: int, den: int) -> DataFrame:
    """Rows (sig, key, n, reach, single, score). sent: a broadcast of the frequent tokens, and of the tokens that two sets have at least
    with the logarithms of their counts (None if they are too many). score: how much the tokens of a set's prefix are shared."""

    def run(batches):
        frequent, wanted = sent.value
        for b in batches:
            values, ends = b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            ns = b.column(1).to_numpy()
            if wanted is not None:
                at = np.searchsorted(wanted[0], values)
                at[at == len(wanted[0])] = 0
                shared = (wanted[0][at] == values) if len(wanted[0]) else np.zeros(len(values), bool)
                weight = np.where(shared, wanted[1][at] if len(wanted[0]) else 0.0, 0.0)
            else:
                shared, weight = np.ones(len(values), bool), member(values, frequent).astype(float)
            weight = np.append(0.0, np.cumsum(weight))
            sigs, places, counts, single = [], [], [], []
            for i, n in enumerate(ns.tolist()):
                t = values[ends[i] : ends[i + 1]]
                s, at = signatures(t, n, frequent, num, den)
                if wanted is not None:
                    # entries that are single tokens of one set only lead nowhere
                    use = ~member(s, t[~shared[ends[i] : ends[i + 1]]])
                    s, at = s[use], at[use]
                sigs.append(s)
                places.append(at)
                counts.append(len(s))
                single.append(member(s, t))
            score = (weight[ends[1:]] - weight[ends[:-1]]) / np.maximum(np.diff(ends), 1)
            rep = lambda x: np.repeat(x, counts)
            cat = lambda x, kind=np.int64: np.concatenate([np.zeros(0, kind), *x])
            far = reach(rep(ns), cat(places), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cat(sigs), rep(b.column(0).to_numpy()), rep(ns), far, cat(single, bool), rep(score))], ["sig", "key", "n", "reach", "single", "score"])

    return sets.select("key", "n", "toks").mapInArrow(tidy(run), "sig long, key long, n long, reach long, single boolean, score double")


def _short(sets: DataFrame, sent, num: int, den: int) -> DataFrame:
    """Keys of sets that are known in part only and hold too few rare tokens. sent: the frequent tokens, broadcast."""

    def run(batches):
        frequent = sent.value
        for b in batches:
            values, ends = b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            often = np.append(0, np.cumsum(member(values, frequent)))
            ns, sizes = b.column(1).to_numpy(), np.diff(ends)
            rare = sizes - (often[ends[1:]] - often[ends[:-1]])
            need = np.array([prefix_length(n, num, den) for n in ns.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array((sizes < ns) & (rare < need)))], ["key"])

    return sets.select("key", "n", "toks").mapInArrow(tidy(run), "key long")


def _texts(docs: DataFrame, rows: DataFrame, keys: DataFrame, name: str | None) -> DataFrame:
    """Rows (__rid, doc_id, text) of the sets with these keys, materialized if a name is given. rows: (rid, doc_id, key) of all."""
    where = materialize(rows.select("rid", F.col("doc_id").alias("__id"), F.col("key").alias("__key")).join(keys.select(F.col("key").alias("rid")), "rid", "left_semi"), "jaccard-where")
    small = F.broadcast(where) if where.count() <= MAX_FREQUENT else where
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("doc_id", "text").alias("__own"))
    found = own.join(small, (F.col("__own") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select(F.col("rid").alias("__rid"), "doc_id", "text")
    if name is None:
        return found
    found = materialize(found.select("__rid", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), name)
    drop_scratch(where)
    return found


def _dealt_once(sets: DataFrame) -> DataFrame:
    """Sets as a table in the shared folder that is bucketed by their keys: dealt out here, and never again, for a join on the key then moves
    its other side alone."""
    spark = sets.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"pixelloom_sets_{uuid.uuid4().hex}"
    sets.repartition(n, "key").write.bucketBy(n, "key").sortBy("key").option("path", scratch_path(spark, "jaccard-sets")).saveAsTable(name)
    return spark.table(name)


def _all(sets: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, sets)


def _complete(docs: DataFrame, rows: DataFrame, sets: list[DataFrame], dealt: bool, frequent: np.ndarray, size: int, num: int, den: int) -> tuple[list[DataFrame], np.ndarray, DataFrame | None, int]:
    """(sets, frequent tokens, tokens that were added, sum of the bounds used): until every set has enough rare tokens or is known in full. Tokens that
    many of the sets read again have in common are frequent as well; that changes the order of tokens, but for all sets alike. dealt: the
    sets are bucketed, and stay apart from those read again, so that they keep their buckets."""
    added, bound = None, 0
    while True:
        sent = docs.sparkSession.sparkContext.broadcast(frequent)
        short = materialize(_short(_all(sets), sent, num, den), "jaccard-short")
        sent.destroy()
        n = short.count()
        if not n:
            drop_scratch(short)
            return sets, frequent, added, bound
        ids = F.broadcast(short) if n <= MAX_FREQUENT else short
        full = token_sets(_texts(docs, rows, short, None), size, num, den, whole=True)
        full = materialize(full.select(F.col("rid").alias("key"), "n", "toks").dropDuplicates(["key"]), "jaccard-full")
        now = [*(x.join(ids, "key", "left_anti") for x in sets), full]
        if n > MAX_FREQUENT:  # else the few that changed are left out at each reading
            now = [_dealt_once(_all(now))]
        elif not dealt:
            now = [_all(now)]
        own = full.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("c"))
        own = materialize(own, "jaccard-added")
        if n > MAX_FREQUENT:
            drop_scratch(*sets, full, short)
        sets, added = now, own if added is None else added.unionByName(own)
        rare = RARE
        while (more := small_keys(own.where(F.col("c") > rare).select("tok"), MAX_FREQUENT)) is None:
            rare *= 2
        bound += rare
        frequent = np.union1d(frequent, more)


def _at_hubs(pairs: DataFrame, payload: list[DataFrame], column: str, judge) -> DataFrame:
    """Rows (hub, mem, nh, nm) of pairs that judge() accepts. payload: tables (key, <column>), maybe with repeats. judge(hub's n, payload,
    memory of the hub) gives a function of a partner's n and payload."""
    kind = payload[0].schema[column].dataType.simpleString()
    deg = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB).alias("salts"))
    dealt = materialize(pairs.join(deg, "hub").withColumn("salt", F.pmod(F.xxhash64("mem"), F.col("salts"))).select("hub", "mem", "salt", "nh", "nm"), "jaccard-dealt")
    own = lambda rows, name: _all([rows.join(p.withColumnRenamed("key", name), name) for p in payload])
    mem = own(dealt, "mem").select("hub", "salt", "mem", "nh", "nm", column)
    hub = own(dealt.select("hub", "salt", "nh").distinct(), "hub").select("hub", "salt", F.lit(None).cast("long").alias("mem"), "nh", F.lit(None).cast("long").alias("nm"), column)
    rows = hub.unionByName(mem).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("mem").asc_nulls_first())

    def run(batches):
        now = check = None
        for b in batches:
            out = []
            whole = b.column(5)
            for i, (h, salt, m, nh, nm) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)))):
                if m is None:
                    if now != (h, salt):
                        now, check = (h, salt), judge(nh, whole[i])
                elif now == (h, salt) and check(nm, whole[i]):
                    out.append((h, m, nh, nm))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["hub", "mem", "nh", "nm"])

    assert kind in ("string", "array<bigint>")
    found = materialize(rows.mapInArrow(tidy(run), "hub long, mem long, nh long, nm long"), f"jaccard-{column}-passed")
    drop_scratch(dealt)
    return found


def _sketch_judge(num: int, den: int):
    """Whether two sets may be similar by the tokens that are known of both: below the lower of their bounds all are known, beyond
    it they share no more than the rest."""

    def judge(n, toks):
        mine = toks.values.to_numpy()
        last = mine[-1] if len(mine) < n else np.int64(2**63 - 1)

        def check(m, other):
            theirs = other.values.to_numpy()
            end = min(last, theirs[-1] if len(theirs) < m else last)
            a, b = mine[: np.searchsorted(mine, end, "right")], theirs[: np.searchsorted(theirs, end, "right")]
            most = len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))
            return most * (num + den) >= num * (n + m)

        return check

    return judge


def _text_judge(size: int, num: int, den: int):
    """Whether two texts are similar, word by word: words become numbers, and so do the n-grams, joined one word at a time."""

    def judge(_, text):
        known: dict[bytes, int] = {}
        numbers = lambda t: np.fromiter((known.setdefault(w, len(known)) for w in t.as_buffer().to_pybytes().lower().split()), np.int64)
        mine = numbers(text)

        def check(_, other):
            theirs = numbers(other)
            if min(len(mine), len(theirs)) < size:
                return len(mine) == len(theirs) and bool((mine == theirs).all())
            a, b = mine, theirs
            for j in range(1, size):
                x, y = a[:-1] * len(known) + mine[j:], b[:-1] * len(known) + theirs[j:]
                codes = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
                a, b = codes[: len(x)], codes[len(x) :]
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both * den >= num * (len(a) + len(b) - both)

        return check

    return judge


def _only(sets: list[DataFrame], keys: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(sets without those that a join with these keys would read for nothing, the materialized keys). Beyond MAX_FREQUENT keys all sets stay:
    then there are so many of them that they lie in buckets, and the join moves the keys."""
    keys = materialize(keys.distinct(), "jaccard-met")
    return ([x.join(F.broadcast(keys), "key", "left_semi") for x in sets] if keys.count() <= MAX_FREQUENT else sets), keys


def _verified(docs: DataFrame, rows: DataFrame, sets: list[DataFrame], pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among pairs (hub, mem, nh, nm)."""
    met, keys = _only(sets, pairs.select(F.explode(F.array("hub", "mem")).alias("key")))
    likely = _at_hubs(pairs, [x.select("key", "toks") for x in met], "toks", _sketch_judge(num, den))
    drop_scratch(keys)
    if not likely.limit(1).count():
        return likely.select(F.col("hub").alias("a"), F.col("mem").alias("b"))
    ids = materialize(likely.select(F.explode(F.array("hub", "mem")).alias("key")).distinct(), "jaccard-ids")
    texts = _texts(docs, rows, ids, "jaccard-texts").select(F.col("__rid").alias("key"), "text")
    links = _at_hubs(likely, [texts], "text", _text_judge(size, num, den))
    drop_scratch(texts, ids, likely)
    return links.select(F.col("hub").alias("a"), F.col("mem").alias("b"))


def link(docs: DataFrame, size: int, num: int, den: int = 100, max_broadcast: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, comps): rows (doc_id, key, n, node) for every document, node being null without words; comps (node,
    component) for nodes that link with others. Texts of equal sets share a node."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must lie above one half")
    with few_rows(docs.sparkSession):
        return _link(docs, size, num, den, max_broadcast)


def _link(docs: DataFrame, size: int, num: int, den: int, max_broadcast: int | None) -> tuple[DataFrame, DataFrame]:
    every = materialize(token_sets(docs, size, num, den), "jaccard-every")
    node = materialize(every.where("n > 0").groupBy("cls", "cls2", "n").agg(F.min("rid").alias("node")), "jaccard-nodes")
    rows = every.select("rid", "doc_id", "key", "n", "cls", "cls2").join(node, ["cls", "cls2", "n"], "left").select("rid", "doc_id", "key", "n", "node")
    rows = materialize(rows, "jaccard-rows")
    again = rows.where("rid <> node or node is null").select(F.col("rid").alias("key"))
    again = F.broadcast(again) if again.count() <= MAX_FREQUENT else again  # sets stay where they are unless very many repeat
    dealt = node.count() > MAX_FREQUENT
    own = every.select(F.col("rid").alias("key"), "n", "toks").join(again, "key", "left_anti")
    sets = _dealt_once(own) if dealt else materialize(own, "jaccard-sets")
    drop_scratch(every, node)
    free_shuffles(docs.sparkSession)
    counts = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    counts = materialize(counts, "jaccard-counts")
    free_shuffles(docs.sparkSession)
    rare = RARE
    while (often := small_keys(counts.where(F.col("c") > rare).select("tok"), MAX_FREQUENT)) is None:
        rare *= 2
    sets, often, added, bound = _complete(docs, rows, [sets], dealt, often, size, num, den)
    again = materialize(counts if added is None else counts.unionByName(added).groupBy("tok").agg(F.max("c").alias("c")), "jaccard-wanted")
    wanted = small_counts(again, **({} if max_broadcast is None else {"bound": max_broadcast}))
    if wanted is not None:
        wanted = wanted[0], np.log2(wanted[1]).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((often, wanted))
    index = _signature_rows(_all(sets), sent, num, den)
    if wanted is None:  # too many to send out: the entries go to the tokens
        index = index.join(again.select(F.col("tok").alias("sig"), "c").where("c > 1"), "sig", "left").where("not single or c is not null").drop("c")
    index = materialize(index.drop("single"), "jaccard-index")
    sent.destroy()
    del wanted
    drop_scratch(counts, again, *([] if added is None else [added]))
    rep = index.groupBy("sig").agg(F.max(F.struct("score", "key", "n", "reach")).alias("r"), F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1")
    rep = rep.select("sig", F.col("r.key").alias("hub"), F.col("r.n").alias("nh"), F.col("r.reach").alias("rh"), "c", "least")
    entries = materialize(index.join(rep, "sig").where("reach >= least").select("sig", "key", "n", "reach", "c", "hub", "nh", "rh"), "jaccard-entries")
    drop_scratch(index)
    free_shuffles(docs.sparkSession)
    star = entries.where("key <> hub and n <= rh and nh <= reach").select("hub", F.col("key").alias("mem"), "nh", F.col("n").alias("nm"))
    tested = materialize(star.distinct(), "jaccard-pairs")
    comps = components(_verified(docs, rows, sets, tested, size, num, den))
    tested = [tested]
    # a rare token is in so many prefixes, and in so many of the sets that each round read again, at most: its entry never
    # gets beyond hot, and the others hold whole sets
    hot = max(HOT, rare + bound)
    apart = _apart(entries, comps)
    drop_scratch(entries)
    free_shuffles(docs.sparkSession)
    large, fresh = apart.where(F.col("c") > hot), False
    if large.limit(1).count():
        sure, maybe = _block_links(large, sets, num, den)
        if maybe.limit(1).count():
            sure = sure.unionByName(_verified(docs, rows, sets, maybe, size, num, den))
        if sure.limit(1).count():
            comps, fresh = _joined(comps, sure), True
    apart = apart.where(F.col("c") <= hot)
    for r in range(ROUNDS + 1):
        if fresh:
            now = _apart(apart, comps)
            drop_scratch(apart)
            apart, fresh = now, False
        slots = F.ceil(F.col("c") / SLOT) if r < ROUNDS else F.lit(1)
        named = apart.withColumn("slot", F.pmod(F.xxhash64("key", F.lit(r)), slots))
        most = named.agg(F.max("c")).first()[0]
        if most is None:
            break
        x = named.where("component <> main").select("sig", "slot", F.col("key").alias("hub"), F.col("n").alias("nh"), F.col("reach").alias("rh"), F.col("component").alias("ch"))
        y = named.select("sig", "slot", F.col("key").alias("mem"), F.col("n").alias("nm"), F.col("reach").alias("rm"), F.col("component").alias("cm"))
        rest = x.join(y, ["sig", "slot"]).where("ch <> cm and nh <= rm and nm <= rh")
        rest = rest.select(F.greatest("hub", "mem").alias("a"), F.least("hub", "mem").alias("b"), F.when(F.col("hub") > F.col("mem"), F.col("nh")).otherwise(F.col("nm")).alias("na"), F.when(F.col("hub") > F.col("mem"), F.col("nm")).otherwise(F.col("nh")).alias("nb")).distinct()
        for t in tested:
            rest = rest.join(t.select(F.greatest("hub", "mem").alias("a"), F.least("hub", "mem").alias("b")), ["a", "b"], "left_anti")
        rest = materialize(rest.select(F.col("a").alias("hub"), F.col("b").alias("mem"), F.col("na").alias("nh"), F.col("nb").alias("nm")), "jaccard-pairs")
        if rest.limit(1).count():
            more = _verified(docs, rows, sets, rest, size, num, den)
            if more.limit(1).count():
                comps, fresh = _joined(comps, more), True
        tested.append(rest)
        free_shuffles(docs.sparkSession)
        if most <= SLOT:  # that was every pair
            break
    drop_scratch(apart, *sets, *tested)
    return rows.select("doc_id", "key", "n", "node"), comps


def _apart(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (sig, key, n, reach, c, component, main) of entries whose texts are in different components; main is the largest of those."""
    named = rows.select("sig", "key", "n", "reach", "c").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named, "jaccard-named")
    parts = named.groupBy("sig", "component").agg(F.count("*").alias("k")).groupBy("sig").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component")).alias("m"))
    out = materialize(named.join(parts.where("parts > 1").select("sig", F.col("m.component").alias("main")), "sig"), "jaccard-apart")
    drop_scratch(named)
    return out


def _block_links(rows: DataFrame, sets: list[DataFrame], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), pairs to verify (hub, mem, nh, nm)) of large entries: the texts outside an entry's main component, in blocks, against
    all its texts, in blocks. rows: those of _apart()."""
    sums = rows.groupBy("sig").agg(F.count("*").alias("all"), F.count_if(F.col("component") != F.col("main")).alias("few"), F.avg("n").alias("mean"))
    side = F.greatest(F.lit(16.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_TOKENS)) / F.col("mean")))
    sums = sums.select("sig", F.ceil(F.col("few") / side).alias("kx"), F.ceil(F.col("all") / side).alias("ky"))
    cut = rows.join(sums, "sig").withColumn("h", F.xxhash64("key", "sig"))
    base = ["sig", "key", "component", "reach"]
    left = cut.where("component <> main").select(*base, F.pmod("h", "kx").alias("x"), F.explode(F.expr("sequence(cast(0 as bigint), ky - 1)")).alias("y"), F.lit(True).alias("left"))
    right = cut.select(*base, F.explode(F.expr("sequence(cast(0 as bigint), kx - 1)")).alias("x"), F.pmod("h", "ky").alias("y"), F.lit(False).alias("left"))
    met, keys = _only(sets, rows.select("key"))
    sides = left.unionByName(right)
    full = _all([sides.join(x.select("key", "n", "toks"), "key") for x in met]).select("sig", "x", "y", "key", "component", "left", "reach", "n", "toks")
    full = full.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")

    def compare(t: pa.Table) -> tuple[np.ndarray, ...]:
        key, comp, side, far, n = (t.column(c).to_numpy() for c in ("key", "component", "left", "reach", "n"))
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(left) or not len(right):
            return (np.zeros(0, np.int64),) * 5
        lists = t.column("toks").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(key)), sizes)
        part = sizes < n
        if part.any():  # what lies below the least last token that is known
            end = min(flat[np.cumsum(sizes)[part] - 1])
            row, flat = row[flat <= end], flat[flat <= end]
            sizes = np.bincount(row, minlength=len(key))
        toks, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        used, place = times[back] > 1, np.cumsum(times > 1) - 1
        row, col = row[used], place[back[used]]
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for at in range(0, int((times > 1).sum()), 2048):
            a, b = np.searchsorted(col, [at, at + 2048])
            part_ = np.zeros((len(key), 2048), np.float32)
            part_[row[a:b], col[a:b] - at] = 1
            both += part_[left] @ part_[right].T
        rest = n - sizes
        most = both + np.minimum(rest[left][:, None], rest[right][None])
        hit = ((num + den) * most >= num * (n[left][:, None] + n[right][None])) & (comp[left][:, None] != comp[right][None])
        hit &= (n[left][:, None] <= far[right][None]) & (n[right][None] <= far[left][:, None])
        i, j = np.nonzero(hit)
        i, j = left[i], right[j]
        if part.any():
            return key[i], key[j], n[i], n[j], np.zeros(len(i), np.int64)
        ids, back = np.unique(key, return_inverse=True)  # a text may stand on both sides
        i, j = back[i], back[j]
        label = np.arange(len(ids))
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return ids[moved], ids[label[moved]], np.zeros(len(moved), np.int64), np.zeros(len(moved), np.int64), np.ones(len(moved), np.int64)

    def run(batches):
        held: list[pa.Table] = []

        def done(t: pa.Table):
            keys = [t.column(c).to_numpy() for c in ("sig", "x", "y")]
            cuts = np.append(np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))), t.num_rows)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(t.slice(s, e - s))], ["hub", "mem", "nh", "nm", "sure"])

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                first, last = ([t.column(c)[i].as_py() for c in ("sig", "x", "y")] for i in (0, t.num_rows - 1))
                if held and (first != last or [held[-1].column(c)[0].as_py() for c in ("sig", "x", "y")] != first):
                    same = np.all([t.column(c).to_numpy() == v for c, v in zip(("sig", "x", "y"), last)], axis=0)
                    cut = int(same.argmax())
                    yield from done(pa.concat_tables([*held, t.slice(0, cut)]))
                    held, t = [], t.slice(cut)
                held.append(t)
        if held:
            yield from done(pa.concat_tables(held))

    found = materialize(full.mapInArrow(tidy(run), "hub long, mem long, nh long, nm long, sure long").distinct(), "jaccard-links")
    drop_scratch(keys)
    return found.where("sure = 1").select(F.col("hub").alias("a"), F.col("mem").alias("b")), found.where("sure = 0").drop("sure")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after further links between its components."""
    one = links.join(comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    one = one.join(comps.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    up = components(one.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    up = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = comps.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = up.join(comps.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return materialize(old.unionByName(new), "jaccard-comps")


def _lowest(rows: DataFrame, comps: DataFrame, low) -> DataFrame:
    """Per node the least value of its component: first per node, then per component, so no row of a large group moves twice."""
    own = materialize(rows.where("node is not null").groupBy("node").agg(F.min(low).alias("low")).join(comps, "node", "left"), "jaccard-own")
    top = materialize(own.where("component is not null").groupBy("component").agg(F.min("low").alias("top")), "jaccard-top")
    return materialize(own.join(top, "component", "left").select("node", F.coalesce("top", "low").alias("low")), "jaccard-low")


def groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, **settings) -> DataFrame:
    """Rows (doc_id, key, n_shingles, component_id): component_id is the smallest doc_id reachable by links."""
    rows, comps = link(docs, size, num, den, **settings)
    low = _lowest(rows, comps, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).select("node", F.col("low.id").alias("low"))
    return rows.join(low, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, **settings) -> DataFrame:
    """docs with one row of each group left: that of the smallest id (of equal ids that of the smaller row key; of rows
    that are equal in id and text one). Texts without words all stay, as do null texts; extra columns stay whatever their names."""
    rows, comps = link(docs, size, num, den, **settings)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    low = _lowest(rows, comps, order)
    ours = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    gone = rows.join(low, "node").where(ours != F.col("low")).select(F.col("doc_id").alias("__row_id"), F.col("key").alias("__row_key")).distinct()
    gone = materialize(gone, "jaccard-gone")
    copies = materialize(rows.where("node is not null").groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias("__row_id"), F.col("key").alias("__row_key")), "jaccard-copies")
    small = lambda t: F.broadcast(t) if t.count() <= MAX_FREQUENT else t
    names = [f"__row_{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)  # so that no column of docs has a name that is used here
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    key = F.xxhash64(id_, text)
    same = (key == F.col("__row_key")) & id_.cast("long").eqNullSafe(F.col("__row_id"))
    kept = own.join(small(gone), same, "left_anti")
    if copies.limit(1).count():
        one = kept.join(small(copies), same, "left_semi").withColumn("__row_key", key).dropDuplicates(["__row_key", names[docs.columns.index("doc_id")]]).drop("__row_key")
        kept = kept.join(small(copies), same, "left_anti").unionByName(one)
    return kept.toDF(*docs.columns)
