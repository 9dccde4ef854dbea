"""Exact deduplication with a minimal perfect hash over historical distinct digests.

Digests are dealt into shards; a shard's hash (hash and displace: groups of keys are placed largest first, single keys
take the slots that are left) maps its digests onto exactly as many slots. A slot holds the full digest, the locator of
the row that stays, and the group's size. New digests are grouped first, looked up, and compared byte for byte: members
join their slot's group, nonmembers are groups of their own.

Texts are equal if they are identical after deleting every character of [\\x20\\x09-\\x0D]. The row with the most code
points in the original text stays, then that of the smallest id (null ids last), then the first read.
Defined cases: a null text is empty; repeated rows leave one; an empty table gives no rows; a history may be empty;
extra columns are ignored; texts are digested whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import drop_scratch, materialize, mix, row_key

SHARD_KEYS = 20_000
#: Most keys of rows (16 bytes each) that are broadcast; more are joined by shuffle.
MAX_SENT = 1_000_000
BLANK = " \t\n\x0b\x0c\r"
SLOTS = "shard long, n long, moves binary, digests binary, ids array<long>, lost array<boolean>, rids array<long>, sizes array<long>, lengths array<long>"
#: Rows of groups as tasks see them: no nulls, so that no long becomes a double. lost: the row has no id.
PLAIN = ["digest", "doc_id", "lost", "rid", "length", "size"]
GROUPS = "digest binary, doc_id long, lost boolean, rid long, length long, size long, member boolean"


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests[:, :32].reshape(-1, 32).view("<u8")
    return mix(words[:, 1]), mix(words[:, 2])


def _place(b: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    return (mix(b + mix(move.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, slot of each key) for distinct 32-byte digests (n x 32 bytes)."""
    n = len(digests)
    a, b = _halves(digests)
    groups = n // 2 + 1
    g = (a % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    ends = np.searchsorted(g[order], np.arange(groups + 1))
    sizes = np.diff(ends)
    moves, slots, taken = np.zeros(groups, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    for k in np.argsort(-sizes, kind="stable"):
        keys = order[ends[k] : ends[k + 1]]
        if len(keys) < 2:
            break
        d = 0
        while True:  # 32 moves at a time
            at = _place(b[keys][None], np.arange(d, d + 32)[:, None], n)
            free = ~taken[at].any(axis=1)
            if len(keys) > 1:
                free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if free.any():
                d += int(free.argmax())
                at = at[free.argmax()]
                break
            d += 32
        moves[k], slots[keys], taken[at] = d, at, True
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    keys = order[ends[single]]
    slots[keys] = free[: len(keys)]
    moves[single] = -1 - slots[keys]
    return moves, slots


def find(digests: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """The only slot where each digest can be."""
    a, b = _halves(digests)
    d = moves[(a % np.uint64(len(moves))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _place(b, np.maximum(d, 0), max(1, n)))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def digest_rows(docs: DataFrame) -> DataFrame:
    """Materialized rows (doc_id, key, rid, digest, length); rid tells repeated rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("rid"),
        F.unhex(F.sha2(F.translate(text, BLANK, ""), 256)).alias("digest"), F.length(text).cast("long").alias("length"),
    )
    return materialize(rows, "dedup-digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the group's size."""
    best = F.min(F.struct((-F.col("length")).alias("less"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("b")
    return rows.groupBy("digest").agg(best, F.count("*").alias("size")).select("digest", "b.doc_id", "b.rid", (-F.col("b.less")).alias("length"), "size")


def plain(groups: DataFrame) -> DataFrame:
    """Rows of grouped() without nulls."""
    return groups.withColumns({"lost": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))}).select(*PLAIN)


def _shard(n: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n)).alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard with its hash and slots, from rows of plain()."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(rows["digest"])
        moves, slots = build_hash(digests)
        back = np.argsort(slots)
        pick = lambda c: rows[c].to_numpy()[back].tolist()
        return pd.DataFrame([{"shard": int(rows["shard"].iloc[0]), "n": len(rows), "moves": moves.tobytes(), "digests": digests[back].tobytes(), "ids": pick("doc_id"), "lost": pick("lost"), "rids": pick("rid"), "sizes": pick("size"), "lengths": pick("length")}])

    return materialize(history.select("*", _shard(shards)).groupBy("shard").applyInPandas(build, SLOTS), "dedup-index")


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups of history and new rows: members of the index joined with their slots, nonmembers as they are."""

    def probe(key, rows: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        out = []
        hit = np.zeros(len(rows), bool)
        if len(slots):
            s = slots.iloc[0]
            stored = np.frombuffer(s["digests"], np.uint8).reshape(-1, 32)
            longs = lambda c: np.asarray(s[c], np.int64)
            old = pd.DataFrame({"digest": [x.tobytes() for x in stored], "doc_id": longs("ids"), "lost": np.asarray(s["lost"], bool), "rid": longs("rids"), "length": longs("lengths"), "size": longs("sizes")})
            if len(rows):
                digests = _matrix(rows["digest"])
                at = find(digests, np.frombuffer(s["moves"], np.int64), int(s["n"]))
                hit = (stored[at] == digests).all(axis=1)
                mine = rows[hit].reset_index(drop=True)
                at = at[hit]
                theirs = old.iloc[at].reset_index(drop=True)
                rank = lambda f: list(zip(-f["length"].to_numpy(), f["lost"].to_numpy(), f["doc_id"].to_numpy(), f["rid"].to_numpy()))
                better = np.array([x < y for x, y in zip(rank(mine), rank(theirs))], bool)
                merged = theirs.copy()
                for c in ("doc_id", "lost", "rid", "length"):
                    merged[c] = np.where(better, mine[c].to_numpy(), theirs[c].to_numpy())
                merged["size"] = theirs["size"].to_numpy() + mine["size"].to_numpy()
                out.append(merged)
                old = old.drop(index=at)
            out.append(old)
        if len(rows):
            out.append(rows.loc[~hit, PLAIN].assign(member=False))
        out = [x if "member" in x else x.assign(member=True) for x in out if len(x)]
        return pd.concat(out, ignore_index=True)[[*PLAIN, "member"]] if out else pd.DataFrame({c: [] for c in [*PLAIN, "member"]})

    return new.select("*", _shard(shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, GROUPS)


def deduplicate(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Groups (digest, doc_id, rid, length, size, member) over rows of digest_rows(). history: a condition that tells
    historical rows from new ones; by default one bit of the row key does."""
    past = F.pmod(F.col("key"), F.lit(2)) == 0 if history is None else history
    old, new = materialize(plain(grouped(rows.where(past))), "dedup-old"), plain(grouped(rows.where(~past)))
    shards = max(1, -(-old.count() // SHARD_KEYS))
    found = look_up(new, build_index(old, shards), shards)
    return materialize(found.withColumn("doc_id", F.when(~F.col("lost"), F.col("doc_id"))).drop("lost"), "dedup-groups")


def decide(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, keep_id, group_size, kept, digest, key)."""
    rows = digest_rows(docs)
    found = deduplicate(rows).select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("best"), F.col("size").alias("group_size"))
    return rows.join(found, "digest").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), "digest", "key")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that decide() drops; null texts count as empty, all columns stay whatever their names."""
    rows = digest_rows(docs)
    best = deduplicate(rows).select("rid", F.lit(True).alias("best"))
    name = lambda t: t.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    gone = materialize(name(rows.join(best, "rid", "left").where("best is null")).distinct(), "dedup-gone")
    # rows that are equal in id and text: one of them may stay
    copies = materialize(name(rows.join(best, "rid", "left").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.count("best").alias("stay")).where("n > 1 and stay > 0")), "dedup-copies")
    drop_scratch(rows)
    small = lambda t: F.broadcast(t) if t.count() <= MAX_SENT else t
    own = docs.toDF(*(f"__row_{i}" for i in range(len(docs.columns))))
    id_, text = (F.col(f"__row_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    key = F.xxhash64(id_, text)
    same = (key == F.col("__key")) & id_.cast("long").eqNullSafe(F.col("__id"))
    kept = own.join(small(gone), same, "left_anti")
    if copies.limit(1).count():
        one = own.join(small(copies), same, "left_semi").withColumn("__key", key).dropDuplicates(["__key", f"__row_{docs.columns.index('doc_id')}"]).drop("__key")
        kept = kept.unionByName(one)
    return kept.toDF(*docs.columns)
