"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts are one atomic group; the groups stand in the order of their texts' SHA-256, so that a prefix of the digest names a
contiguous run of groups of known bytes. The smallest capacity with which greedy filling gets along with the given number of
shards is found by binary search; a check needs the bytes of some runs only. The driver knows the border of at most
65,536 runs at first and asks for finer ones only where a check can't be decided without them; then the shards are cut there.

Rows of a shard are numbered in the order of (digest, doc_id). They are dealt by range of that order, so a group of any size spreads
over tasks, and numbered by a task's own count and the counts of the tasks before it.

Defined cases: a null text is empty and takes 1 byte; a null id comes before others; repeated rows are rows of their own; an
empty table gives no rows; a group larger than its share of all bytes still is one shard's, which then is the largest;
shards may stay empty. Extra columns are ignored. Texts are measured whole.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import materialize

#: Hexadecimal digits of a run's name at first, and more of them at each refinement.
DIGITS, FINER = 4, 3
#: Runs of at most so many groups are resolved into their groups.
RESOLVED = 1_024


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def sized(docs: DataFrame) -> DataFrame:
    """Materialized (doc_id, size, text_crc32, digest, rid); size: bytes of the text and one; rid tells repeated rows apart."""
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.sha2(data, 256).alias("digest"), F.monotonically_increasing_id().alias("rid"),
    )
    return materialize(rows, "sharding-sizes")


class Borders:
    """What the driver knows of the groups in order: runs (name, bytes before it, groups in it). A run of one group has no border inside."""

    def __init__(self, groups: DataFrame, digits: int = DIGITS, resolved: int = RESOLVED):
        self.groups, self.resolved = groups, resolved
        self.runs = self._ask(groups, digits)
        self.asked = 0
        self._number()

    @staticmethod
    def _ask(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        per = groups.groupBy(F.substring("digest", 1, digits).alias("run")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        return sorted((r[0], int(r[1]), int(r[2])) for r in per.collect())  # a row per run: bounded by the digits or by what they refine

    def _number(self) -> None:
        self.ends = []
        total = 0
        for _, size, _ in self.runs:
            total += size
            self.ends.append(total)
        self.total = total

    def fill(self, low: int, high: int, capacity: int) -> tuple[int, int, list[int]]:
        """Bounds of the border that greedy filling reaches from one between low and high, and the runs that leave it open."""
        at = bisect.bisect_right(self.ends, low + capacity)
        first = self.ends[at - 1] if at else 0
        up = bisect.bisect_right(self.ends, high + capacity)
        last, unsure = (self.ends[up - 1] if up else 0), []
        if at < len(self.runs) and self.runs[at][2] > 1:
            unsure.append(at)
        if up < len(self.runs) and self.runs[up][2] > 1:
            unsure.append(up)
            last = high + capacity
        return first, last, unsure

    def check(self, capacity: int, shards: int) -> tuple[bool | None, list[int], list[int]]:
        """(whether the capacity suffices, or None; lower bounds of the borders; runs that would tell)."""
        low = high = 0
        cuts, unsure = [], []
        for _ in range(shards):
            low, high, more = self.fill(low, high, capacity)
            cuts.append(low)
            unsure += more
        if low >= self.total:
            return True, cuts, unsure
        if high < self.total:
            return False, cuts, unsure
        return None, cuts, unsure

    def refine(self, unsure: list[int]) -> None:
        """Finer borders in these runs, a query for all small ones and one for the others."""
        self.asked += 1
        picked = sorted(set(unsure))
        made: dict[int, list[tuple[str, int, int]]] = {}
        by_digits: dict[int, list[int]] = {}
        for k in picked:
            by_digits.setdefault(64 if self.runs[k][2] <= self.resolved else min(64, len(self.runs[k][0]) + FINER), []).append(k)
        for digits, own in by_digits.items():
            inside = F.lit(False)
            for k in own:  # a prefix as a range, which reaches the scan
                name = self.runs[k][0]
                inside = inside | ((F.col("digest") >= name) & (F.col("digest") < name + "g"))
            names = [self.runs[k][0] for k in own]
            for run in self._ask(self.groups.where(inside), digits):
                made.setdefault(own[bisect.bisect_right(names, run[0]) - 1], []).append(run)
        self.runs = [x for k, run in enumerate(self.runs) for x in made.get(k, [run])]
        self._number()

    def decide(self, capacity: int, shards: int) -> bool:
        while (found := self.check(capacity, shards))[0] is None:
            self.refine(found[2])
        return found[0]

    def cut(self, capacity: int, shards: int) -> list[str]:
        """Digests (or their prefixes) at which the next shard begins."""
        while (found := self.check(capacity, shards))[2] and any(self.runs[k][2] > 1 for k in found[2]):
            self.refine(found[2])
        begins = dict(zip([0, *self.ends[:-1]], (r[0] for r in self.runs), strict=False))
        return [begins[c] for c in dict.fromkeys(found[1]) if 0 < c < self.total]


def minimax(groups: DataFrame, shards: int, digits: int = DIGITS, resolved: int = RESOLVED) -> tuple[int, list[str]]:
    """(smallest capacity, names at which the next shard begins) over materialized groups (digest, bytes)."""
    known = Borders(groups, digits, resolved)
    if not known.total:
        return 0, []
    largest = int(groups.agg(F.max("bytes")).first()[0])
    low = max(largest, -(-known.total // shards))
    high = max(low, -(-known.total // shards) + largest)  # every shard but the last then takes its share at least
    while low < high:
        middle = (low + high) // 2
        if known.decide(middle, shards):
            high = middle
        else:
            low = middle + 1
    return low, known.cut(low, shards)


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """The shard of a digest: the number of cuts that don't come after it."""
    return sum(((digest >= c).cast("int") for c in cuts), F.lit(0))


def grouped(rows: DataFrame) -> DataFrame:
    """Materialized (digest, bytes) of the groups, sorted so that a run's groups are read alone."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    return materialize(groups.repartitionByRange("digest").sortWithinPartitions("digest"), "sharding-groups")


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """Per row of docs (doc_id, size, text_crc32, digest, shard, slot); slots of a shard are gapless from 0."""
    rows = sized(docs)
    _, cuts = minimax(grouped(rows), shards)
    order = ["digest", F.col("doc_id").asc_nulls_first(), "rid"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.monotonically_increasing_id().alias("place"), shard_of(F.col("digest"), cuts).alias("shard")).drop("rid"), "sharding-rows")
    part = F.shiftright("place", 33).alias("part")
    own = placed.groupBy(part, "shard").agg(F.min("place").alias("least"), F.count("*").alias("n"))
    # ranges and shards are both contiguous: a row per task and cut, whatever the number of documents
    counts = sorted(tuple(r) for r in own.collect())
    first, base = {}, []
    for p, s, least, n in counts:
        base.append((p, s, first.get(s, 0) - least))
        first[s] = first.get(s, 0) + n
    shift = placed.sparkSession.createDataFrame(base, "part long, shard int, shift long")
    return placed.withColumn("part", part).join(F.broadcast(shift), ["part", "shard"]).withColumn("slot", F.col("place") + F.col("shift")).select("doc_id", "size", "text_crc32", "digest", "shard", "slot")


def with_shards(docs: DataFrame, shards: int, out: str = "shard") -> DataFrame:
    """docs with the shard of each row, all columns kept; the documents themselves aren't shuffled."""
    _, cuts = minimax(grouped(sized(docs)), shards)
    return docs.withColumn(out, shard_of(digest_of(F.col("text")), cuts))


def write(docs: DataFrame, shards: int, path: str) -> None:
    """docs as a folder for each shard."""
    with_shards(docs, shards, "shard").write.partitionBy("shard").parquet(path)
