"""Conversation structure repair: the cheapest edits that make the roles alternate.

A conversation is a DAG: a layer of nodes (the states START, SYSTEM, USER, ASSISTANT of the wanted role pattern
`(s?(ua)+)?`) before each of its turns and one after the last. Deleting, keeping or re-roling a turn leads to the next
layer, inserting an empty turn to another node of the same layer. Forward and backward minimum costs tell which arcs are
tight, that is on a cheapest path; from the first node on, the set of nodes that the letters so far can lead to moves
along the tight arcs of the least letter (D, I, K, R). The role of every turn that remains follows from the parity of
their number.

Turns are dealt by range of (conversation, turn, role, hash of the text), so that a conversation of any length spreads over
many tasks. Conversations inside one task are repaired there. Those at a task's ends (two at most) are open: each task
sums its part up as a 4 x 4 matrix of least costs, these are multiplied from both sides, then each part says where it
leads any set of nodes, and finally writes its edits. What meets in one task is a few numbers for each part.

Defined cases: null roles and texts are one space; null turns come first, equal turns by role, then by the hash of the
text; a null conv_id is a conversation of its own; repeated rows are duplicates; an empty table gives no turns; extra
columns are ignored. Texts are kept whole, whatever their length; a task holds one conversation of its range at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import few_rows, materialize

BLANK = " \t\n\x0b\x0c\r"
#: Fixed prices of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: State after an empty turn or a new role is added: always the other speaker, the user first.
ADDED = (USER, USER, ASSISTANT, USER)
#: State after a turn of role initial s, u, a or another one is kept; None: it can't be.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Least cost from each node of the last layer on: only START and ASSISTANT may end.
LAST = (0, 4, 2, 0)
FINE, CUT, MUST = range(3)
FAULTS = ("", "truncated", "blank", "duplicate")
TURNS = "conv_id long, part long, step long, turn long, before string, text string, fault string, edit string, role string, open boolean"
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("step", pa.int64()), ("turn", pa.int64()), ("before", pa.string()), ("text", pa.string()),
    ("fault", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("open", pa.bool_()),
])
BATCH_ROWS, BATCH_BYTES = 4_000, 1 << 23


# ---- the DAG of one conversation, or of a part of it ------------------------------------------------


def symbol(role: str, fault: str) -> int:
    """What the costs of a turn depend on: the initial of its role and whether it is cut off or has to go."""
    code = "sua".find(role[:1]) if role else 3
    return (3 if code < 0 else code) * 3 + (MUST if fault in ("blank", "duplicate") else CUT if fault == "truncated" else FINE)


@functools.cache
def arcs(row: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of the arcs over a turn, by letter."""
    code, kind = divmod(row, 3)
    out = [("D", s, s, DELETE) for s in range(4)]
    if kind != MUST:
        extra = TRUNCATED if kind == CUT else 0
        out += [("K", s, KEPT[s][code], extra) for s in range(4) if KEPT[s][code] is not None]
        out += [("R", s, ADDED[s], REROLE + extra) for s in range(4)]
    return tuple(out)


def _forward_inserts(c: list[int]) -> list[int]:
    user = min(c[USER], c[START] + INSERT, c[SYSTEM] + INSERT, c[ASSISTANT] + INSERT)
    return [c[START], c[SYSTEM], user, min(c[ASSISTANT], user + INSERT)]


def _backward_inserts(c: list[int]) -> list[int]:
    user = min(c[USER], c[ASSISTANT] + INSERT)
    return [min(c[START], user + INSERT), min(c[SYSTEM], user + INSERT), user, min(c[ASSISTANT], user + INSERT)]


def forward(rows: Iterable[int], entry: Iterable[int]) -> list[list[int]]:
    """Least cost to every node of every layer; the last layer's before its own inserts."""
    layers, now = [], list(entry)
    for row in rows:
        layers.append(now := _forward_inserts(now))
        new = [FAR] * 4
        for _, s, t, cost in arcs(row):
            new[t] = min(new[t], now[s] + cost)
        now = new
    return [*layers, now]


def backward(rows: bytes, leave: Iterable[int]) -> list[list[int]]:
    """Least cost from every node of every layer; leave: that of the last layer, with its inserts."""
    layers = [list(leave)]
    for row in reversed(rows):
        after, new = layers[-1], [FAR] * 4
        for _, s, t, cost in arcs(row):
            new[s] = min(new[s], after[t] + cost)
        layers.append(_backward_inserts(new))
    return layers[::-1]


def walk(rows: bytes, frontier: frozenset[int], to: list[list[int]], fro: list[list[int]], best: int, ends: bool) -> tuple[str, frozenset[int]]:
    """The least letters along tight arcs and the nodes they lead to. ends: the last layer is the conversation's."""
    letters = []
    for i in range(len(rows) + 1):
        here, there = to[i] if i < len(rows) or not ends else _forward_inserts(to[i]), fro[i]
        while True:
            added = frozenset(ADDED[s] for s in frontier if here[s] + INSERT + there[ADDED[s]] == best) if i < len(rows) or ends else frozenset()
            found: dict[str, set[int]] = {}
            if i < len(rows):
                for letter, s, t, cost in arcs(rows[i]):
                    if s in frontier and here[s] + cost + fro[i + 1][t] == best:
                        found.setdefault(letter, set()).add(t)
            if added and "D" not in found:
                letters.append("I")
                frontier = added
                continue
            break
        if i < len(rows):
            letter = min(found)
            letters.append(letter)
            frontier = frozenset(found[letter])
    return "".join(letters), frontier


def solve(rows: bytes) -> str:
    """Edits of a whole conversation."""
    to, fro = forward(rows, (0, FAR, FAR, FAR)), backward(rows, LAST)
    return walk(rows, frozenset([START]), to, fro, fro[0][START], True)[0]


_solve_short = functools.lru_cache(1 << 14)(solve)


def apply_edits(turns: list[tuple], letters: str, before: int, total: int) -> Iterator[tuple]:
    """(turn, role before, text, fault, edit, role) of every turn and insert. before, total: turns that remain before this part and in all."""
    left, k, odd = iter(turns), before, total % 2
    for letter in letters:
        turn, role, text, fault = (None, None, "", None) if letter == "I" else next(left)
        new = role if letter == "K" else None if letter == "D" else "user" if (k - odd) % 2 == 0 else "assistant"
        yield turn, role, text, fault, letter, new
        k += letter != "D"


# ---- tasks ------------------------------------------------------------------------------------------


class _Out:
    def __init__(self, schema: pa.Schema = _SCHEMA):
        self.rows, self.bytes, self.schema = [], 0, schema

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.bytes >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)


def _repair_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations inside a range of sorted turns are repaired; turns of the first and the last one go on as they are."""
    from pyspark import TaskContext

    part, out = TaskContext.get().partitionId(), _Out()
    nobody = object()
    conv, turns, first, step = nobody, [], False, 0
    for b in batches:
        for c, turn, role, text, blank, cut in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if c != conv:
                if conv is not nobody and not first:
                    yield from _repair_one(conv, part, turns, out)
                first = conv is nobody
                conv, turns, step = c, [], 0
            row = (turn, role, text, "blank" if blank else "truncated" if cut else "")
            if first:
                out.add((conv, part, step, *row, None, None, True), len(text))
                step += 1
            else:
                turns.append(row)
            if out.full():
                yield out.take()
    for k, row in enumerate(turns):
        out.add((conv, part, k, *row, None, None, True), len(row[2]))
        if out.full():
            yield out.take()
    yield out.take()


def _repair_one(conv: int | None, part: int, turns: list[tuple], out: _Out) -> Iterator[pa.RecordBatch]:
    seen, marked = set(), []
    for turn, role, text, fault in turns:
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        marked.append((turn, role, text, fault))
    rows = bytes(symbol(t[1], t[3]) for t in marked)
    letters = _solve_short(rows) if len(rows) <= 64 else solve(rows)
    for k, (turn, role, text, fault, edit, new) in enumerate(apply_edits(marked, letters, 0, len(letters) - letters.count("D"))):
        out.add((conv, part, k, turn, role, text, fault, edit, new, False), len(text))
        if out.full():
            yield out.take()


# ---- open conversations -----------------------------------------------------------------------------


def _rows_of(table: pa.Table) -> bytes:
    table = table.sort_by("step")
    return bytes(symbol(r, f) for r, f in zip(table["before"].to_pylist(), table["fault"].to_pylist(), strict=True))


def _sum_up(table: pa.Table) -> pa.Table:
    """A part's least costs between any two nodes at its ends."""
    rows = _rows_of(table)
    costs = [forward(rows, [0 if s == t else FAR for t in range(4)])[-1] for s in range(4)]
    return pa.table({"conv_id": table["conv_id"][:1], "part": table["part"][:1], "costs": pa.array([[min(x, FAR) for row in costs for x in row]], pa.list_(pa.int64()))})


def _meet(table: pa.Table) -> pa.Table:
    """Per part the least costs up to its begin and from its end on: products of the parts before and after it."""
    table = table.sort_by("part")
    costs = [[x[4 * s : 4 * s + 4] for s in range(4)] for x in table["costs"].to_pylist()]
    entry, leave = [[0, FAR, FAR, FAR]], [list(LAST)]
    for m in costs:
        entry.append([min(min(entry[-1][s] + m[s][t] for s in range(4)), FAR) for t in range(4)])
    for m in reversed(costs):
        leave.append([min(min(m[s][t] + leave[-1][t] for t in range(4)), FAR) for s in range(4)])
    longs = pa.list_(pa.int64())
    n = len(costs)
    return pa.table({
        "conv_id": table["conv_id"], "part": table["part"], "entry": pa.array(entry[:-1], longs), "leave": pa.array(leave[-2::-1], longs),
        "best": pa.array([leave[-1][START]] * n, pa.int64()), "last": pa.array([k == n - 1 for k in range(n)]),
    })


_MEET = "conv_id long, part long, entry array<long>, leave array<long>, best long, last boolean"


def _tasked(table: pa.Table) -> tuple[bytes, list[list[int]], list[list[int]], int, bool]:
    rows, one = _rows_of(table), {c: table[c][0].as_py() for c in ("entry", "leave", "best", "last")}
    return rows, forward(rows, one["entry"]), backward(rows, one["leave"]), one["best"], one["last"]


def _lead(table: pa.Table) -> pa.Table:
    """Where a part leads every set of nodes that a cheapest path may come with, and how many turns remain on the way."""
    rows, to, fro, best, last = _tasked(table)
    tight = [s for s in range(4) if _forward_inserts(to[0])[s] + fro[0][s] == best]
    leads = []
    for mask in range(1, 1 << len(tight)):
        come = frozenset(s for k, s in enumerate(tight) if mask >> k & 1)
        letters, go = walk(rows, come, to, fro, best, last)
        leads.append([sum(1 << s for s in come), sum(1 << s for s in go), len(letters) - letters.count("D")])
    return pa.table({"conv_id": table["conv_id"][:1], "part": table["part"][:1], "leads": pa.array([leads], pa.list_(pa.list_(pa.int64())))})


def _follow(table: pa.Table) -> pa.Table:
    """The set of nodes that each part begins with, and the turns that remain before it and in all."""
    table = table.sort_by("part")
    now, before, out = 1 << START, 0, []
    for leads in table["leads"].to_pylist():
        out.append((now, before))
        go, n = next((g, n) for c, g, n in leads if c == now)
        now, before = go, before + n
    longs = pa.int64()
    return pa.table({
        "conv_id": table["conv_id"], "part": table["part"], "come": pa.array([c for c, _ in out], longs),
        "kept_before": pa.array([b for _, b in out], longs), "kept_total": pa.array([before] * len(out), longs),
    })


def _write_part(table: pa.Table) -> pa.Table:
    rows, to, fro, best, last = _tasked(table)
    come, before, total = (table[c][0].as_py() for c in ("come", "kept_before", "kept_total"))
    letters, _ = walk(rows, frozenset(s for s in range(4) if come >> s & 1), to, fro, best, last)
    table = table.sort_by("step")
    conv, part = table["conv_id"][0].as_py(), table["part"][0].as_py()
    turns = list(zip(*(table[c].to_pylist() for c in ("turn", "before", "text", "fault")), strict=True))
    out = _Out()
    for k, row in enumerate(apply_edits(turns, letters, before, total)):
        out.add((conv, part, k, *row, False))
    return pa.Table.from_batches([out.take()])


def _repair_open(rows: DataFrame) -> DataFrame:
    place = F.struct("part", "step")
    keyed = rows.withColumn("same", F.sha2("text", 256))
    first = keyed.groupBy("conv_id", "before", "same").agg(F.min(place).alias("first"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "before", "same")]
    again = (F.col("fault") != "blank") & (F.col("first") != F.struct("a.part", "a.step"))
    marked = keyed.alias("a").join(first.alias("b"), on).select(
        "a.conv_id", "a.part", "step", "turn", "a.before", "text", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), "edit", "role", "open")
    marked = materialize(marked, "conversations-open")
    slim = marked.select("conv_id", "part", "step", "before", "fault")
    sums = slim.groupBy("conv_id", "part").applyInArrow(_sum_up, "conv_id long, part long, costs array<long>")
    met = materialize(sums.groupBy("conv_id").applyInArrow(_meet, _MEET), "conversations-costs")
    own = lambda t, u: t.alias("a").join(u.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", *[f"b.{c}" for c in u.columns if c not in ("conv_id", "part")])
    leads = own(slim, met).groupBy("conv_id", "part").applyInArrow(_lead, "conv_id long, part long, leads array<array<long>>")
    ways = materialize(leads.groupBy("conv_id").applyInArrow(_follow, "conv_id long, part long, come long, kept_before long, kept_total long"), "conversations-ways")
    return own(own(marked, met), ways).groupBy("conv_id", "part").applyInArrow(_write_part, TURNS)


# ---- the operator -----------------------------------------------------------------------------------


def repair(rows: DataFrame) -> DataFrame:
    """Turns with their edits, from rows (conv_id, turn, role, text): conv_id, part and step (their order), turn, before (the role
    as it was; null for inserts), text, fault (blank, duplicate, truncated or empty), edit (D, I, K, R), role (null if deleted)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    bare = F.translate("text", BLANK, "")
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    own = own.select("*", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("rid"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("rid")]  # rid: only between equal rows
    with few_rows(rows.sparkSession, 2_000):
        ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)
        made = materialize(ranged.drop("rid").mapInArrow(_repair_range, TURNS), "conversations-turns")
        opened = made.where("open")
        whole = made.where("not open").drop("open")
        return whole.unionByName(materialize(_repair_open(opened), "conversations-repaired").drop("open"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32(`conv_id:turn`) % 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4
    sets role user. Null roles and texts are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


_AUDIT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PRICE = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Audit:
    """Figures of one conversation, turn by turn; only its letters are kept."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.illegal, self.cost, self.letters, self.digest = conv, dict.fromkeys(FAULTS, 0), 0, 0, [], hashlib.sha256()
        self.low = self.high = self.initial = None
        self.distinct, self.empty = 0, True

    def add(self, turn: int | None, before: str | None, text: str, fault: str | None, edit: str, role: str | None) -> None:
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
            self.counts[fault] += 1
            if self.initial is not None and (self.initial, before[:1]) not in _LEGAL:
                self.illegal += 1
            self.initial = before[:1]
        self.letters.append(edit)
        self.cost += _PRICE[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return self.conv, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest()


def _audit_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, _Out(_AUDIT)
    for b in batches:
        for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if now is None or now.conv != c:
                if now is not None:
                    out.add(now.row(), len(now.letters))
                now = _Audit(c)
            now.add(*row)
            if out.full():
                yield out.take()
    if now is not None:
        out.add(now.row())
    yield out.take()


def audit(turns: DataFrame) -> DataFrame:
    """Per conversation of repair()'s turns: gaps between its turns (at most 2^63 - 1), faults, illegal neighbours, cost, letters, and the
    digest of the repaired turns (`role:text`, joined by newlines). A digest reads its conversation in order: the task
    that has it streams the turns and keeps the letters only."""
    rows = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "step")
    return rows.select("conv_id", "turn", "before", "text", "fault", "edit", "role").mapInArrow(_audit_range, AUDIT)
