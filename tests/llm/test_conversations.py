import hashlib
import itertools
import random
import zlib

import pytest

from pixelloom.llm import conversations as C
from pixelloom.llm import queries
from tests.compare import same

BLANK = set(" \t\n\x0b\x0c\r")


def faults(turns):
    """Fault of every (role, text)."""
    seen, out = set(), []
    for role, text in turns:
        bare = [c for c in text if c not in BLANK]
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, letters, repaired turns) of least cost, then least letters, over all ways to reach every allowed sequence of speakers."""
    marks, best = faults(turns), None

    def ways(i, wanted):
        """(cost, letters, turns) of all ways to make the rest of the wanted initials from the turns from i on."""
        if i < len(turns):
            role, text = turns[i]
            for cost, letters, made in ways(i + 1, wanted):
                yield cost + 3, "D" + letters, made
            if wanted and marks[i] not in ("blank", "duplicate"):
                extra = int(marks[i] == "truncated")
                for cost, letters, made in ways(i + 1, wanted[1:]):
                    if role[:1] == wanted[0]:
                        yield cost + extra, "K" + letters, [(role, text), *made]
                    if wanted[0] != "s":
                        yield cost + extra + 2, "R" + letters, [({"u": "user", "a": "assistant"}[wanted[0]], text), *made]
        elif not wanted:
            yield 0, "", []
        if wanted and wanted[0] != "s":
            for cost, letters, made in ways(i, wanted[1:]):
                yield cost + 2, "I" + letters, [({"u": "user", "a": "assistant"}[wanted[0]], ""), *made]

    for n in range((len(turns) + 3) // 2 + 1):
        for wanted in ["ua" * n, *(["s" + "ua" * n] if n else [])]:
            for way in ways(0, wanted):
                if best is None or way[:2] < best[:2]:
                    best = way
    return best


def expected(conv, rows):
    """rows: (turn, role, text) in order."""
    turns = [(r, t) for _, r, t in rows]
    marks = faults(turns)
    cost, letters, made = cheapest(turns)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest


def random_turns(rng, n):
    roles, texts = ["system", "user", "assistant", "tool", "", "s"], ["Hi.", "And?", "cut off", " \t", "", "So! \n", "Hi."]
    return [(t, rng.choice(roles), rng.choice(texts)) for t in sorted(rng.sample(range(12), n))]


def test_solve_is_least():
    rng = random.Random(4)
    for _ in range(400):
        turns = [t[1:] for t in random_turns(rng, rng.randrange(6))]
        cost, letters, made = cheapest(turns)
        assert C.solve(bytes(C.symbol(r, f) for (r, _), f in zip(turns, faults(turns)))) == letters
        rows = [(0, r, t, f) for (r, t), f in zip(turns, faults(turns))]
        done = [(new, text) for _, _, text, _, edit, new in C.apply_edits(rows, letters, 0, len(letters) - letters.count("D")) if edit != "D"]
        assert done == made


def run(spark, rows, partitions=3):
    table = spark.createDataFrame([(c, t, r, x, "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, part string").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tables are one range
    try:
        turns = C.repair(table)
        return turns, {tuple(r) for r in C.audit(turns).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_by_brute_force(spark):
    """Conversations that begin and end inside a task's range and across its borders."""
    rng, rows, want = random.Random(7), [], set()
    for conv in [None, *range(60)]:
        own = random_turns(rng, rng.randrange(1, 6))
        rows += [(conv, *t) for t in own]
        want.add(expected(conv, own))
    turns, got = run(spark, rows)
    assert got == want
    assert turns.where("edit <> 'I'").count() == len(rows)


@pytest.mark.parametrize("size", [40, 300])
def test_one_conversation_over_all_tasks(spark, size):
    """A part's edits equal those of the whole, whatever the borders; repeats far apart are found."""
    rng = random.Random(size)
    own = [(t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["a.", f"{t}.", f"{t}!", "", f"{t}"])) for t in range(size)]
    turns, got = run(spark, [(5, *t) for t in own] + [(4, 0, "user", "x."), (6, 0, "user", "x.")])
    assert turns.where("conv_id = 5").select("part").distinct().count() > 1
    marks = faults([(r, t) for _, r, t in own])
    letters = C.solve(bytes(C.symbol(r, f) for (_, r, _), f in zip(own, marks)))
    row = next(r for r in got if r[0] == 5)
    assert row[7] == letters
    made = [(new, x) for _, _, x, _, e, new in C.apply_edits([(0, r, x, f) for (_, r, x), f in zip(own, marks)], letters, 0, len(letters) - letters.count("D")) if e != "D"]
    assert row[8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    assert row[2:5] == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))


def test_odd_rows(spark):
    """Nulls, repeated rows, ties, ids beyond doubles, a very long text, an empty table."""
    long = "long " * 100_000 + "."
    big = (1 << 53) + 1
    rows = [(1, None, None, None), (1, 2, "user", long), (1, 2, "user", long), (None, None, "user", "x."), (big, 0, "user", "y."), (big + 1, 0, "assistant", "z")]
    _, got = run(spark, rows)
    want = {expected(1, [(None, " ", " "), (2, "user", long), (2, "user", long)]), expected(None, [(None, "user", "x.")]), expected(big, [(0, "user", "y.")]), expected(big + 1, [(0, "assistant", "z")])}
    assert got == want
    assert C.audit(C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"What? {c} is. It!") for c in (None, 0, 3) for t in (None, *range(30))]
    got = sorted((tuple(r) for r in C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(want, key=repr)


def test_dropped_conversation(spark, tmp_path):
    """A conversation whose only row is dropped has zeros and the hash of nothing."""
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.op11_conversations(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark, sf_dir):
    same(spark, sf_dir, queries.op11_conversations, queries.oracle_sql()["op11_conversations"])
