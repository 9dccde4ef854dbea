"""Substring deduplication by longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller id, or same document and earlier
start). Every such window belongs to one anchor: the k-gram of the lowest hash inside it, so equal windows share anchor
and offset and can be compared anchor by anchor. Anchors that occur twice or more are kept with the text around them;
per anchor the windows are put in suffix order, and a window has an earlier copy if, inside its run of common prefixes of
at least `length`, a smaller position stands before it (previous smaller value) or after it (next smaller value).
Equal surroundings (byte by byte) are folded inside every task before anything is shuffled. An anchor that is common is split: its
windows are dealt into classes by where they start, and keyed by the bytes that all windows of the class share, which are nearly
the whole window where the anchor is very common.

Defined cases: a null text is empty; texts shorter than `length` stay whole; null ids come last; documents of equal id are
ordered by row key, and rows that are equal in id and text are one document and share their result; an empty table
gives no rows; extra columns are ignored; a text of any length is read whole and matches never cross texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import chunks, drop_scratch, materialize, member, mix, powers, prefix_sums, row_key, small_keys, text_bytes, tidy, unequal_spans

LENGTH = 100
GRAM = 24
#: Occurrences beyond which an anchor is split, and starts of windows in a class; likewise for very common anchors.
HOT = 1000
WIDTH = 16
VERY_HOT = 32
NARROW = 4
#: Bits of a position inside a segment: fixed, so that equal windows pick equal anchors wherever they stand.
PLACE_BITS = 22
#: Rows that are put in suffix order together, unless one anchor has more.
ROWS = 4096
#: Most surroundings of one key that are compared in a task; beyond it, windows are told apart one by one.
HELD = 50_000
SEGMENT = 1 << 22
REGIONS = "h long, doc_id long, key long, start long, low int, count int, region binary, end long"


def suffix_order(windows: np.ndarray) -> np.ndarray:
    """Lexicographic order of equally long byte strings (rows); equal ones stay as they stand."""
    return np.argsort(np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel(), kind="stable")


def has_earlier(position: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For positions in suffix order, whether a smaller one stands before or after in the same run (numbered from 0)."""
    far = np.int64(position.max() - position.min() + 1) if len(position) else np.int64(1)
    shifted = position - position.min(initial=0)
    psv = np.minimum.accumulate(shifted - run * far) + run * far < shifted
    back = (shifted + run * far)[::-1] - (run[-1] if len(run) else 0) * far
    nsv = (np.minimum.accumulate(back)[::-1] + (run[-1] if len(run) else 0) * far - run * far) < shifted
    return psv | nsv


def longest_previous_factors(text: bytes) -> list[int]:
    """LPF array of one text: per position the longest match that starts earlier, by previous and next smaller positions
    in suffix order."""
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])

    def common(i: int, j: int) -> int:
        k = 0
        while max(i, j) + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    out = [0] * n
    for ranks in (range(n), range(n - 1, -1, -1)):
        stack: list[int] = []
        for r in ranks:
            while stack and stack[-1] > order[r]:
                stack.pop()
            if stack:
                out[order[r]] = max(out[order[r]], common(order[r], stack[-1]))
            stack.append(order[r])
    return out


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, anchor, first window, last window) of the texts in buf: arrays of byte positions; and the prefix sums."""
    n = len(buf)
    sums = prefix_sums(buf)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, sums
    inverse = powers(n)[1]
    v = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    bits = np.uint64(PLACE_BITS)
    key = (v >> bits << bits) | np.arange(len(v), dtype=np.uint64)
    w, size, low = length - gram + 1, 1, key
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    good = np.ones(len(at), bool)
    for e in offsets[1:-1].tolist():  # windows that would cross into the next text
        good[max(0, e - length + 1) : e] = False
    p = np.flatnonzero(good)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z, sums
    a = at[p]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    last = np.append(first[1:], len(p)) - 1
    return v[a[first]].view(np.int64), a[first], p[first], p[last], sums


def _segments(off: np.ndarray, length: int):
    """(first row, last row, first byte, last byte): chunks of texts, and overlapping parts of texts that are very long."""
    for i, j in chunks(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= SEGMENT:
            yield i, j, lo, hi
        else:
            at = lo
            while at < hi:
                yield i, j, at, min(hi, at + SEGMENT)
                at += SEGMENT - length + 1


def _seen(off: np.ndarray, i: int, j: int, lo: int, hi: int) -> np.ndarray:
    return np.clip(off[i : j + 1], lo, hi) - lo


def _merge(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that touch, per group."""
    if not len(start):
        return group, start, end
    o = np.lexsort((start, group))
    group, start, end = group[o], start[o], end[o]
    far = int(end.max()) + 1
    number = np.cumsum(np.append(False, group[1:] != group[:-1]))
    reach = np.maximum.accumulate(end + number * far) - number * far
    new = np.append(True, (number[1:] != number[:-1]) | (start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return group[first], start[first], reach[np.append(first[1:], len(start)) - 1]


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """Materialized anchors that occur twice or more (h, c)."""

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(0))
            found = [anchors(buf[lo:hi], _seen(off, i, j, lo, hi), length)[0] for i, j, lo, hi in _segments(off, length)]
            h, c = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "h long, c long")
    return materialize(rows.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"), "lpf-anchors")


def regions(docs: DataFrame, length: int, wanted: np.ndarray | None, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Surroundings of wanted anchors, equal ones of a task once; and (h null) the intervals of copies met in the task.
    With wanted None, docs carries the anchors of each row in a column `only`. hot: anchors that are common, and those very common."""
    sent = docs.sparkSession.sparkContext.broadcast((wanted, hot))
    gram = GRAM

    def run(batches):
        wanted, hot = sent.value
        for b in batches:
            ids = b.column(0).fill_null(2**63 - 1).to_numpy()
            keys = b.column(1).to_numpy()
            _, order = np.unique(np.rec.fromarrays([ids, keys]), return_inverse=True)
            buf, off = text_bytes(b.column(2))
            parts = []
            for i, j, lo, hi in _segments(off, length):
                part = buf[lo:hi]
                ends = _seen(off, i, j, lo, hi)
                h, a, p, q, sums = anchors(part, ends, length)
                keep = member(h, wanted if wanted is not None else np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(x or [], np.int64) for x in b.column(3)[i:j].to_pylist()]])))
                h, a, p, q = h[keep], a[keep], p[keep], q[keep]
                if not len(h):
                    continue
                inverse = powers(len(part))[1]
                code = lambda x, y, s=sums, v=inverse: mix((s[y] - s[x]) * v[x] + (y - x).astype(np.uint64))
                made = [[x[~member(h, hot[0])] for x in (h, a, p, q)]]
                for keys_, width in zip(hot, (WIDTH, NARROW)):
                    here = member(h, keys_) & ~(member(h, hot[1]) if width == WIDTH else np.zeros(len(h), bool))
                    x, y, f, g = h[here], a[here], p[here], q[here]
                    for c in range(-(-(length - gram + 1) // width) if len(x) else 0):
                        lo_, hi_ = np.maximum(f, y - (c + 1) * width + 1), np.minimum(g, y - c * width)
                        has = lo_ <= hi_
                        y_, right = y[has], (y - (c + 1) * width + 1 + length)[has]
                        made.append([mix(code(y_ - c * width, right) ^ mix(x[has].view(np.uint64) + np.uint64(c + 1))).view(np.int64), y_, lo_[has], hi_[has]])
                h, a, p, q = (np.concatenate(x) for x in zip(*made))
                row = i + np.searchsorted(ends, p, "right") - 1
                row = np.minimum(row, j - 1)
                same = mix(code(p, q + length) ^ (a - p).astype(np.uint64)).view(np.int64)
                parts.append((h, same, row, p + lo - off[row], a - p, q - p + 1, p + lo))
            if not parts:
                continue
            h, same, row, start, low, count, at = (np.concatenate(x) for x in zip(*parts))
            place = order[row].astype(np.int64)
            o = np.lexsort((start, place, same, h))
            h, same, row, start, low, count, at, place = (x[o] for x in (h, same, row, start, low, count, at, place))
            new = np.append(True, (h[1:] != h[:-1]) | (same[1:] != same[:-1]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            # equal hashes are held against the bytes; what differs stays a row of its own
            new[unequal_spans(buf, at, at + count + length - 1, lead)] = True
            new |= low != low[lead]
            copy = ~new & ((place > place[lead]) | ((place == place[lead]) & (start > start[lead])))
            first = np.flatnonzero(new)
            texts = [buf[x : x + c + length - 1].tobytes() for x, c in zip(at[first].tolist(), count[first].tolist())]
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first]), pa.array(ids[row[first]]), pa.array(keys[row[first]]), pa.array(start[first]), pa.array(low[first].astype(np.int32)), pa.array(count[first].astype(np.int32)), pa.array(texts, pa.binary()), none(len(first), pa.int64())],
                REGION_NAMES,
            )
            r, s, e = _merge(row[copy], start[copy], start[copy] + count[copy] + length - 1)
            n = len(r)
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), pa.array(ids[r]), pa.array(keys[r]), pa.array(s), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary()), pa.array(e)], REGION_NAMES)

    cols = [F.col("doc_id").cast("long"), row_key("doc_id", "text"), F.col("text").cast("string")]
    return materialize(docs.select(*cols, *(["only"] if wanted is None else [])).mapInArrow(tidy(run), REGIONS), "lpf-regions")


REGION_NAMES = [x.split()[0] for x in REGIONS.split(", ")]


def _group_copies(rows: pa.RecordBatch | pa.Table, length: int):
    """Intervals (doc_id, key, start, end) of windows with an earlier copy among complete anchors."""
    h, ids, keys, start, low, count = (rows.column(k).to_numpy() for k in range(6))
    buf, off = text_bytes(rows.column(6))
    docs, place = np.unique(np.rec.fromarrays([ids, keys]), return_inverse=True)
    far = np.int64(start.max()) + np.int64(count.max()) + 1
    here = place.astype(np.int64) * far + start  # position in the order of documents
    # equal surroundings first: one of them stands for all
    sums = prefix_sums(buf)
    whole = mix((sums[off[1:]] - sums[off[:-1]]) * powers(len(buf) + 1)[1][off[:-1]] + np.diff(off).astype(np.uint64)) ^ mix(low.astype(np.uint64))
    o = np.lexsort((here, whole, h))
    new = np.append(True, (h[o][1:] != h[o][:-1]) | (whole[o][1:] != whole[o][:-1]))
    lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    other = np.zeros(len(o), np.int64)
    other[o] = lead
    odd = low != low[other]
    odd[unequal_spans(buf, off[:-1], off[1:], other)] = True
    new |= odd[o]
    copy = o[(here[o] > here[lead]) & ~new]
    out = [(copy, start[copy], start[copy] + count[copy] + length - 1)]
    left = o[new]
    # anchors with one surrounding left are done
    one, n = np.unique(h[left], return_counts=True)
    left = left[member(h[left], one[n > 1])]
    if len(left):
        sizes = count[left].astype(np.int64)
        owner = np.repeat(left, sizes)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        position = here[owner] + j
        o = np.argsort(position, kind="stable")
        owner, j, position = owner[o], j[o], position[o]
        views = np.lib.stride_tricks.sliding_window_view(buf, length)
        windows = views[off[owner] + j]
        o = suffix_order(windows)
        windows = windows[o]
        same = (windows[1:] == windows[:-1]).all(axis=1)
        late = has_earlier(position[o], np.cumsum(np.append(False, ~same)))
        w = o[late]
        out.append((owner[w], start[owner[w]] + j[w], start[owner[w]] + j[w] + length))
    r, s, e = (np.concatenate(x) for x in zip(*out))
    g, s, e = _merge(place[r], s, e)
    return docs.f0[g], docs.f1[g], s, e


def copies(rows: DataFrame, length: int) -> DataFrame:
    """Intervals (doc_id, key, start, end) from rows of regions(), anchor by anchor."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def done(t: pa.Table):
            h = t.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
            at = 0
            while at < len(cuts) - 1:
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + ROWS, "right")) - 1)
                made = _group_copies(t.slice(cuts[at], cuts[to] - cuts[at]).combine_chunks(), length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["doc_id", "key", "start", "end"])
                at = to

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            last = b.column(0)[b.num_rows - 1].as_py()
            if size >= ROWS and held[0].column(0)[0].as_py() != last:
                t = pa.concat_tables(held)
                cut = int(np.searchsorted(t.column(0).to_numpy(), last, "left"))
                if cut:
                    yield from done(t.slice(0, cut))
                    held, size = [t.slice(cut)], t.num_rows - cut
        if size:
            yield from done(pa.concat_tables(held))

    near = rows.select(*REGION_NAMES[:7]).repartition("h").sortWithinPartitions("h")
    return near.mapInArrow(tidy(run), "doc_id long, key long, start long, end long")


def window_copies(rows: DataFrame, length: int) -> DataFrame:
    """The same from rows of keys that too many surroundings share: each window stands alone under its own digest, its least position is
    found by partial sums, and no key's rows meet in a task."""
    windows = rows.select("doc_id", "key", "start", "region", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("j"))
    windows = windows.select(F.struct("doc_id", "key", (F.col("start") + F.col("j")).alias("start")).alias("at"), F.unhex(F.sha2(F.expr(f"substring(region, j + 1, {length})"), 256)).alias("w"))
    first = windows.groupBy("w").agg(F.min("at").alias("first"))
    late = windows.join(first, "w").where(F.col("at") > F.col("first"))
    return late.select("at.doc_id", "at.key", "at.start", (F.col("at.start") + length).alias("end"))


def removed(docs: DataFrame, length: int = LENGTH, max_broadcast: int | None = None) -> DataFrame:
    """Rows (key, doc_id, spans): per document the intervals of bytes that go, maybe overlapping. A null id is the largest long."""
    counts = anchor_counts(docs, length)
    bound = {} if max_broadcast is None else {"bound": max_broadcast}
    wanted = small_keys(counts.select("h"), **bound)
    hot = HOT
    while (often := small_keys(counts.where(F.col("c") > hot).select("h"))) is None:
        hot *= 2
    often = often, small_keys(counts.where(F.col("c") > hot * VERY_HOT).select("h"))
    if wanted is None:
        docs = _with_anchors(docs, counts, length)
    near = regions(docs, length, wanted, often)
    spans, met = near.where("h is null").select("doc_id", "key", "start", "end"), near.where("h is not null")
    crowded = materialize(met.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("h"), "lpf-crowded")
    if crowded.limit(1).count():
        spans = spans.unionByName(window_copies(met.join(crowded, "h", "left_semi"), length))
        met = met.join(crowded, "h", "left_anti")
    spans = materialize(spans.unionByName(copies(met, length)), "lpf-spans")
    drop_scratch(near, counts, crowded)
    return spans.groupBy("key", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _with_anchors(docs: DataFrame, counts: DataFrame, length: int) -> DataFrame:
    """docs with the column `only`: those of its anchors that occur twice or more. For more anchors than can be sent out."""

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(1))
            keys = b.column(0).to_numpy()
            for i, j, lo, hi in _segments(off, length):
                ends = _seen(off, i, j, lo, hi)
                h, _, p, _, _ = anchors(buf[lo:hi], ends, length)
                row = np.minimum(i + np.searchsorted(ends, p, "right") - 1, j - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(h)], ["__row_key", "h"])

    rows = docs.select(row_key("doc_id", "text"), F.col("text").cast("string")).mapInArrow(run, "__row_key long, h long")
    own = rows.join(counts.select("h"), "h", "left_semi").groupBy("__row_key").agg(F.collect_set("h").alias("only"))
    return docs.withColumn("__row_key", row_key("doc_id", "text")).join(own, "__row_key", "left").drop("__row_key")


def deduplicate(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """Per document (doc_id, n_bytes, n_removed, n_spans, spans, kept): spans are the maximal removed runs, kept the bytes left."""
    spans = removed(docs, length, **settings)

    def run(batches):
        for b in batches:
            buf, off = text_bytes(b.column(1))
            values, ends = b.column(2).fill_null([]), None
            ends = values.offsets.to_numpy()
            flat = values.flatten()
            s_all, e_all = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            ends = ends - ends[0]
            size, gone, number, runs, kept = [], [], [], [], []
            for i in range(b.num_rows):
                text = buf[off[i] : off[i + 1]]
                s, e = s_all[ends[i] : ends[i + 1]], e_all[ends[i] : ends[i + 1]]
                _, s, e = _merge(np.zeros(len(s), np.int64), s, e)
                size.append(len(text))
                gone.append(int((e - s).sum()))
                number.append(len(s))
                runs.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key("doc_id", "text").alias("key"))
    spans = spans.select("spans", F.col("key").alias("k"), F.col("doc_id").alias("d"))
    rows = rows.join(spans, (F.col("key") == F.col("k")) & (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("d")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")

