"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

Every task packs its own rows; nothing is shuffled. A text's tokens are cut into full windows and a rest; rests are
cut into pieces of at most `piece` tokens, gathered into groups of `windows` windows less SLACK tokens each, and dealt out by
differencing; whenever a window exceeds the capacity, the group's count of windows rises by one and it is dealt out again.
What remains at a task's end is dealt out likewise, but its surplus rises into windows whose lengths are powers of two, which
need no padding.

Defined cases: a null text is empty and gives its end token only; repeated rows, null or repeated ids are separate
texts; an empty table gives no pieces; extra columns are ignored; texts of any length are packed whole.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import LOW_BYTES, MULTIPLIER, blocks_at, chunks, few_rows, hash_spans, materialize, text_bytes, trim, unequal_spans, worker_cache

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens by which a group's windows fall short of their capacity on average, so that differencing rarely exceeds it.
SLACK = 4
#: Bytes, about, of the space-separated parts and their ids that a worker keeps.
CACHE_BYTES = 48 << 20
#: Places that note which parts were met before: only a part that is met again is kept.
MET = 1 << 21
#: Parts that the library gets at once, and of those as one text, with a sign of its own between them.
SLICE, JOINED = 4096, 64
#: Signs, each a single id between spaces; one that no part holds parts them.
SIGNS = "~^|`\\{}[]<>=+*_"
#: Bytes of text that are tokenized together.
BATCH_BYTES = 768 << 10

# Bytes of texts that every Unicode version normalises alike and splits at white space alike: tab, newline, return, printable
# ASCII, U+00A1 to U+017F without U+0130, and the usual punctuation of U+2010 to U+203F. Others go through the library whole.
_ODD = np.ones(256, bool)
_ODD[[9, 10, 13]] = False
_ODD[0x20:0x7F] = False
_ODD[0x80:0xC0] = False  # judged by what stands before them
_ODD[[0xC2, 0xC3, 0xC4, 0xC5, 0xE2]] = False
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xC4, 0xE2, 0x3C]] = True
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 9, 10, 11, 12, 13]] = False


_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def odd_bytes(buf: np.ndarray) -> np.ndarray:
    """Positions at which a text isn't plain in the above sense."""
    odd = _ODD[buf]
    at = np.flatnonzero(_LEAD[buf])  # judged with the bytes after them
    if len(at):
        padded = np.append(buf, np.zeros(2, np.uint8))
        first, next_, third = buf[at], padded[at + 1], padded[at + 2]
        bad = (first == 0xC2) & (next_ < 0xA1) | (first == 0xC4) & (next_ == 0xB0)
        bad |= (first == 0xE2) & ((next_ != 0x80) | (third < 0x90) | ((third > 0xA7) & (third < 0xB0)))
        bad |= (first == 0x3C) & (next_ == 0x7C)  # might start the name of a special token
        odd[at[bad]] = True
    return np.flatnonzero(odd)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items out to k parts of near-equal sums: the two partial partitions with the largest imbalances are merged
    with opposing order, until one is left. Gives the item indexes of each part."""
    if not sizes:
        return [[] for _ in range(k)]
    heap, made = [], []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        made.append((sums, i, None, None))
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = made[a][0] + made[b][0][::-1]
        order = np.argsort(-sums)
        sums = sums[order]
        sums -= sums[-1]
        made.append((sums, a, b, order))
        heapq.heappush(heap, (-int(sums[0]), len(made) - 1))
    parts: list[list[int]] = [[] for _ in range(k)]
    stack = [(heap[0][1], np.arange(k))]  # slots[i]: the part that the i-th largest sum of this node belongs to
    while stack:
        node, slots = stack.pop()
        _, a, b, order = made[node]
        if b is None:
            parts[slots[0]].append(a)
        else:
            own = np.empty(k, np.int64)
            own[order] = slots
            stack += [(a, own), (b, own[::-1])]
    return parts


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of items of at most `capacity`; the count rises whenever a window exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def part_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what white space parts, and of a single full stop or comma that ends such a part after an ASCII letter
    or digit: the vocabulary's pattern always splits there as well."""
    n = len(buf)
    inside = _INSIDE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    point = ((buf == 0x2E) | (buf == 0x2C)) & end & ~start
    point[1:] &= _ALNUM[buf[:-1]]
    start |= point
    end[:-1] |= point[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def part_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of parts: for up to 7 bytes the bytes and their number themselves, else 56 bits of a hash."""
    padded, sizes = np.append(buf, np.zeros(8, np.uint8)), ends - starts
    codes = blocks_at(padded, starts) & LOW_BYTES[np.minimum(sizes, 8)] | sizes.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(sizes > 7)
    codes[long] = hash_spans(buf, starts[long], ends[long]) >> np.uint64(8) | np.uint64(0xFF << 56)
    return codes


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class WordTokenizer:
    """Ids of whole texts as the tokenizers library gives them; the ids of parts that come again are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.known: dict[bytes, bytes] = worker_cache()
        self.size = 0
        self.met = np.zeros(MET, bool)
        one = lambda x: self.library.encode(x, add_special_tokens=False).ids
        self.signs = [(x, one(x)[0]) for x in SIGNS if len(one(x)) == 1 and one(f"a {x} b") == [*one("a"), *one(x), *one("b")]]

    def _again(self, codes: np.ndarray) -> list[bool]:
        """Which of these distinct parts were met before, as far as is known, and note them all."""
        if np.count_nonzero(self.met) > MET // 2:
            self.met[:] = False
        at = (codes * np.uint64(MULTIPLIER) >> np.uint64(64 - (MET.bit_length() - 1))).astype(np.int64)
        again = self.met[at].tolist()
        self.met[at] = True
        return again

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts. Many go as one text, which costs the library less than as many texts; a sign that none of them holds tells where
        each one ends."""
        every = b" ".join(parts)
        sign = next((x for x in self.signs if x[0].encode() not in every), None)
        if sign is None:
            return [_packed(e.ids) for e in self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        between = f" {sign[0]} ".encode()
        texts = [between.join(parts[k : k + JOINED]).decode() for k in range(0, len(parts), JOINED)]
        out: list[bytes] = []
        for e in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == sign[1]), len(ids)) * 4
            data, begins = ids.tobytes(), np.append(0, ends[:-1] + 4)
            out += [data[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        if len(out) != len(parts):
            raise ValueError("the tokenizer joins what white space parts")
        return out

    def _whole(self, text: bytes) -> np.ndarray:
        return np.asarray(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text. The library never joins what white space parts, so a plain text's ids are those of
        its parts, and equal parts are looked up once; a part that shares its code with another one sends its text to the library."""
        odd = np.unique(np.searchsorted(off, odd_bytes(buf), "right") - 1) if len(buf) else np.zeros(0, np.int64)
        data, buf = buf.tobytes(), _LOWER[buf]  # the vocabulary is of lower case
        if not len(buf):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        starts, ends = part_spans(buf, off)
        row = np.searchsorted(off, starts, "right") - 1
        if len(odd):
            plain = ~np.isin(row, odd)
            starts, ends, row = starts[plain], ends[plain], row[plain]
        codes, first, back = np.unique(part_codes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(bad := unequal_spans(buf, starts, ends, first[back])):
            odd = np.union1d(odd, row[bad])
        low = buf.tobytes()
        parts = [low[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        known = self.known
        if self.size > CACHE_BYTES or not known:
            known.clear()
            self.size = 0
        ids = list(map(known.get, parts))
        new = [i for i, x in enumerate(ids) if x is None]
        again = self._again(codes)
        for at in range(0, len(new), SLICE):
            some = new[at : at + SLICE]
            for i, made in zip(some, self._parts([parts[i] for i in some]), strict=True):
                ids[i] = made
                if again[i]:
                    known[parts[i]] = ids[i]
                    self.size += len(parts[i]) + len(ids[i]) + 150
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[back]
        place = np.cumsum(each)
        stream = flat[np.repeat(begin[back] - place + each, each) + np.arange(int(place[-1]) if len(place) else 0)]
        cuts = np.append(0, place)[np.searchsorted(row, np.arange(len(off)))]
        out = [stream[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in odd.tolist():
            out[k] = self._whole(data[off[k] : off[k + 1]])
        return out


class Packer:
    """Turns a task's texts into pieces. windows: windows of a group; piece: most tokens
    of an item."""

    def __init__(self, first: int, capacity: int = CAPACITY, windows: int = 256, piece: int = 256):
        self.capacity, self.windows, self.piece, self.next = capacity, windows, piece, first
        self.room = windows * max(1, capacity - SLACK)
        self.items: list[tuple[int, int, int]] = []  # (text, start, length)
        self.held = 0
        self.out: list[tuple[int, int, int, int, int]] = []  # (text, start, length, sequence, offset)

    def add(self, text: int, n: int) -> None:
        at = 0
        while n - at >= self.capacity:
            self._window([(text, at, self.capacity)])
            at += self.capacity
        while at < n:
            take = min(self.piece, n - at, self.room - self.held)
            self.items.append((text, at, take))
            self.held += take
            at += take
            if self.held == self.room:
                self._group(self.windows)

    def _window(self, items: list[tuple[int, int, int]]) -> None:
        offset = 0
        for text, start, length in items:
            self.out.append((text, start, length, self.next, offset))
            offset += length
        self.next += 1

    def _group(self, k: int, surplus: bool = False) -> list[tuple[int, int, int]]:
        """Deal the items out to k windows, or to more as long as one exceeds the capacity. With `surplus`, what exceeds it is cut off
        instead and returned, for further windows of its own."""
        items, self.items, self.held = self.items, [], 0
        over: list[tuple[int, int, int]] = []
        while True:
            parts = [[items[i] for i in part] for part in differencing([x[2] for x in items], k)]
            if surplus or all(sum(x[2] for x in own) <= self.capacity for own in parts):
                break
            k += 1
        for own in parts:
            excess = sum(x[2] for x in own) - self.capacity
            while excess > 0:
                text, start, length = own.pop()
                keep = max(0, length - excess)
                over.append((text, start + keep, length - keep))
                if keep:
                    own.append((text, start, keep))
                excess -= length - keep
            if own:
                self._window(own)
        return over

    def finish(self) -> None:
        """Full windows of what is left by differencing, then windows of powers of two."""
        full = self.held // self.capacity
        items, self.items, self.held = self.items, [], 0
        size = 0
        tail: list[tuple[int, int, int]] = []
        for text, start, length in items:
            take = min(length, full * self.capacity - size)
            if take:
                self.items.append((text, start, take))
                size += take
            if take < length:
                tail.append((text, start + take, length - take))
        if self.items:
            tail += self._group(full, surplus=True)
        left = sum(x[2] for x in tail)
        while left:
            want = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= want
            own = []
            while want:
                text, start, length = tail.pop(0)
                take = min(length, want)
                own.append((text, start, take))
                want -= take
                if take < length:
                    tail.insert(0, (text, start + take, length - take))
            self._window(own)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (doc_id, text), materialized: each id of each document lies in exactly one."""

    def run(batches):
        encoder = _tokenizer(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        texts: dict[int, tuple] = {}
        count = 0

        def emit():
            rows = [(texts[t][0], s, n, zlib.crc32(texts[t][1][s : s + n]), len(texts[t][1]), q, o) for t, s, n, q, o in packer.out]
            packer.out.clear()
            waiting = {x[0] for x in packer.items}
            for t in [t for t in texts if t not in waiting]:
                del texts[t]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            ids = b.column(0).to_pylist()
            buf, off = text_bytes(b.column(1))
            for i, j in chunks(off, BATCH_BYTES):
                for id_, made in zip(ids[i:j], encoder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i]), strict=True):
                    texts[count] = (id_, np.append(made, np.uint32(end)).astype("<u4"))
                    packer.add(count, len(made) + 1)
                    count += 1
                if packer.out:
                    yield emit()
        packer.finish()
        if packer.out:
            yield emit()
        trim()

    with few_rows(docs.sparkSession, 1000):  # whole texts in small batches; the pieces are a small table
        return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES), "packing-pieces")


_made: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
