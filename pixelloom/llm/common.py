"""Shared helpers: scratch tables in the shared folder, size-checked key sets, vectorised word hashing.

Null texts count as empty everywhere. Every helper works on whole texts.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that are ever broadcast at once (8 bytes each); more go through a shuffled join.
MAX_BROADCAST_KEYS = 4_000_000
#: Bytes of text that a vectorised kernel takes at once, unless one text alone is longer.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine does on a
    local master (tests); on a cluster that would lose data, so it is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="pixelloom-"))
    return d.rstrip("/")


_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = 150) -> Iterator[None]:
    """While it lasts, Arrow batches have at most so many rows; then the session's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back, so lost executors lose no work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and broadcasts of finished queries once the driver's collectors find them unused: let them look."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """An executor's heap stays as large as the work so far has made it, beside the memory that the Python workers of the next stage need: let every
    executor collect its garbage in full, after which the JVM gives back what it doesn't use. One task a core, so that each has one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def small_keys(keys: DataFrame, bound: int = MAX_BROADCAST_KEYS) -> np.ndarray | None:
    """The one long column of a materialized table as a sorted array if it has at most `bound` rows, else None."""
    if keys.count() > bound:
        return None
    t = keys.toArrow() if keys.columns else None
    return np.sort(np.asarray(t.column(0).to_numpy(), dtype=np.int64))


def small_counts(table: DataFrame, bound: int = MAX_BROADCAST_KEYS) -> tuple[np.ndarray, np.ndarray] | None:
    """(sorted keys, their counts) of a materialized table of two long columns of at most `bound` rows, else None."""
    if table.count() > bound:
        return None
    t = table.toArrow()
    keys, counts = (t.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    del t
    trim()
    order = np.argsort(keys)
    return keys[order], counts[order]


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of int64 values that are in the sorted array keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def row_key(*cols: str):
    """64-bit identity of a row: equal rows share it, nulls included."""
    return F.xxhash64(*[F.col(c) for c in cols])


# ---- what workers keep between tasks --------------------------------------------------------------

_kept: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that a worker keeps from task to task until an operator needs the room."""
    _kept.append({})
    return _kept[-1]


def release_caches() -> None:
    """Free what operators of earlier stages have kept in this worker."""
    if any(_kept):
        for d in _kept:
            d.clear()
        trim()


def tidy(run):
    """run for mapInArrow, with caches of other operators freed before a task and its own memory given back after it."""

    def wrapped(batches):
        release_caches()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    """Give freed memory of this process back to the system, where that is possible."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


# ---- text buffers -------------------------------------------------------------------------------


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `size` bytes together; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = []
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (MULTIPLIER, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_BYTES:  # a very long text: used once, not kept
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums s with s[j]-s[i] = hash of buf[i:j] times the i-th power."""
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_LETTER[buf] * powers(len(buf))[0], out=s[1:])
    return s


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes not in `space` that don't cross texts."""
    n = len(buf)
    inside = ~space[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def blocks_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one little-endian number. padded: bytes with 8 more at their end."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at]


#: Masks of the lowest 0 to 8 bytes.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span beyond which it is digested by itself.
LONG_SPAN = 512


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: a chain of finalised 8-byte blocks, so spans that differ in one block never collide; spans
    of more than LONG_SPAN bytes by a cryptographic digest."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) + np.uint64(MULTIPLIER))
    todo, at = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(todo):
        left = sizes[todo] - at
        h[todo] = mix(h[todo] * np.uint64(MULTIPLIER) ^ (blocks_at(padded, starts[todo] + at) & LOW_BYTES[np.minimum(left, 8)]))
        todo, at = todo[left > 8], at + 8
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def unequal_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Spans that differ in a byte from the span that stands for them; lead: which one does."""
    padded, sizes = np.append(buf, np.zeros(8, np.uint8)), ends - starts
    todo, at, bad = np.flatnonzero((lead != np.arange(len(lead)))), 0, []
    bad.append(todo[sizes[todo] != sizes[lead[todo]]])
    todo = todo[sizes[todo] == sizes[lead[todo]]]
    while len(todo):
        mask = LOW_BYTES[np.minimum(sizes[todo] - at, 8)]
        other = (blocks_at(padded, starts[todo] + at) ^ blocks_at(padded, starts[lead[todo]] + at)) & mask != 0
        bad.append(todo[other])
        at += 8
        todo = todo[~other & (sizes[todo] > at)]
    return np.concatenate(bad)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space, A-Z lower-cased) of the texts, and their number per text."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    buf = _LOWER[buf]
    starts, ends = word_spans(buf, offsets)
    return hash_spans(buf, starts, ends), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams; a text with fewer words is one n-gram, without words none."""
    w, counts = words(buf, offsets)
    ends = np.cumsum(counts)
    grams = np.full(max(0, len(w) - size + 1), size, np.uint64)
    for j in range(size):
        grams = mix(grams * np.uint64(MULTIPLIER) ^ w[j : j + len(grams)])
    out = []
    for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if c >= size:
            out.append(np.unique(grams[e - c : e - size + 1]))
        elif c:
            whole = np.full(1, c, np.uint64)
            for x in w[e - c : e]:
                whole = mix(whole * np.uint64(MULTIPLIER) ^ x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
