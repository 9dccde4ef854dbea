"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one token can be the last of the prefix's encoding. Storing it per
prefix gives the ids of any prefix by walking back, appends in time proportional to what is appended, and
re-encoding from the first changed byte only. A token is a prefix's last one if the pair it makes with the last
token before it would not have been merged differently.

Defined cases: a null text is empty, has no ids and the digest of no bytes; texts of any length, repeated rows and
null ids are rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import worker_cache

#: Most pieces whose ids a worker keeps, and most token pairs whose validity it keeps.
CACHE = 600_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Merge ranks by bytes, with the pair of tokens that each token is merged from last."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}  # by byte; -1: the token that ends here
        for b, r in ranks.items():
            node = self.trie
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = r
        for r in sorted(self.token):  # parts of a token have smaller ranks, so they are known by now
            b = self.token[r]
            if len(b) == 1:
                self.parts[r] = (r, r)
                continue
            ids = self._last_two(b)
            if ids is not None:
                self.parts[r] = ids
                self.merged[ids] = r
            else:
                self.parts[r] = (r, r)

    def _last_two(self, b: bytes) -> tuple[int, int] | None:
        """The encoding of b as if b were no token, if it is two tokens."""
        for cut in range(len(b) - 1, 0, -1):
            left, right = self.rank.get(b[:cut]), self.rank.get(b[cut:])
            if left is not None and right is not None and max(left, right) < self.rank[b] and self.fits(left, right):
                return left, right
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay as they are when they stand side by side."""
        known = self.valid.get((left, right))
        if known is None:
            if len(self.valid) > CACHE:
                self.valid.clear()
            known = self.valid[left, right] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo merges from the latest to the earliest on both sides of the border; a merge across the border of a
        # smaller rank than the merge undone last would have come first.
        limit = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a != limit:
                    continue
                # a is a single byte: only b can be undone
                limit, c = b + 1, self.parts[b][0]
                if c == b:
                    return True
                b = c
            else:
                old, c = b, self.parts[b][0]
                limit = b + 1
                if c != old:
                    b = c
                    continue
                limit, c = a, self.parts[a][1]
                if c == a:
                    return True
                a = c


class PrefixTable:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        old = len(self.last)
        data = self.data = self.data + more
        n, last, valid, fits, root = len(data), self.last + [-1] * len(more), self.v.valid, self.v.fits, self.v.trie
        for start in range(max(0, old - self.v.longest + 1), n):
            before = last[start - 1] if start else -1
            node, end = root, start
            while end < n and (node := node.get(data[end])) is not None:
                end += 1
                token = node.get(-1)
                if token is not None and end > old and last[end - 1] < 0:
                    good = before < 0 or valid.get((before, token))
                    if good is None:
                        good = fits(before, token)
                    if good:
                        last[end - 1] = token
        if n and min(last[old:], default=0) < 0:
            raise ValueError("a byte is no token")
        self.last = last

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Change bytes start to end; prefixes up to start keep their entries."""
        data = self.data
        self.data, self.last = data[:start], self.last[:start]
        self.append(new + data[end:])

    def ids(self, length: int | None = None) -> list[int]:
        """The ids of the prefix of that length, or of all."""
        out, at, size = [], len(self.last) if length is None else length, self.v.token
        while at:
            out.append(self.last[at - 1])
            at -= len(size[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts: each match of the pattern separately, each by its prefix table."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.v = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = worker_cache()
        top = max(self.v.token) + 1
        self.token = [self.v.token.get(i, b"") for i in range(top)]

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.v.rank.get(data)
        return [whole] if whole is not None else PrefixTable(self.v, data).ids()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        pieces = self.split.findall(text)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = np.asarray(self.piece(p), "<u4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EditableText:
    """A text whose ids follow appends and edits: only pieces that change are encoded again, and of a piece that grows
    only the prefixes that are new."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.tables = [PrefixTable(encoder.v, p.encode()) for p in encoder.split.findall(text)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        self.text = self.text[:start] + new + self.text[end:]
        pieces = [p.encode() for p in self.encoder.split.findall(self.text)]
        old, k = self.tables, 0
        while k < min(len(pieces), len(old)) and old[k].data == pieces[k]:
            k += 1
        tail = 0
        while tail < min(len(pieces), len(old)) - k and old[-1 - tail].data == pieces[-1 - tail]:
            tail += 1
        middle = []
        for i, p in enumerate(pieces[k : len(pieces) - tail]):
            table = old[k] if not i and k < len(old) - tail else None
            if table is not None:
                same = next((j for j, (x, y) in enumerate(zip(table.data, p)) if x != y), min(len(table.data), len(p)))
                table.replace(same, len(table.data), p[same:])
            middle.append(table or PrefixTable(self.encoder.v, p))
        self.tables = old[:k] + middle + old[len(old) - tail :]

    def ids(self) -> list[int]:
        rank = self.encoder.v.rank
        return [i for t in self.tables for i in ([rank[t.data]] if t.data in rank else t.ids())]


_made: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _made:
        _made[path, pattern] = Encoder(path, pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document the number and digest of its ids, and the digest of the bytes that they decode to."""

    def run(batches):
        e = encoder(ranks, pattern)
        for b in batches:
            ids, column, rows = b.column(0), b.column(1), []
            for i in range(b.num_rows):
                made = e.encode(column[i].as_py() or "")
                rows.append((ids[i].as_py(), len(made) // 4, hashlib.sha256(made).hexdigest(), hashlib.sha256(e.decode(made)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def token_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document its ids themselves (doc_id, ids)."""

    def run(batches):
        e = encoder(ranks, pattern)
        for b in batches:
            ids = [np.frombuffer(e.encode(t.as_py() or ""), "<u4").astype(np.int32).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")
