"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; each bundle ends in a skippable frame with the seek table of the
public seekable format, and an index maps record identifiers to (bundle, frame, offset in the frame, length).

Defined cases: a null payload is empty; rows with equal payloads of at least `min_revisit_bytes` share one
response, the row with the largest id (every row that carries that id is one), the others are revisits; a null
id sorts lowest, and a group with null ids only is all response. A null url has no target header. An empty table
gives no bundles. Extra columns are ignored. Repeated rows are separate records.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import materialize, scratch_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27
#: Fixed values of the public seekable format: skippable frame and seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "id long, bundle string, frame int, start long, length long"
READ = "id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
#: Date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(id_, number: str) -> bytes:
    return b"<urn:page:%s:%s>" % (b"null" if id_ is None else str(id_).encode(), number.encode())


def _id(urn: str) -> int | None:
    page = urn.rstrip(">").split(":")[2]
    return None if page == "null" else int(page)


def record_bytes(id_, url, refers_to, digest: str, payload: bytes | None, date: str = DATE, number: str | None = None) -> bytes:
    """One WARC/1.1 record; a payload of None makes a revisit of refers_to. A response that revisits refer to is named by its id and digest;
    number names the others."""
    kind = b"revisit" if payload is None else b"response"
    block = HTTP + (payload or b"")
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: " + _urn(id_, digest if number is None else number), b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(b"WARC-Target-URI: " + safe.encode())
    if payload is None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to, digest)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, start: int) -> tuple[dict, int]:
    """The record that starts there, and where the next one does."""
    view = bytes(data[start : start + 65536])
    if (at := view.find(b"\r\n\r\n")) < 0:
        view = bytes(data[start:])
        at = view.index(b"\r\n\r\n")
    lines = view[:at].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = start + at + 4
    size = int(head["Content-Length"])
    block = bytes(data[body : body + size])
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    revisit = head["WARC-Type"] == "revisit"
    out = {
        "id": _id(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
        "refers_to": _id(head["WARC-Refers-To"]) if revisit else None,
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None if revisit else payload,
    }
    return out, body + size + 4


class BundleWriter:
    """Writes frames to one bundle at a time; a bundle's name is new for every attempt, so a repeated task never
    overwrites what an index already points to."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.out = None
        self.rows: list[tuple] = []

    def add(self, id_, record: bytes) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            self.name, self.out, self.table, self.written = f"{self.folder}/{name}", self.fs.open_output_stream(f"{self.root}/{name}", compression=None), [], 0
            self.frame, self.filled = [], 0
        self.rows.append((id_, self.name, len(self.table), self.filled, len(record)))
        self.frame.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self._end_frame()
            if self.written >= self.bundle_bytes:
                self.close()

    def _end_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), self.filled))
            self.written += self.filled
            self.frame, self.filled = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._end_frame()
            body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
            self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
            self.out.close()
            self.out = None

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, bundle: str):
        fs, path = pafs.FileSystem.from_uri(bundle)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{bundle} has no seek table")
        table = np.frombuffer(self.file.read_at(8 * frames, size - 9 - 8 * frames), "<u4").reshape(frames, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes = table[:, 1]

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k]))

    def record(self, frame: int, start: int, length: int) -> dict:
        return parse_record(self.frame(frame)[start : start + length], 0)[0]

    def records(self) -> Iterator[dict]:
        for k in range(len(self.sizes)):
            data, at = self.frame(k), 0
            while at < len(data):
                out, at = parse_record(data, at)
                yield out


def decide(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (id, url, refers_to, digest, payload, main): payload is null for revisits, main is the one response of its payload that revisits
    refer to."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    repeated = materialize(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id"), "warc-repeated")
    if repeated.limit(1).count():  # rows of such ids are written once, so that their numbers stay
        several = materialize(rows.join(repeated, "id", "left_semi").withColumn("rid", F.monotonically_increasing_id() + 1), "warc-several")
        rows = rows.join(repeated, "id", "left_anti").withColumn("rid", F.lit(0).cast("long")).unionByName(several)
    else:
        rows = rows.withColumn("rid", F.lit(0).cast("long"))
    best = rows.groupBy("digest", "size").agg(F.max("id").alias("best"), F.max_by("rid", "id").alias("main"))
    again = (F.col("size") >= min_revisit_bytes) & F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return rows.join(best, ["digest", "size"]).select(
        "id", "url", F.when(again, F.col("best")).alias("refers_to"), "digest", F.when(~again, F.col("payload")).alias("payload"),
        (F.col("id").isNotNull() & F.coalesce(F.col("rid") == F.col("main"), F.lit(False))).alias("main"),
    )


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None) -> DataFrame:
    """Write rows of decide() to bundles in a shared folder; the index of what the finished tasks wrote. date: WARC-Date of the
    records, by default the time of the call."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        w = BundleWriter(folder, frame_bytes, bundle_bytes)
        run, count = uuid.uuid4().hex, 0  # no two records of any attempts share an identifier
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                id_, url, refers, digest, payload, main = (c[i].as_py() for c in cols)
                w.add(id_, record_bytes(id_, url, refers, base64.b32encode(bytes.fromhex(digest)).decode(), payload, date, None if main else f"{run}-{count}"))
                count += 1
        w.close()
        rows = w.take()
        if rows:
            names = ["id", "bundle", "frame", "start", "length"]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return materialize(records.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, payloads checked against their digests."""

    def read(batches):
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in BundleReader(bundle).records():
                    if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != r["payload_digest"]:
                        raise ValueError(f"{bundle}: record {r['id']} doesn't match its digest")
                    rows.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    # a bundle's number in the order of names deals the bundles out evenly, one to a task as far as there are tasks
    bundles = materialize(index.groupBy("bundle").agg(F.max("frame").alias("frames")), "warc-bundles")
    tasks = max(1, min(10_000, bundles.count()))
    return bundles.select("bundle").repartitionByRange(tasks, "bundle").mapInArrow(read, READ)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema)


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a table of ids (column id), each read through its frame alone. Ids that aren't there and null ids give nothing; repeated
    ids of the table count once, and all records of an id are given."""

    def read(batches):
        for batch in batches:
            rows = []
            for x in sorted(batch.to_pylist(), key=lambda x: (x["bundle"], x["frame"], x["start"])):
                rows.append(BundleReader(x["bundle"]).record(x["frame"], x["start"], x["length"]))
            if rows:
                yield _batch(rows)

    return index.join(ids.select("id").distinct(), "id", "left_semi").mapInArrow(read, READ)


def archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, **cols: str) -> tuple[DataFrame, DataFrame]:
    """Write pages to bundles and give (index, records read back)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_bundles(decide(pages, min_revisit_bytes, **cols), folder)
    return index, read_bundles(index)


def resolve(records: DataFrame) -> DataFrame:
    """Per record its payload's size; a revisit has that of the response it refers to."""
    small = records.select("id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("size"))
    small = materialize(small, "warc-read")
    target = small.where("record_type = 'response'").select(
        F.col("id").alias("refers_to"), "payload_digest", F.col("size").alias("found")
    ).distinct()
    return small.join(target, ["refers_to", "payload_digest"], "left").select(
        "id", F.coalesce("size", "found").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
