import base64
import hashlib

from pixelloom.llm import warc

PAGES = [(1, "http://a/", "same"), (2, "http://b/\n", "same"), (5, None, "same"), (3, "u", ""), (4, "u", None), (6, "u", "é" * 300_000), (7, "u", "other"), (None, "u", "other"), (8, "u", "x"), (8, "v", "x")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest long").repartition(3)


def test_round_trip(spark):
    _, records = warc.archive(pages(spark))
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(records).collect()), key=repr)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        best = max((p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        again = best is not None and i != best
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    _, records = warc.archive(pages(spark), min_revisit_bytes=5)
    assert {r.id for r in records.where("record_type = 'revisit'").collect()} == {7} or {r.id for r in records.where("record_type = 'revisit'").collect()} == {None}


def test_seek_reads_one_frame(spark, tmp_path):
    index = warc.write_bundles(warc.decide(pages(spark)), f"file://{tmp_path}", frame_bytes=100, bundle_bytes=500)
    assert index.count() == len(PAGES) and index.select("bundle").distinct().count() > 1
    got = warc.lookup(index, index.where("id in (5, 6)")).collect()
    assert {r.id: r.payload.decode() for r in got} == {5: "same", 6: "é" * 300_000}
    row = index.where("id = 6").first()
    reader = warc.BundleReader(row.bundle)
    assert reader.record(row.frame, row.start, row.length)["id"] == 6


def test_no_pages(spark):
    index, records = warc.archive(pages(spark).where("false"))
    assert index.count() == 0 and warc.resolve(records).count() == 0


def test_records_have_a_date_and_identifiers_of_their_own(spark, tmp_path):
    index = warc.write_bundles(warc.decide(pages(spark)), f"file://{tmp_path}", date="2024-05-06T07:08:09Z")
    heads = []
    for r in index.collect():
        data = warc.BundleReader(r.bundle).frame(r.frame)[r.start : r.start + r.length]
        heads.append(dict(x.split(b": ", 1) for x in data[: data.index(b"\r\n\r\n")].split(b"\r\n")[1:]))
    assert all(h[b"WARC-Date"] == b"2024-05-06T07:08:09Z" for h in heads) and len({h[b"WARC-Record-ID"] for h in heads}) == len(PAGES)
    assert all({b"WARC-Type", b"Content-Length"} <= h.keys() for h in heads)


def test_each_bundle_is_read_by_one_task(spark, tmp_path):
    index = warc.write_bundles(warc.decide(pages(spark)), f"file://{tmp_path}", frame_bytes=100, bundle_bytes=100)
    read = warc.read_bundles(index)
    assert read.rdd.getNumPartitions() == index.select("bundle").distinct().count()


def test_every_revisit_leads_to_its_response(spark, tmp_path):
    """WARC-Refers-To names exactly one record, a response of equal digest; repeated ids and payloads included."""
    rows = [*PAGES, (5, "again", "same"), (5, "again", "same"), (None, None, "nobody's"), (None, None, "nobody's"), (1 << 60, "big", "same!"), ((1 << 60) - 1, "big", "same!")]
    index = warc.write_bundles(warc.decide(pages(spark, rows)), f"file://{tmp_path}", frame_bytes=100, bundle_bytes=500)
    heads = []
    for r in index.collect():
        data = warc.BundleReader(r.bundle).frame(r.frame)[r.start : r.start + r.length]
        heads.append(dict(x.split(b": ", 1) for x in data[: data.index(b"\r\n\r\n")].split(b"\r\n")[1:]))
    named = {h[b"WARC-Record-ID"]: h for h in heads}
    assert len(named) == len(heads) == len(rows)
    revisits = [h for h in heads if h[b"WARC-Type"] == b"revisit"]
    assert len(revisits) == 5
    for h in revisits:
        response = named[h[b"WARC-Refers-To"]]
        assert response[b"WARC-Type"] == b"response" and response[b"WARC-Payload-Digest"] == h[b"WARC-Payload-Digest"]
