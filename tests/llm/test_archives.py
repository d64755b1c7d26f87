"""WARC bundles: round trips, revisits, seek tables, look-ups."""

import hashlib

import pytest

from engramspark.llm import warc

BIG = "<p>" + "x" * 1200


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


ROWS = [(1, "http://a/1", BIG, "z"), (2, "http://a/2\r\nEvil: 1", BIG, "z"), (3, None, "short", "z"), (4, "http://a/4", "short", "z"), (5, "http://é/5", None, "z"), (None, "http://a/6", BIG, "z"), (7, "u", "HTTP\r\n\r\nWARC/1.1\r\n" + "日" * 3000, "z"), (2, "http://a/2", BIG, "z")]


def test_round_trip(spark, tmp_path):
    manifest = warc.archive(pages(spark, ROWS), f"file://{tmp_path}/w", frame_bytes=2000, bundle_bytes=3000)
    got = warc.read_bundles(manifest).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html, _ in ROWS:
        data = (html or "").encode()
        for r in by[page_id]:
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert [(r.record_type, r.refers_to) for r in by[1] + by[None]] == [("revisit", 2)] * 2
    assert all(r.record_type == "response" and r.refers_to is None for i in (2, 3, 4, 5, 7) for r in by[i])
    one = warc.lookup(manifest, manifest.filter("page_id = 7").select("record_id")).collect()
    assert [r.page_id for r in one] == [7] and bytes(one[0].payload).endswith("日".encode())


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import zstandard

    warc.archive(pages(spark, ROWS), f"file://{tmp_path}/w", frame_bytes=1500)
    for path in (tmp_path / "w").iterdir():
        data = path.read_bytes()
        with path.open("rb") as f:
            table = warc.seek_table(f, len(data))
        frames = [zstandard.ZstdDecompressor().decompress(data[a : a + c], max_output_size=n) for a, c, n in table]
        assert all(x.startswith(b"WARC/1.1\r\n") for x in frames)
        assert [len(x) for x in frames] == [n for _, _, n in table]


def test_empty_and_all_null(spark, tmp_path):
    assert warc.read_bundles(warc.archive(pages(spark, []), f"file://{tmp_path}/e")).collect() == []
    got = warc.read_bundles(warc.archive(pages(spark, [(None, None, BIG, None), (None, None, BIG, None)]), f"file://{tmp_path}/n")).collect()
    assert [r.record_type for r in got] == ["response", "response"]


def test_damage_is_noticed():
    record = warc.to_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, "response", None)
    assert [r["payload"] for r in warc.parse_records(record)] == [b"abc"]
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_records(record.replace(b"abc", b"abd")))
