import hashlib
import io
import random

import pytest
import zstandard

from tillwatch.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, schema=PAGES, **options):
    archives = warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), **options)
    return archives, warc.resolve(warc.read_archives(archives)).collect()


def test_round_trip_of_payloads(spark):
    draw = random.Random(1)
    words = ["<p>", "é", "日本", "\r\n\r\n", "WARC/1.1", "text", "\x00", "</p>"]
    rows = [(i, f"http://a/{i} b\r\nX: y", " ".join(draw.choices(words, k=draw.choice([0, 3, 400])))) for i in range(300)]
    rows += [(1000 + i, None, "same page " * 200) for i in range(40)] + [(2000, "u", "x" * 3_000_000), (None, "n", "same page " * 200), (2001, "u", None), (2002, "u", "x" * 999), (2003, "u", "x" * 999)]
    rows += [(2004, "u", "y" * 1000), (2005, "u", "y" * 1000), (2005, "v", "y" * 1000)]
    archives, got = round_trip(spark, [(*r, 1, "x") for r in rows], PAGES + ", archive int, type string", archive_bytes=20_000)
    assert archives.count() > 3 and sum(r.records for r in archives.collect()) == len(rows) == len(got)
    assert all(r.error is None for r in got) and len({r.record_id for r in got}) == len(rows)
    html = {i: (t or "").encode() for i, _, t in rows}
    by_key = {}
    for r in got:
        key = None if r.row_key is None else int(r.row_key)
        by_key.setdefault(key, []).append(r)
        assert (r.payload_bytes, r.payload_digest) == (len(html[key]), hashlib.sha1(html[key]).hexdigest())
        assert r.type == "revisit" and r.payload is None or bytes(r.payload) == html[key]
    assert [r.type for r in by_key[1039]] == ["response"] and by_key[1039][0].original_key is None
    assert all(r.type == "revisit" and r.original_key == "1039" for i in [*range(1000, 1039), None] for r in by_key[i])
    assert {r.type for i in (2002, 2003, 2001) for r in by_key[i]} == {"response"}
    assert sorted(r.type for r in by_key[2005]) == ["response", "revisit"] and by_key[2004][0].original_key == "2005"
    assert by_key[0][0].target_uri == "http://a/0%20b%0D%0AX:%20y" and by_key[1000][0].target_uri is None


def test_empty_table(spark):
    archives, got = round_trip(spark, [])
    assert archives.count() == 0 and got == []


def packed(*records, dictionary=None, **options):
    out = b""
    if dictionary:
        out += warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, **options)
    return out + b"".join(compressor.compress(r) for r in records)


def errors(data):
    return [error for _, _, _, error in warc.read_archive(io.BytesIO(data))]


def test_frames_and_dictionaries():
    draw = random.Random(2)
    records = [warc.record(i, i, "u", hashlib.sha1(p).hexdigest(), p, None) for i, p in enumerate(draw.randbytes(draw.choice([0, 10, 400_000])) + b"common text " * i for i in range(60))]
    dictionary = warc.train(records)
    assert dictionary
    plain = packed(*records, write_checksum=True)
    for data in (plain, packed(*records, write_content_size=False), packed(*records, dictionary=dictionary)):
        assert errors(data) == [None] * len(records)
        offsets = [offset for offset, *_ in warc.read_archive(io.BytesIO(data))]
        assert offsets == sorted(set(offsets))
    skippable = (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert errors(skippable + plain[:0] + packed(records[0]) + skippable) == [None]
    whole = zstandard.ZstdCompressor(level=19).compress(dictionary)
    head = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(whole).to_bytes(4, "little") + whole
    assert errors(head + packed(*records, dictionary=dictionary)[8 + len(dictionary) :]) == [None] * len(records)
    assert "no dictionary" in errors(warc.DICTIONARY_FRAME.to_bytes(4, "little") + (4).to_bytes(4, "little") + b"none" + plain)[0]


@pytest.mark.parametrize(
    "old, new, says",
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"Content-Length: 66", b"Content-Length: 65", "content-length 65"),
        (b"Content-Length: 66", b"Content-Length: 9999", "content-length 9999"),
        (b"Content-Length: 66", b"Content-Length: -1", "no number"),
        (b"Content-Length: 66", b"Content-Length: 66\r\nContent-Length: 66", "twice"),
        (b"WARC-Date", b"WARC-Datum", "warc-date"),
        (b"WARC-Type: response", b"no name", "without name"),
        (b"payload", b"pay1oad", "digest does not match"),
        (b"HTTP/1.1 200 OK\r\n", b"HTTP/1.1 200 OK\r\nX: 1\r\n", "content-length 66"),
    ],
)
def test_broken_records_are_told(old, new, says):
    good = warc.record(1, 1, "u", hashlib.sha1(b"payload").hexdigest(), b"payload", None)
    assert old in good
    found = errors(packed(good, good.replace(old, new, 1), good))
    assert found[0] is None and found[2] is None and says in found[1]


def test_broken_archives_are_told(spark, tmp_path):
    good = packed(warc.record(1, 1, "u", hashlib.sha1(b"p" * 5000).hexdigest(), b"p" * 5000, None))
    assert errors(good + good[:-3]) == [None, "archive ends within a frame"]
    assert errors(good + b"something else") == [None, "no frame begins here"]
    assert errors(b"") == []
    flipped = bytearray(good + good)
    flipped[len(good) // 2] ^= 0xFF
    assert errors(bytes(flipped))[0] is not None
    (tmp_path / "a.warc.zst").write_bytes(good)
    paths = [(f"file://{tmp_path}/a.warc.zst",), (f"file://{tmp_path}/none.warc.zst",), (None,), (f"{tmp_path}/a.warc.zst",)]
    got = warc.read_archives(spark.createDataFrame(paths, "archive string")).collect()
    assert sorted(r.error is None for r in got) == [False, True, True]
    assert [r.payload_bytes for r in got if r.error is None] == [5000, 5000]
