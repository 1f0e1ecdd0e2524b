import hashlib
import struct

import pytest
import zstandard

from tessera.llm import warc
from tessera.llm.common import fresh_path

PAGES = "page_id long, url string, html string, id long, digest string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d", "f") for i, u, h in rows], PAGES)


def read_back(spark, rows, **how):
    path = fresh_path(spark, "warc-test")
    warc.write_warc(pages(spark, rows), path, **how)
    return warc.read_warc(spark, path)


def test_round_trip(spark):
    big, small = "<p>" + "é" * 200, "<p>tiny"
    rows = [(4, "http://a/", big), (2, "http://b/\r\nX: y", big), (9, None, big), (5, "u", small), (6, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (3, "u", "z" * 300_000), (3, "u", "z" * 300_000)]
    got = read_back(spark, rows, archive_bytes=1000).collect()
    assert len(got) == len(rows) and len({r["archive"] for r in got}) > 1
    by = {}
    for r in got:
        by.setdefault(r["record_id"], []).append(r)
    assert sorted(len(x) for x in by.values()) == [1] * 8 + [2]
    one = lambda i: by[f"<urn:x-page:{i}>"][0]
    assert one(2)["type"] == "response" and bytes(one(2)["payload"]).decode() == big
    assert one(2)["target_uri"] == "http://b/%0D%0AX:%20y"
    for i in (4, 9):
        r = one(i)
        assert (r["type"], r["refers_to"], r["payload"], r["payload_bytes"]) == ("revisit", "<urn:x-page:2>", None, 403)
        assert r["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert [one(i)["type"] for i in (5, 6, 7, 8, 3)] == ["response"] * 5
    assert by[f"<urn:x-page:null:{hashlib.sha256(big.encode()).hexdigest()}>"][0]["type"] == "revisit"
    assert one(7)["payload_bytes"] == 0 and bytes(one(7)["payload"]) == b""
    assert all(r["type"] == "response" for r in by["<urn:x-page:3>"])


def test_empty_table(spark):
    assert read_back(spark, []).count() == 0


def test_archives_are_plain_zstandard():
    """Another reader, given the dictionary, decodes every frame; skippable frames are passed over."""
    records = [warc.build_record(i, "http://x/", b"<html>" + bytes([65 + i]) * 400, hashlib.sha256(b"").hexdigest(), None, False) for i in range(40)]
    data = warc.build_archive(records) + warc.EMPTY_FRAME.encode()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert [tool.decompress(data[a:b]) for a, b, _ in warc.frames(memoryview(data))] == records


def test_compressed_dictionary_is_loaded():
    records = [warc.build_record(i, None, b"abc" * i, "", None, False) for i in range(30)]
    data = warc.build_archive(records)
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size :]
    assert [t.decompress(again[a:b]) for a, b, t in warc.frames(memoryview(again))] == records


@pytest.mark.parametrize("cut", [4, 9, 60, -1, -30])
def test_cut_archives_are_refused(cut):
    data = warc.build_archive([warc.build_record(1, "u", b"p" * 500, "", None, False)])
    with pytest.raises(warc.BadArchive):
        list(warc.frames(memoryview(data[:cut])))


GOOD = warc.build_record(1, "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)


@pytest.mark.parametrize(
    "bad",
    [
        GOOD[:-1], GOOD + b"x", GOOD.replace(b"WARC/1.1", b"WARC/9"), GOOD.replace(b"WARC-Date: ", b"X: "), GOOD.replace(b"payload\r\n", b"PAYLOAD\r\n"), GOOD.replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"),
        GOOD.replace(b"HTTP/1.1", b"XTTP/1.1"), b"", GOOD.replace(b"WARC-Type: response", b"WARC-Type response"),
    ],
)
def test_bad_records_are_refused(bad):
    assert warc.parse_record(GOOD).payload == b"payload"
    with pytest.raises(warc.BadArchive):
        warc.parse_record(bad)


def test_lenient_read_reports_errors(spark):
    path = fresh_path(spark, "warc-bad")
    records = [GOOD, GOOD[:-1], GOOD]
    data = warc.build_archive(records)
    spark.createDataFrame([(bytearray(data),)], "b binary").selectExpr("cast(b as string)").write.option("lineSep", warc.EMPTY_FRAME).text(path)
    got = warc.read_warc(spark, path, strict=False).orderBy("offset").collect()
    assert [r["error"] is None for r in got] == [True, False, True]
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_warc(spark, path).collect()


def test_archives_of_any_name_are_read(spark, tmp_path, make_pages=None):
    import shutil

    rows = [(i, f"http://x/{i}", "<p>" + "text " * i) for i in range(40)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/made")
    (tmp_path / "moved" / "deep").mkdir(parents=True)
    for k, f in enumerate(sorted((tmp_path / "made").glob("part-*"))):
        shutil.copy(f, tmp_path / "moved" / ("deep" if k % 2 else ".") / f"CC-{k:05d}.warc.zst")
    got = warc.read_warc(spark, f"file://{tmp_path}/moved").select(warc.page_of("record_id")).collect()
    assert sorted(r[0] for r in got) == list(range(40))
    assert warc.read_warc(spark, f"file://{tmp_path}/moved", glob="*.gz").count() == 0
