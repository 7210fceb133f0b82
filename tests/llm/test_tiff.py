import hashlib
import struct
import zlib

import numpy as np
import pytest

from glintscan.llm import queries, tiff

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_pages_come_back(order, predictor, compression, tile):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 4, (37, 21, 1)).astype(np.uint8), rng.integers(0, 60_000, (5, 40, 3)).astype(np.uint16), np.zeros((300, 64, 1), np.uint8), rng.integers(0, 256, (90, 90, 3)).astype(np.uint8)]
    out = tiff.decode(tiff.encode(pages, compression, predictor, 8, tile, order))
    assert len(out) == 4
    for a, b in zip(pages, out):
        assert a.dtype == b.dtype and (a == b).all()


def test_codecs():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 130, 9000):
        for top in (1, 3, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # the format's own example of runs
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_odd_files(spark):
    good = tiff.encode([np.ones((2, 2, 1), np.uint8), np.ones((3, 2, 1), np.uint8)])
    looped = bytearray(good)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"II*\0" + b"\0" * 4), (5, good[:40]), (None, b"no picture"), (6, bytes(looped))]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumnRenamed("doc_id", "id")
    out = tiff.read_pages(df.selectExpr("id", "media", "'x' AS feature"), keep=["id", "feature"])
    got = sorted([(r.id, r.page, r.height, r.error is None) for r in out.collect()], key=str)
    assert got == sorted([(1, 0, 2, True), (1, 1, 3, True)] * 2 + [(6, 0, 2, True), (6, 1, 3, True)] + [(i, None, None, False) for i in (2, 3, 4, 5, None)], key=str)
    assert tiff.read_pages(df.limit(0)).count() == 0


def tag(data, number, value):
    """The file with another value for a tag of its first directory."""
    order, _ = tiff.directories(data)
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = bytearray(data)
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from(order + "H", data, place)[0] == number:
            kind = struct.unpack_from(order + "H", data, place + 2)[0]
            struct.pack_into(order + ("H" if kind == 3 else "I"), out, place + 8, value)
    return bytes(out)


def test_files_that_claim_too_much_or_nothing(spark):
    plain = tiff.encode([np.ones((6, 4, 1), np.uint8)], tiff.RAW)
    tiled = tiff.encode([np.ones((6, 4, 1), np.uint8)], tiff.RAW, tile=(16, 16))
    extra = tiff.encode([np.ones((6, 4, 1), np.uint8)], tiff.RAW)
    bad = [tag(plain, t, v) for t, v in ((tiff.WIDTH, 0), (tiff.HEIGHT, 0), (tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES, 0), (tiff.BITS, 32), (tiff.PREDICTOR, 3), (tiff.COMPRESSION, 7), (tiff.WIDTH, 1 << 20), (tiff.STRIP_OFFSETS, 1 << 31), (tiff.STRIP_COUNTS, 3))]
    bad += [tag(tiled, t, 0) for t in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT)]
    bad += [tag(tag(plain, tiff.WIDTH, 1 << 20), tiff.HEIGHT, 1 << 22)]
    # the photometric tag, which the reader doesn't need, renamed
    at = extra.index(struct.pack("<HH", tiff.PHOTOMETRIC, 3))
    for t in (tiff.FILL_ORDER, tiff.SAMPLE_FORMAT):
        bad.append(extra[:at] + struct.pack("<HHIH", t, 3, 1, 3) + extra[at + 10 :])
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bad)] + [(-1, plain)], "media_in long, media binary")
    got = {r.media_in: (r.page, r.error) for r in tiff.read_pages(df.selectExpr("media_in", "media", "1 AS media_in_"), keep=["media_in", "media_in_"]).collect()}
    assert got.pop(-1) == (0, None)
    assert len(got) == len(bad) and all(page is None and error for page, error in got.values()), got


def test_broken_files_give_pages_or_an_error():
    rng = np.random.default_rng(8)
    pages = [rng.integers(0, 9, (9, 7, 1)).astype(np.uint8), rng.integers(0, 999, (5, 6, 3)).astype(np.uint16)]
    for method in (tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        for tile in (None, (16, 16)):
            good = tiff.encode(pages, method, 2, 4, tile)
            assert [r[0] for r in tiff.page_rows(good)] == [0, 1]
            for _ in range(300):
                data = bytearray(good)
                for _ in range(rng.integers(1, 6)):
                    data[rng.integers(len(data))] = rng.integers(256)
                rows = tiff.page_rows(bytes(data[: rng.integers(len(data)) + 1] if rng.random() < 0.3 else data))
                assert rows and all((r[0] is None) == (r[-1] is not None) for r in rows)


def test_little_data_cannot_claim_much_memory():
    bomb = zlib.compress(bytes(50 << 20))
    assert len(tiff.inflate(bomb, 100)) == 100
    assert tiff.packbits_decode(bytes([129, 7]) * 1000, 300) == bytes([7]) * 384
    assert 100 <= len(tiff.lzw_decode(tiff.lzw_encode(bytes(5000)), 100)) < 300


def test_large_pages_go_out_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(tiff, "OUT", 100)
    df = spark.createDataFrame([(k, "x" * 90) for k in range(20)], "text_in long, text string")
    stored = tiff.store_payloads(df.selectExpr("text_in", "text", "2 AS text_in_"))
    out = tiff.read_pages(stored, keep=["text_in", "text_in_"]).collect()
    assert sorted(r.text_in for r in out) == list(range(20)) and {len(r.pixels) for r in out} == {128}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op7_tiff(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_store_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "é" * 5000, 3), (3, "é" * 5000, 3)], "doc_id long, text string, n_bytes int")
    out = tiff.store_payloads(df, keep=["doc_id", "n_bytes"]).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in out) == [(1, 0), (2, 0), (3, 10_000), (3, 10_000)]
    assert len({bytes(r.media) for r in out}) == 2
    assert tiff.store_payloads(df.limit(0)).count() == 0
