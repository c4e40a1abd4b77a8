import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgrove.llm import tiff


@pytest.mark.parametrize(("compression", "predictor", "tile", "order", "samples", "dtype"), itertools.product([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS], [1, 2], [0, 16], "<>", [1, 3], [np.uint8, np.uint16]))
def test_round_trip(compression, predictor, tile, order, samples, dtype):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 5 if k else 60000, (h, w, samples)).astype(dtype) for k, (h, w) in enumerate([(37, 29), (1, 1), (64, 16)])]
    got = list(tiff.decode_pages(tiff.encode(pages, compression, predictor, 10, tile, order)))
    assert [(p.height, p.width, p.samples) for p in got] == [p.shape for p in pages]
    assert [p.data for p in got] == [p.tobytes() for p in pages]


@given(st.binary(max_size=3000) | st.binary(max_size=40).map(lambda b: b * 200))
@settings(max_examples=60, deadline=None)
def test_coders(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_lzw_known():
    # 9-bit codes 256, 7, 258, 257, high bits first
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 257)).ljust(40, "0")
    assert tiff.lzw_decode(int(bits, 2).to_bytes(5, "big"), 3) == b"\7\7\7"


def test_lzw_long():
    data = np.random.default_rng(2).integers(0, 40, 60000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_pages_of_odd_files(spark):
    good = tiff.encode([np.zeros((2, 3), np.uint8), np.ones((1, 1), np.uint8)], tiff.PACKBITS)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\xff"), (5, good[: len(good) // 2]), (None, good)]
    df = spark.createDataFrame([(i, c, 9) for i, c in rows], "doc_id long, content binary, page int")
    got = tiff.tiff_pages(df).collect()
    assert sorted((r.doc_id or 0, r.page) for r in got if r.error is None) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert sorted((r.doc_id, r.page) for r in got if r.error is not None) == [(3, -1), (4, -1), (5, -1)]
    assert tiff.tiff_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("layout", sorted({*tiff.LAYOUTS, (tiff.NONE, 1, 0)}))
def test_damaged_files_give_errors_only(layout):
    """Bytes changed at random, fields set to zero and to large numbers: pages or a TiffError, never another exception."""
    compression, predictor, tile = layout
    rng = np.random.default_rng(3)
    good = tiff.encode([rng.integers(0, 9, (70, 40)).astype(np.uint8), np.ones((3, 3), np.uint8)], compression, predictor, 16, tile and 16)
    for k in range(1500):
        bad = bytearray(good)
        for _ in range(rng.integers(1, 4)):
            at = int(rng.integers(0, len(bad)))
            bad[at : at + 4] = [b"\0\0\0\0", b"\xff\xff\xff\xff", bytes([int(rng.integers(0, 256))])][k % 3]
        try:
            list(tiff.decode_pages(bytes(bad)))
        except tiff.TiffError:
            pass


def test_damaged_fields(spark):
    def with_field(tag, value, count=1):
        data = bytearray(tiff.encode([np.zeros((2, 3), np.uint8)], tiff.NONE, 1, 1, tile=16 if tag in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT) else 0))
        at = int.from_bytes(data[4:8], "little")
        for k in range(int.from_bytes(data[at : at + 2], "little")):
            e = at + 2 + 12 * k
            if int.from_bytes(data[e : e + 2], "little") == tag:
                data[e + 4 : e + 12] = count.to_bytes(4, "little") + value.to_bytes(4, "little")
        return bytes(data)

    fields = [(tiff.ROWS_PER_STRIP, 0), (tiff.TILE_WIDTH, 0), (tiff.TILE_HEIGHT, 0), (tiff.SAMPLES, 0), (tiff.WIDTH, 0), (tiff.WIDTH, 2**31), (tiff.HEIGHT, 2**32 - 1)]
    files = [with_field(t, v) for t, v in fields] + [with_field(tiff.STRIP_OFFSETS, 8, 0), with_field(tiff.BITS, 8, 0)]
    out = tiff.tiff_pages(spark.createDataFrame([(k, x) for k, x in enumerate(files)], "doc_id long, content binary")).collect()
    out = [r for r in out if r.doc_id <= len(fields)]  # without a value for the bits there is the default
    assert [r.page for r in out] == [-1] * (len(fields) + 1) and all(r.error for r in out)
    lzw = int("".join(f"{c:09b}" for c in (256, 300, 257)).ljust(32, "0"), 2).to_bytes(4, "big")
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(lzw, 3)


def brute(text):
    data = (text or "").encode()
    padded = data + b"\0" * ((-len(data)) % 64 if data else 64)
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


@pytest.mark.parametrize("name", ["documents", "odd_documents"])
def test_digest(request, name):
    docs = request.getfixturevalue(name)
    want = sorted(((r.doc_id is None, r.doc_id or 0), brute(r.text)) for r in docs.collect())
    rows = tiff.text_media_digest(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in rows) == want
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_many_pages_and_none(no_documents):
    kinds = set()
    for end in "abcdefghijklmnop":
        _, payload = tiff.payload_of("z" * (64 * tiff.PAGE_ROWS) + end)
        pages = list(tiff.decode_pages(tiff.store_payload(payload)))
        assert len(pages) == 2 and b"".join(p.data for p in pages) == payload
        kinds.add(pages[0].compression)
    assert len(kinds) > 1
    assert tiff.text_media_digest(no_documents).count() == 0
