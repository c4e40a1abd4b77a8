"""Media columns: TIFF pages.

``decode_pages`` walks the image directories of a file, decodes strips or tiles (none, LZW, deflate, PackBits),
undoes predictors and gives one page per directory. ``tiff_pages`` is the operator: one row per page.

Defined results: a null file has no rows; an empty or damaged one gives one row with page -1 and the error;
repeated rows each give their own pages; other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.common import id_text, map_batches, texts_of

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
ADOBE_DEFLATE = 32946
# Fixed values of the TIFF 6.0 format: tag numbers and byte sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 16: "Q"}


#: No compression here makes more of a byte.
LARGEST_GROWTH = 4096


class TiffError(ValueError):
    """The file isn't a TIFF that can be decoded."""


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    data: bytes  # rows from the top, samples interleaved, in the machine's byte order


# ---- decoding -----------------------------------------------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early, as the format wants it."""
    out = bytearray()
    table: list[bytes] = []
    last, width, acc, have = b"", 9, 0, 0
    for byte in data:
        acc, have = (acc << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have & ((1 << width) - 1)
        if code == 256:
            table, last, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if code == 257 or len(out) >= size:
            break
        if not table:
            raise TiffError("LZW data doesn't begin with a clear code")
        if not last:
            if code > 255:
                raise TiffError("LZW code out of range")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            table.append(last + entry[:1])
            width = min(12, (len(table) + 1).bit_length())
        out += entry
        last = entry
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, ADOBE_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise TiffError(f"compression {compression} isn't supported")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def undo_predictor(block: np.ndarray, predictor: int, raw: bytes, order: str) -> np.ndarray:
    """block: rows x pixels x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.add.accumulate(block, axis=1, dtype=block.dtype)
    if predictor == 3:  # bytes of a row's floats, split by significance and differenced
        rows, pixels, samples = block.shape
        size = block.dtype.itemsize
        planes = np.add.accumulate(np.frombuffer(raw, np.uint8).reshape(rows, size * pixels, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, pixels * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">u{size}").reshape(rows, pixels, samples).astype(f"u{size}")
    raise TiffError(f"predictor {predictor} isn't supported")


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    head, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    (count,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize("=" + head)
    if count * entry > len(data):
        raise TiffError("a directory is longer than its file")
    tags = {}
    inline = 8 if big else 4
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HH" + word, data, at + k * entry)
        if kind not in FIELD_TYPES:
            continue
        size = n * struct.calcsize("=" + FIELD_TYPES[kind])
        if size > len(data):
            raise TiffError("a field is longer than its file")
        where = at + k * entry + 4 + inline
        if size > inline:
            (where,) = struct.unpack_from(order + word, data, where)
        tags[tag] = struct.unpack_from(f"{order}{n}{FIELD_TYPES[kind]}", data, where)
    (following,) = struct.unpack_from(order + word, data, at + count * entry)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(width, height, samples) <= 0 or len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("no size, or samples of unlike sizes")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or bits < 8 and (samples > 1 or predictor > 1):
        raise TiffError(f"{bits} bits a sample aren't supported here")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = (tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()))
    planes = samples if one(PLANAR, 1) == 2 else 1
    inner = samples // planes
    if min(tw, th) <= 0:
        raise TiffError("strips or tiles without a size")
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) != len(counts) or len(offsets) < across * down * planes or min(offsets, default=0) < 0 or min(counts, default=0) < 0:
        raise TiffError("strips or tiles are missing")
    dtype = np.dtype(f"u{bits // 8}") if bits >= 8 else np.dtype("u1")
    row = tw * inner if bits >= 8 else -(-tw * bits // 8)  # in units of dtype
    if bits < 8 and across > 1 and tw * bits % 8:
        raise TiffError("tiles that share a byte")
    whole_row = width if bits >= 8 else -(-width * bits // 8)
    if height * whole_row * samples * dtype.itemsize > LARGEST_GROWTH * sum(counts) or th * row * dtype.itemsize > LARGEST_GROWTH * max(counts):
        raise TiffError("larger than what its strips or tiles can hold")
    parts: list[bytes] = []
    image = None if not tiled and planes == 1 else np.zeros((height, whole_row, samples if bits >= 8 else 1), dtype)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        rows = th if tiled else min(th, height - y * th)
        if offsets[k] + counts[k] > len(data):
            raise TiffError("a strip or tile lies outside its file")
        raw = expand(data[offsets[k] : offsets[k] + counts[k]], compression, rows * row * dtype.itemsize)
        block = np.frombuffer(raw, dtype.newbyteorder(order)).astype(dtype, copy=False)
        block = undo_predictor(block.reshape(rows, -1, inner if bits >= 8 else 1), predictor, raw, order)
        if image is None:
            parts.append(block.tobytes())
            continue
        step = block.shape[1]
        into = image[y * th : y * th + rows, x * step : (x + 1) * step, plane * inner : (plane + 1) * inner if bits >= 8 else 1]
        into[:] = block[: into.shape[0], : into.shape[1]]
    return Page(width, height, samples, bits, compression, predictor, b"".join(parts) if image is None else image.tobytes())


def decode_pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if order is None:
            raise TiffError("no TIFF byte-order mark")
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic not in (42, 43):
            raise TiffError("no TIFF magic number")
        (at,) = struct.unpack_from(order + ("Q" if magic == 43 else "I"), data, 8 if magic == 43 else 4)
        seen = set()
        while at:
            if at in seen:
                raise TiffError("directories in a circle")
            seen.add(at)
            tags, at = _directory(data, at, order, magic == 43)
            yield _page(data, tags, order)
    except TiffError:
        raise
    except (struct.error, ValueError, IndexError, ArithmeticError, MemoryError) as e:
        raise TiffError(f"damaged: {e}") from e


# ---- encoding -----------------------------------------------------------------------------------------------------


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """A clear code, the codes and the end code; a word is known by its code, so the table maps (code, byte) to codes."""
    out, acc, have, width = bytearray(), 256, 9, 9
    table: dict[int, int] = {}
    following, code = 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = code << 8 | byte
        if (known := table.get(longer)) is not None:
            code = known
            continue
        acc, have = acc << width | code, have + width
        table[longer] = following
        following += 1
        width = min(12, following.bit_length())
        if following == 4094:
            acc, have = acc << width | 256, have + width
            table, width, following = {}, 9, 258
        if have >= 512:
            have, rest = have & 7, have >> 3
            out += (acc >> have).to_bytes(rest, "big")
            acc &= (1 << have) - 1
        code = byte
    if code >= 0:
        acc, have = acc << width | code, have + width
        following += 1
        width = min(12, following.bit_length())
    acc, have = acc << width | 257, have + width
    return bytes(out) + (acc << -have % 8).to_bytes(-(-have // 8), "big")


def compress(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits}[compression](data)


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """Grey or interleaved pages (height x width or height x width x samples) as a TIFF of strips, or of square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for page in pages:
        pixels = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = pixels.shape
        th, tw = (tile, tile) if tile else (min(rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = pixels[y : y + th, x : x + tw]
                if tile and block.shape[:2] != (th, tw):
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                coded = compress(block.astype(block.dtype.newbyteorder(order)).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(coded))
                out += coded
        if len(out) % 2:
            out.append(0)
        fields = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [pixels.dtype.itemsize * 8] * samples), COMPRESSION: (3, [compression]),
            PHOTOMETRIC: (3, [1]), SAMPLES: (3, [samples]), PREDICTOR: (3, [predictor]),
        }
        fields |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [th]), STRIP_COUNTS: (4, counts)}
        at = len(out)
        struct.pack_into(order + "I", out, link, at)
        extra, rest = at + 6 + 12 * len(fields), b""
        entries = struct.pack(order + "H", len(fields))
        for tag, (kind, values) in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}{FIELD_TYPES[kind]}", *values)
            if len(packed) > 4:
                packed, rest = struct.pack(order + "I", extra + len(rest)), rest + packed
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        link = at + len(entries)
        out += entries + b"\0\0\0\0" + rest
        if len(out) % 2:
            out.append(0)
    return bytes(out)


# ---- operators ----------------------------------------------------------------------------------------------------

PAGES = "doc_id long, page int, width long, height long, samples int, bits int, compression int, predictor int, data binary, error string"


def tiff_pages(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """One row per page of each TIFF in content_col. See the module's text for nulls and damage."""

    def run(batch):
        for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if data is None:
                continue
            page, error = -1, ""
            try:
                for page, p in enumerate(decode_pages(data)):
                    yield {"doc_id": [key], "page": [page], "width": [p.width], "height": [p.height], "samples": [p.samples], "bits": [p.bits], "compression": [p.compression], "predictor": [p.predictor], "data": [p.data], "error": [None]}
            except TiffError as e:
                error = str(e)
            if error:
                yield {"doc_id": [key], "page": [-1], "error": [error]} | {k: [None] for k in ("width", "height", "samples", "bits", "compression", "predictor", "data")}

    return map_batches(files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content")), run, PAGES)


PAYLOAD_WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 65536, 1024


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    return n, data + b"\0" * (-n % 64 if n else 64)


#: How payloads are stored: compression, predictor and side of tiles (0: strips). A text's checksum picks one; the codecs that
#: run byte by byte here have a share of one in sixteen each.
LAYOUTS = [(LZW, 2, 0), (PACKBITS, 1, 64), *[(DEFLATE, 1, 64), (DEFLATE, 2, 0)] * 7]


def store_payload(payload: bytes) -> bytes:
    """Grey pages of 64 samples a row, of 65,536 rows at most, in one of LAYOUTS."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)
    compression, predictor, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    return encode([rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)], compression, predictor, STRIP_ROWS, tile)


def features(pages: list[Page], samples: np.ndarray) -> str:
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    steps = np.abs(np.diff(samples.astype(np.int16))).mean() if len(samples) > 1 else 0.0
    return f"pages={len(pages)};w={pages[0].width};h={sum(x.height for x in pages)};mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(p * np.log2(p)).sum() + 0:.4f};step={steps:.4f};levels={len(p)}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Each text as a TIFF, decoded again; one row per document. A null text is an empty one: 64 zero bytes.

    The stored form goes through all codecs, strips and tiles, as the text's checksum has it. Of one document at a time the
    payload, the file and the decoded pages are in memory.
    """

    def run(batch):
        out = {k.split()[0]: [] for k in DIGEST.split(", ")}
        for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            n, payload = payload_of(text)
            media = store_payload(payload)
            pages = list(decode_pages(media))
            back = b"".join(p.data for p in pages)
            row = (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(pages, np.frombuffer(back, np.uint8)), len(pages))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        yield out

    return map_batches(id_text(docs), run, DIGEST)
