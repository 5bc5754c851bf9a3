"""TIFF: image directories, PackBits, LZW and deflate, strips and tiles, predictors; one row per page.

The reader follows the chain of image directories (either byte order), decodes every strip or tile, undoes horizontal
differencing and gives samples row by row: one byte each for 1, 2, 4 or 8 bits, two bytes, little-endian, for 16 bits.
Floating-point samples and their predictor are not read. The writer stores any payload as RGB pages; which of the layouts
below it takes depends on the payload alone, so equal texts give equal files and all parts of the reader are used.

Defined cases: null media give no page row; a page that cannot be read gives a row with `error` set and no pixels, and the
pages before and after it stand; where a directory cannot be read, a row with `error` set ends the file; a null or empty
text is stored as one row of 192 spaces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
#: Rows of a page and of a strip.
PAGE_ROWS, STRIP_ROWS = 512, 64
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Layouts: compression, predictor, tiled; each compression has the same share.
LAYOUTS = [(DEFLATE, 2, False), (PACKBITS, 1, False), (LZW, 2, False), (DEFLATE, 1, True), (PACKBITS, 2, True), (LZW, 1, True)]
#: Bytes of a decoded page that are believed; more is taken for a broken file.
MOST_BYTES = 1 << 30
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_RUNS = re.compile(rb"(.)\1{2,127}|(?:(?!(.)\2\2).){1,128}", re.S)


def packbits(data: bytes) -> bytes:
    out = bytearray()
    for m in _RUNS.finditer(data):
        own = m.group()
        out += bytes((257 - len(own), own[0])) if m.group(1) else bytes((len(own) - 1,)) + own
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, whatever they are: each adds one entry to the table."""
    size = 258 + np.arange(n)
    return 9 + (size >= 512) + (size >= 1024) + (size >= 2048)


def lzw(data: bytes) -> bytes:
    codes, starts, table, following = [256], [0], {}, 258
    if data:
        code = data[0]
        for byte in data[1:]:
            longer = table.get(code << 8 | byte)
            if longer is not None:
                code = longer
                continue
            codes.append(code)
            table[code << 8 | byte] = following
            following += 1
            if following == 4095:
                starts.append(len(codes))
                codes.append(256)
                table, following = {}, 258
            code = byte
        codes.append(code)
    codes.append(257)
    since = np.diff([*starts, len(codes) - 1])  # a clear code has the width that its forerunners lead to
    widths = np.concatenate([[9], *map(_widths, since)])
    bits = (np.array(codes)[:, None] >> np.arange(11, -1, -1)).astype(np.uint8) & 1
    return np.packbits(bits[np.arange(12) >= 12 - widths[:, None]]).tobytes()


def unlzw(data: bytes) -> bytes:
    base, out, at = [bytes((i,)) for i in range(256)] + [b"", b""], [], 0
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    last, table = b"", list(base)
    while at + 9 <= 8 * len(data):
        # as many codes as there can be up to the next clear code
        widths = _widths(4096)
        ends = at + np.cumsum(widths)
        widths = widths[: int(np.searchsorted(ends, 8 * len(data), "right"))]
        ends = ends[: len(widths)]
        byte, shift = (ends - widths) >> 3, ((ends - widths) & 7).astype(np.uint32)
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - shift - widths.astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        for code in codes[:n].tolist():
            if not last:
                last = base[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code out of range")
                word = table[code] if code < len(table) else last + last[:1]
                table.append(last + word[:1])
                last = word
            out.append(last)
        if len(stop) and codes[n] == 256:
            last, table = b"", list(base)
        elif len(stop) or n < 4096:
            break
        else:
            raise ValueError("LZW table is full")
        at = int(ends[n])
    return b"".join(out)


def _compressed(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw, PACKBITS: packbits}.get(how, lambda d: zlib.compress(d, 2))(data)


def _plain(data: bytes, how: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == LZW:
        return unlzw(data)
    if how == PACKBITS:
        return unpackbits(data)
    if how == NONE:
        return data
    raise ValueError(f"compression {how}")


def write_tiff(payload: bytes, layout: int | None = None) -> bytes:
    """A little-endian TIFF with one page per PAGE_ROWS rows. len(payload) must be a positive multiple of ROW."""
    if not payload or len(payload) % ROW:
        raise ValueError("a positive multiple of a row is needed")
    k = zlib.crc32(payload) % len(LAYOUTS) if layout is None else layout
    how, predictor, tiled = LAYOUTS[k]
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(pixels), PAGE_ROWS):
        page = pixels[top : top + PAGE_ROWS]
        offsets, counts = [], []
        for at in range(0, len(page), STRIP_ROWS):
            part = page[at : at + STRIP_ROWS]
            if tiled and len(part) < STRIP_ROWS:
                part = np.concatenate([part, np.zeros((STRIP_ROWS - len(part), WIDTH, SAMPLES), np.uint8)])
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            data = _compressed(part.tobytes(), how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        rows = len(page)
        tags = [(256, 4, [WIDTH]), (257, 4, [rows]), (258, 3, [8] * SAMPLES), (259, 3, [how]), (262, 3, [2]), (277, 3, [SAMPLES]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 3, [WIDTH]), (323, 3, [STRIP_ROWS]), (324, 4, offsets), (325, 4, counts)] if tiled else [(273, 4, offsets), (278, 4, [STRIP_ROWS]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, place = struct.pack("<I", len(out)), data
                out += place
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(media: bytes) -> Iterator[dict]:
    """The tags of every image directory, as tuples of numbers."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if not order or struct.unpack_from(f"{order}H", media, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, seen = struct.unpack_from(f"{order}I", media, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        tags = {0: (order,)}
        (n,) = struct.unpack_from(f"{order}H", media, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", media, at + 2 + 12 * i)
            if kind in (1, 3, 4):
                letter, place = {1: "B", 3: "H", 4: "I"}[kind], at + 10 + 12 * i
                if count * _SIZE[kind] > 4:
                    (place,) = struct.unpack_from(f"{order}I", media, place)
                if count * _SIZE[kind] > len(media) - place:
                    raise ValueError("a tag reaches beyond the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", media, place)
        yield tags
        (at,) = struct.unpack_from(f"{order}I", media, at + 2 + 12 * n)


def read_tiff(media: bytes) -> Iterator[dict]:
    """Every page: width, height, samples, bits, compression, and its pixels as bytes, row by row."""
    for tags in directories(media):
        yield _page(media, tags)


def _samples(data: bytes, bits: int, order: str, rows: int, across: int) -> np.ndarray:
    """rows x across samples; a row of fewer than 8 bits a sample ends with its last byte."""
    if bits == 16:
        return np.frombuffer(data, f"{order}u2")[: rows * across].reshape(rows, across).astype("<u2")
    if bits == 8:
        return np.frombuffer(data, np.uint8)[: rows * across].reshape(rows, across)
    each = np.unpackbits(np.frombuffer(data, np.uint8)[: rows * -(-across * bits // 8)].reshape(rows, -1), axis=1)[:, : across * bits]
    return (each.reshape(rows, across, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def _page(media: bytes, tags: dict) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, how, predictor, planar = tags[256][0], tags[257][0], one(277, 1), one(259, 1), one(317, 1), one(284, 1)
    bits = set(tags.get(258, (1,)))
    if len(bits) > 1 or not bits <= {1, 2, 4, 8, 16} or one(339, 1) != 1 or predictor not in (1, 2):
        raise ValueError("whole numbers of 1, 2, 4, 8 or 16 bits and predictor 1 or 2 are read")
    (bits,) = bits
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if not 0 < width * height * samples * (1 + bits // 16) <= MOST_BYTES:
        raise ValueError(f"{width} x {height} pixels of {samples} samples")
    kind = np.dtype("<u2" if bits == 16 else np.uint8)
    image = np.zeros((planes, height, width, each), kind)
    tiled = 324 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if w < 1 or h < 1 or w * h * each > MOST_BYTES:
        raise ValueError(f"strips or tiles of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    for k, (start, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, part = divmod(k, across * down)
        y, x = part // across * h, part % across * w
        rows = h if tiled else min(h, height - y)
        block = _samples(_plain(media[start : start + size], how), bits, tags[0][0], rows, w * each).reshape(rows, w, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind) & kind.type((1 << bits) - 1)
        image[plane, y : y + h, x : x + w] = block[: height - y, : width - x]
    pixels = image[0] if planar == 1 else np.moveaxis(image[..., 0], 0, -1)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "pixels": pixels.tobytes()}


#: What a broken file can raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def pages_of(media: bytes) -> Iterator[tuple[dict | None, str | None]]:
    """Every page, or why it cannot be read."""
    found = directories(media)
    while True:
        try:
            tags = next(found, None)
            if tags is None:
                return
        except BROKEN as e:
            yield None, f"{type(e).__name__}: {e}"
            return
        try:
            page = _page(media, tags)
        except BROKEN as e:
            yield None, f"{type(e).__name__}: {e}"
        else:
            yield page, None


def store_as_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the UTF-8 text, media: the text, padded with spaces to whole rows, as a TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = [t.encode() for t in part.column(1).to_pylist()]
            media = [write_tiff(t.ljust(max(1, -(-len(t) // ROW)) * ROW)) for t in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string, n_bytes long, media_bytes long, media_sha256 string"


def pages(media: DataFrame) -> DataFrame:
    """One row per page of each media row, in order and side by side; n_bytes and the stored form's size and hash on the first page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, n, own in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                if own is None:
                    continue
                about = (n, len(own), hashlib.sha256(own).hexdigest())
                for i, (page, error) in enumerate(pages_of(own)):
                    about_page = [page[c] for c in ("width", "height", "samples", "bits", "compression", "pixels")] if page else [None] * 6
                    rows.append((doc, i, *about_page, error, *(about if not i else (None, None, None))))
            if rows:
                kinds = (pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])

    return media.mapInArrow(run, PAGES)


def features(pixels: np.ndarray) -> str:
    """Channel means in thousandths, a 16-bin histogram in thousandths, and a 64-bit gradient hash, all whole numbers."""
    means = pixels.reshape(-1, SAMPLES).sum(axis=0, dtype=np.int64) * 1000 // (len(pixels) // SAMPLES)
    bins = np.bincount(pixels >> 4, minlength=16) * 1000 // len(pixels)
    cells = np.array([int(c.sum()) * 1000 // max(1, len(c)) for c in np.array_split(pixels, 65)])
    bits = int.from_bytes(np.packbits(np.diff(cells) > 0).tobytes(), "big")
    return f"mean={','.join(map(str, means.tolist()))};hist={','.join(map(str, bins.tolist()))};grad={bits:016x}"


def describe(page_rows: DataFrame) -> DataFrame:
    """One row per document from its page rows, which stand side by side: hashes of the pixels read back, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())

    def row(doc, n, size, sha, own: list[bytes]) -> tuple:
        data = b"".join(own)
        return doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), size, sha, features(np.frombuffer(data, np.uint8)) if data else "", len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, []
        for part in slices(batches):
            done = []
            for doc, page, pixels, n, size, sha in zip(*(part.column(c).to_pylist() for c in ("doc_id", "page", "pixels", "n_bytes", "media_bytes", "media_sha256")), strict=True):
                if page == 0:
                    if head:
                        done.append(row(*head, own))
                    head, own = (doc, n, size, sha), []
                own.append(pixels or b"")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(*head, own), kinds, strict=True)], names=names)

    return page_rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
