"""Media columns, TIFF: one row per page (image directory) of each file in a binary column.

The reader walks the chain of image directories in either byte order, classic or big-offset files,
takes strips or tiles, decodes them (stored, PackBits, LZW, deflate), undoes horizontal and
floating-point predictors and assembles the samples of the page. The writer makes single- or many-page
files of 8-bit samples with any of these codings.

A null, empty or unreadable file gives one row with page -1, null samples and the reason in ``error``; a
page that can't be decoded gives its row with null samples and the reason. Directory chains that loop end
with a reason. A page of more than ``max_page_bytes`` (by default what a binary value of Spark can hold) is such a page; no block is
decoded beyond the bytes that its page needs. A small file can hold a large page: unpacking takes about three times the page's
bytes, so ``max_page_bytes`` is to be set by the worker's memory where files aren't trusted. Pages leave one at a time, so a
worker holds one file and one page of it. Predictors and fill orders that the format doesn't know are a reason too. No shuffle. Repeated rows give their pages again. Columns of the input
that are called like a page's come back as ``in_`` and their name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: bytes of each field type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
INTEGERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: The largest page that is unpacked; a worker needs about three times a page's bytes. Larger pages give an error row.
MAX_PAGE_BYTES = 1 << 31
PREDICTORS = (1, 2, 3)
#: Each byte with its bits in opposite order, for files of fill order 2.
_TURNED = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < limit:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out[:limit])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three equal bytes or more are packed, what lies between is literal."""
    out, at = bytearray(), 0

    def plain(end: int) -> None:
        for start in range(at, end, 128):
            piece = data[start : min(start + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in _RUN.finditer(data):
        plain(m.start())
        at = m.end()
        out.extend((257 - (m.end() - m.start()), data[m.start()]))
    plain(len(data))
    return bytes(out)


def lzw_decode(data: bytes, limit: int) -> bytes:
    """Most significant bit first, early change of code width, 256 clears, 257 ends."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, before, size = list(first), 9, 0, 0, b"", 0
    out = []
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or size >= limit:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:limit]


def lzw_encode(data: bytes) -> bytes:
    """Longer strings are known by the code of what they extend and the byte that they add."""
    out, held, bits = bytearray(), 256, 9
    table: dict[int, int] = {}
    width, size, code = 9, 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = code << 8 | byte
        known = table.get(longer)
        if known is not None:
            code = known
            continue
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
        table[longer] = size
        size += 1
        if size + 1 > 1 << width:
            width += 1
        if size >= 4093:
            held, bits = held << width | 256, bits + width
            table, width, size = {}, 9, 258
        code = byte
    if code >= 0:
        held, bits = held << width | code, bits + width
        if size + 2 > 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    return bytes(out) + (held << -bits % 8).to_bytes(-(-bits // 8))


def _inflate(data: bytes, limit: int) -> bytes:
    return zlib.decompressobj().decompress(data, limit)


_DECODERS = {STORED: lambda data, limit: data[:limit], PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
_ENCODERS = {STORED: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6)}
_BAD = (ValueError, IndexError, KeyError, TypeError, OverflowError, MemoryError, struct.error, zlib.error)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF header")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories loop")
        seen.add(at)
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            place, room = (at + 12, 8) if big else (at + 8, 4)
            if TYPE_BYTES.get(kind, 1) * count > room:
                place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
            if kind in INTEGERS:
                if count > len(data):
                    raise ValueError("field longer than the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{INTEGERS[kind]}", data, place)
            at += 20 if big else 12
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
        yield order, tags


def _unpredict(block: np.ndarray, predictor: int, depth: int, order: str, planes: int) -> np.ndarray:
    """``block``: rows of bytes. Gives rows of bytes in the file's byte order (predictor 3: big-endian)."""
    rows, size = block.shape[0], depth // 8
    if predictor == 2:
        kind = np.dtype({8: "u1", 16: "u2", 32: "u4", 64: "u8"}[depth]).newbyteorder(order)
        values = block.reshape(rows, -1).view(kind).reshape(rows, -1, planes)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(rows, -1).view(np.uint8)
    if predictor == 3:
        sums = np.cumsum(block.reshape(rows, -1, planes), axis=1, dtype=np.uint8).reshape(rows, size, -1)
        parts = sums.transpose(0, 2, 1)
        return np.ascontiguousarray(parts if order == ">" else parts[:, :, ::-1]).reshape(rows, -1)
    return block


def _page(data: bytes, order: str, tags: dict[int, tuple], max_page_bytes: int) -> tuple[int, int, int, int, int, bytes]:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height = one(256, 0), one(257, 0)
    planes, coding, predictor, separate = one(277, 1), one(259, 1), one(317, 1), one(284, 1) == 2
    depths = set(tags.get(258, (1,)))
    if len(depths) != 1 or (depth := depths.pop()) not in (8, 16, 32, 64):
        raise ValueError("bits per sample not supported")
    if coding not in _DECODERS:
        raise ValueError(f"compression {coding} not supported")
    if predictor not in PREDICTORS:
        raise ValueError(f"predictor {predictor} not supported")
    if (fill := one(266, 1)) not in (1, 2):
        raise ValueError(f"fill order {fill} not supported")
    if not width or not height or width * height * planes * depth // 8 > max_page_bytes:
        raise ValueError("page size")
    size, inner, outer = depth // 8, 1 if separate else planes, planes if separate else 1
    if 322 in tags:
        across, down, offsets, counts = one(322, 0), one(323, 0), tags[324], tags[325]
    else:
        across, down, offsets, counts = width, min(one(278, height), height), tags.get(273, ()), tags.get(279, ())
    if not across or not down:
        raise ValueError("block size")
    tiles = 322 in tags
    per_row, per_col = -(-width // across), -(-height // down)
    if min(len(offsets), len(counts)) < per_row * per_col * outer:
        raise ValueError("blocks missing")
    pixel = inner * size
    image = np.empty((outer, height, width * pixel), np.uint8)
    for k in range(per_row * per_col * outer):
        plane, rest = divmod(k, per_row * per_col)
        y, x = rest // per_row * down, rest % per_row * across
        rows = down if tiles else min(down, height - y)
        need = rows * across * pixel
        if need > max_page_bytes:
            raise ValueError("block size")
        packed = data[offsets[k] : offsets[k] + counts[k]]
        raw = _DECODERS[coding](packed.translate(_TURNED) if fill == 2 else packed, need)
        if len(raw) < need:
            raise ValueError("block too short")
        block = np.frombuffer(raw, np.uint8, need).reshape(rows, across * pixel)
        block = _unpredict(block, predictor, depth, order, inner)
        h, w = min(rows, height - y), min(across, width - x)
        image[plane, y : y + h, x * pixel : (x + w) * pixel] = block[:h, : w * pixel]
    return width, height, planes, depth, coding, image.tobytes()


def read_pages(data: bytes | None, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[tuple]:
    """(page, width, height, planes, bits, compression, samples, error) of each directory in file order.

    A page of more than ``max_page_bytes``, or of another predictor or fill order than the format knows, is an error row.
    """
    page = -1
    try:
        if not data:
            raise ValueError("no data")
        for page, (order, tags) in enumerate(_directories(bytes(data))):
            try:
                yield (page, *_page(data, order, tags, max_page_bytes), None)
            except _BAD as e:
                yield page, None, None, None, None, None, None, str(e) or type(e).__name__
    except _BAD as e:
        yield (-1 if page < 0 else page + 1), None, None, None, None, None, None, str(e) or type(e).__name__


def write_pages(pages: Sequence[bytes], width: int, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file with one page of 8-bit grey samples, ``width`` a row, for each of ``pages``."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for samples in pages:
        image = np.frombuffer(samples, np.uint8).reshape(-1, width)
        height = image.shape[0]
        if tile:
            across, down = tile
            full = np.zeros((-(-height // down) * down, -(-width // across) * across), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + down, x : x + across] for y in range(0, full.shape[0], down) for x in range(0, full.shape[1], across)]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1), np.uint8))
            coded = _ENCODERS[compression](block.tobytes())
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows_per_strip]), (279, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{INTEGERS[kind]}", *values)
            if len(packed) > 4:
                place = struct.pack("<I", len(out))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                place = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, planes int, bits int, compression int, samples binary, error string, feature string"


def feature_of(width: int, height: int, samples: bytes) -> str:
    """Size, mean times 1000 (whole), distinct values and the most frequent one (least among equals)."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    mean = int((counts * np.arange(256)).sum()) * 1000 // max(1, len(samples))
    return f"{width}x{height} mean={mean} values={int((counts > 0).sum())} mode={int(counts.argmax())}"


def pages(media: DataFrame, column: str = "media", max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """One row per page: every other column of ``media``, then those of ``PAGE_SCHEMA``. Pages above ``max_page_bytes`` are error rows."""
    own = {part.split()[0] for part in PAGE_SCHEMA.split(", ")}
    others = [f for f in media.schema.fields if f.name != column]

    def run(rows):
        for *keys, data in rows:
            for page, width, height, planes, bits, coding, samples, error in read_pages(data, max_page_bytes):
                yield (*keys, page, width, height, planes, bits, coding, samples, error, feature_of(width, height, samples) if samples is not None else None)

    kept = "".join(f"`{'in_' if f.name in own else ''}{f.name}` {f.dataType.simpleString()}, " for f in others)
    return map_rows(media.select(*[F.col(f"`{f.name}`") for f in others], column), run, kept + PAGE_SCHEMA)


ROW = 64
#: How texts are stored, by turns: coding, predictor, whether in tiles.
FORMS = [(coding, predictor, tiled) for coding in (PACKBITS, LZW, DEFLATE) for predictor in (1, 2) for tiled in (False, True)]


def store_text(text: str | None) -> tuple[int, bytes]:
    """(bytes, file): the text as UTF-8, zero-padded to a positive multiple of 64, as 64 samples a row.

    The form is one of ``FORMS``, picked by the payload's CRC, so equal texts are stored alike and every form gets texts of all
    sizes. Tiles are 32 samples wide and a quarter of the page high.
    """
    raw = (text or "").encode("utf-8")
    payload = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")
    coding, predictor, tiled = FORMS[zlib.crc32(payload) % len(FORMS)]
    return len(raw), write_pages([payload], ROW, coding, predictor, tile=(32, -(-len(payload) // ROW // 64) * 16 or 16) if tiled else None)


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a one-page file."""

    def run(rows):
        for key, body in rows:
            yield (key, *store_text(body))

    return map_rows(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, media binary")


def op2_tiff(spark, sf_dir: str) -> DataFrame:
    """Stores each text as a file, reads its page back and digests both."""
    from .common import tables

    stored = text_media(tables(spark, sf_dir, "documents"))
    stored = stored.select("*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return pages(stored).select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
