import random
import struct
import zlib

import numpy as np
import pytest

from threadloom.llm import tiff


@pytest.mark.parametrize("coding", [tiff.STORED, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
def test_round_trip(coding, predictor, tile):
    rnd = random.Random(3)
    pages = [bytes(rnd.choice(b"ab\0\xff") for _ in range(64 * n)) for n in (1, 7, 100)] + [bytes(rnd.randrange(256) for _ in range(64 * 300))]
    found = list(tiff.read_pages(tiff.write_pages(pages, 64, coding, predictor, 32, tile)))
    assert [f[6] for f in found] == pages and [f[0] for f in found] == [0, 1, 2, 3]


def test_long_lzw_widths():
    rnd = random.Random(4)
    for n in (0, 1, 255, 4000, 70000):
        data = bytes(rnd.randrange(256) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


def test_unreadable():
    assert [f[0] for f in tiff.read_pages(None)] == [-1]
    assert next(tiff.read_pages(b"nonsense"))[7] == "no TIFF header"
    whole = tiff.write_pages([b"a" * 64], 64)
    assert all(f[7] for f in tiff.read_pages(whole[:40]))


def test_query_digests(spark):
    import hashlib

    texts = [None, "", "a", "é" * 40, "x" * 300, "long " * 30000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    out = {r.doc_id: r for r in tiff.pages(tiff.text_media(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert bytes(out[i].samples) == payload and out[i].n_bytes == len(raw) and out[i].error is None
    assert out[6].feature == out[7].feature
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()
    assert tiff.pages(tiff.text_media(docs.limit(0))).count() == 0


def test_known_code_streams():
    """The worked examples of the format's description and of the PackBits note, packed here by hand."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    plain = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_decode(stream, 100) == plain and tiff.lzw_encode(plain) == stream
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, 100) == plain and tiff.packbits_decode(tiff.packbits_encode(plain), 100) == plain


def build(order, big, fields, blocks):
    """A one-page file made apart from the module's writer: ``fields`` are (tag, type, values); offsets go to ``fields`` of None."""
    header = 16 if big else 8
    body, places = b"", []
    for b in blocks:
        places.append(header + len(body))
        body += b
    word, inline = ("Q", 8) if big else ("I", 4)
    sizes = {3: "H", 4: "I", 16: "Q"}
    entries, extra, at = b"", b"", header + len(body)
    start = at
    n = len(fields)
    after = start + (8 if big else 2) + n * (20 if big else 12) + inline
    for tag, kind, values in sorted(fields):
        values = places if values is None else values
        raw = struct.pack(f"{order}{len(values)}{sizes[kind]}", *values)
        if len(raw) > inline:
            raw, extra = struct.pack(order + word, after + len(extra)), extra + raw
        entries += struct.pack(order + "HH" + word, tag, kind, len(values)) + raw.ljust(inline, b"\0")
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    return head + body + struct.pack(order + ("Q" if big else "H"), n) + entries + b"\0" * inline + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("depth", [8, 16, 32, 64])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("planar", [1, 2])
def test_files_built_by_hand(order, big, depth, predictor, planar):
    rng = np.random.default_rng(depth)
    kind = np.dtype(f"u{depth // 8}").newbyteorder(order)
    image = rng.integers(0, 2**depth, (11, 7, 3), dtype=np.uint64).astype(kind)  # rows, columns, planes
    planes = [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(3)]
    blocks, counts = [], []
    for plane in planes:
        for y in range(0, 11, 4):
            part = plane[y : y + 4].astype(kind.newbyteorder("="))
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            blocks.append(zlib.compress(part.astype(kind).tobytes()))
            counts.append(len(blocks[-1]))
    long = 16 if big else 4
    fields = [(256, 3, [7]), (257, 3, [11]), (258, 3, [depth] * 3), (259, 3, [8]), (262, 3, [2]), (273, long, None), (277, 3, [3]), (278, 3, [4]), (279, long, counts), (284, 3, [planar]), (317, 3, [predictor])]
    (found,) = tiff.read_pages(build(order, big, fields, blocks))
    want = image.tobytes() if planar == 1 else b"".join(np.ascontiguousarray(p).tobytes() for p in planes)
    assert found[7] is None and found[:6] == (0, 7, 11, 3, depth, 8) and found[6] == want


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("depth", [16, 32, 64])
def test_floating_point_predictor(order, depth):
    kind = np.dtype(f"f{depth // 8}")
    image = np.random.default_rng(1).normal(size=(5, 9)).astype(kind)
    rows = b""
    for row in image:
        # bytes of one significance together, most significant first, then differences
        split = np.frombuffer(row.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(9, -1).T.reshape(-1)
        rows += np.diff(split, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    fields = [(256, 3, [9]), (257, 3, [5]), (258, 3, [depth]), (259, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 3, [5]), (279, 4, [len(rows)]), (317, 3, [3]), (339, 3, [3])]
    (found,) = tiff.read_pages(build(order, False, fields, [rows]))
    assert found[7] is None and found[6] == image.astype(kind.newbyteorder(order)).tobytes()


def test_hostile_files():
    far = b"II" + struct.pack("<HHHQ", 43, 8, 0, 1 << 63)
    assert [(f[0], f[6]) for f in tiff.read_pages(far)] == [(-1, None)]
    bomb = zlib.compress(bytes(1 << 26), 9)
    fields = [(256, 3, [8]), (257, 3, [8]), (258, 3, [8]), (259, 3, [8]), (273, 4, None), (277, 3, [1]), (278, 3, [8]), (279, 4, [len(bomb)])]
    (found,) = tiff.read_pages(build("<", False, fields, [bomb]))
    assert found[6] == bytes(64)
    wide = [(256, 4, [1 << 31]), (257, 4, [1 << 31]), *fields[2:]]
    (found,) = tiff.read_pages(build("<", False, wide, [bomb]))
    assert found[6] is None and found[7]
    rnd, whole = random.Random(1), tiff.write_pages([bytes(640)], 64, tiff.LZW)
    for _ in range(300):
        broken = bytearray(whole)
        for _ in range(3):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        list(tiff.read_pages(bytes(broken)))


def test_unknown_predictors_fill_orders_and_large_pages():
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
    samples = bytes(range(64))

    def one(*more, coding=8, fill=False):
        packed = zlib.compress(samples) if coding == 8 else samples
        packed = packed.translate(turned) if fill else packed
        fields = [(256, 3, [8]), (257, 3, [8]), (258, 3, [8]), (259, 3, [coding]), (273, 4, None), (277, 3, [1]), (278, 3, [8]), (279, 4, [len(packed)]), *more]
        return build("<", False, fields, [packed])

    for bad in ((317, 3, [7]), (317, 3, [0]), (266, 3, [3])):
        (found,) = tiff.read_pages(one(bad))
        assert found[0] == 0 and found[6] is None and "not supported" in found[7]
    for coding in (1, 8):
        (found,) = tiff.read_pages(one((266, 3, [2]), coding=coding, fill=True))
        assert found[6] == samples
    assert [[f[6] for f in tiff.read_pages(one(), size)] for size in (63, 64)] == [[None], [samples]]


def test_every_form_holds_every_size(spark):
    forms = set()
    for n in (0, 10, 63, 64, 65, 700, 5000, 70_000):
        for k in range(12):
            raw = (f"{k} " + "text é " * n)[:n]
            size, media = tiff.store_text(raw)
            (page,) = tiff.read_pages(media)
            assert page[6].rstrip(b"\0") == raw.encode() and size == len(raw.encode())
            forms.add(page[5])
    assert forms == {tiff.PACKBITS, tiff.LZW, tiff.DEFLATE}
    clash = spark.createDataFrame([(1, tiff.store_text("a")[1], "w", 5)], "page int, media binary, error string, key int")
    out = tiff.pages(clash)
    assert out.columns[:3] == ["in_page", "in_error", "key"] and out.first().in_error == "w"
