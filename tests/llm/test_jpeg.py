import hashlib
import zlib

import numpy as np
import pytest

from chronoweave.llm import jpeg


def payloads():
    rng = np.random.default_rng(1)
    yield from (rng.integers(0, 256, jpeg.ROW * n, np.uint8).tobytes() for n in (1, 2, 7, 40))
    yield b"\xff" * jpeg.ROW * 3
    yield b"\x00" * jpeg.ROW
    yield b"\x00\xff" * (jpeg.ROW // 2) * 9


def test_payloads_come_back():
    files = [jpeg.write_jpeg(p) for p in payloads()]
    back = [b"".join(im.thumb.tobytes() for im in x) for x in jpeg.read_jpegs(files)]
    assert back == list(payloads())
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)


def test_more_rows_than_one_image_holds(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 5)
    p = bytes(range(256)) * 9 * 3  # 12 rows
    p = p[: jpeg.ROW * 12]
    images = jpeg.read_jpegs([jpeg.write_jpeg(p)])[0]
    assert [im.height for im in images] == [40, 40, 16] and b"".join(im.thumb.tobytes() for im in images) == p


def test_bad_files():
    for bad in (b"", b"abc"):
        with pytest.raises(ValueError):
            jpeg.write_jpeg(bad)
    good = jpeg.write_jpeg(b"\x01" * jpeg.ROW)
    for bad in (b"PNG" + good, good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-2]):
        with pytest.raises(ValueError):
            jpeg.read_jpegs([bad])


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, code, n):
        self.s += format(code, f"0{n}b") if n else ""

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def test_any_baseline_image():
    """Colour with 2x2 luminance, AC coefficients, no restart markers: DC values against those put in."""
    rng = np.random.default_rng(2)
    dc_bits, dc_values = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12))
    symbols = [0x00, 0x01, 0x02, 0x11, 0x23, 0xF0]
    ac_bits, ac_values = bytes([0, 2, 1, 1, 1, 1] + [0] * 10), bytes(symbols)
    dc = {v: (c, n) for v, c, n in jpeg.huffman(dc_bits, dc_values)}
    ac = {v: (c, n) for v, c, n in jpeg.huffman(ac_bits, ac_values)}
    bits, pred, luma = Bits(), [0, 0, 0], {}

    def number(v):
        n = abs(int(v)).bit_length()
        return (int(v) if v >= 0 else int(v) + (1 << n) - 1), n

    for my in range(2):
        for mx in range(3):
            for comp, count in ((0, 4), (1, 1), (2, 1)):
                for b in range(count):
                    value = int(rng.integers(-60, 60))
                    code, n = number(value - pred[comp])
                    bits.put(*dc[n])
                    bits.put(code, n)
                    pred[comp] = value
                    if comp == 0:
                        luma[2 * my + b // 2, 2 * mx + b % 2] = value
                    for sym in rng.choice([0x01, 0x02, 0x11, 0x23, 0xF0], int(rng.integers(0, 4))):
                        bits.put(*ac[int(sym)])
                        bits.put(int(rng.integers(0, 1 << (int(sym) & 15))), int(sym) & 15)
                    bits.put(*ac[0])
    seg = jpeg._segment
    frame = bytes([8, 0, 32, 0, 48, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, b"\0" + bytes([16] + [1] * 63)) + seg(0xC0, frame) + seg(0xC4, b"\x00" + dc_bits + dc_values) + seg(0xC4, b"\x10" + ac_bits + ac_values)
    data = head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bits.bytes() + b"\xff\xd9"
    (image,) = jpeg.read_jpegs([data])[0]
    assert (image.width, image.height, image.thumb.shape) == (48, 32, (4, 6))
    want = np.array([[min(255, max(0, luma[r, c] * 2 + 128)) for c in range(6)] for r in range(4)])
    assert (image.thumb == want).all()


def test_media_of_edges(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in jpeg.media(edge_docs, keep_file=True).collect()}
    for i, t in edge_rows:
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\xff" * (-len(raw) % jpeg.ROW if raw else jpeg.ROW)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file = bytes(r["media"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert r["feature"].startswith(f"{8 * jpeg.ROW}x{len(payload) // jpeg.ROW * 8}:")
    assert got[6]["media_sha256"] == got[7]["media_sha256"] and got[6]["feature"] == got[7]["feature"]
    assert jpeg.media(no_docs).count() == 0


def test_pieces_change_nothing(monkeypatch):
    """Coding and decoding in small pieces gives the same files and the same images."""
    import random

    rng = random.Random(5)
    payloads = [bytes(rng.randrange(256) for _ in range(jpeg.ROW * n)) for n in (1, 2, 9, 20)]
    files = [jpeg.write_jpeg(p) for p in payloads]
    whole = jpeg.read_jpegs(files)
    for rows, most, held in ((1, 8191, 1), (3, 7, 2000)):
        monkeypatch.setattr(jpeg, "CODED_ROWS", rows)
        monkeypatch.setattr(jpeg, "DECODED_BYTES", held)
        assert [jpeg.write_jpeg(p) for p in payloads] == files
        monkeypatch.setattr(jpeg, "MOST_ROWS", most)
        pieces = jpeg.read_jpegs([jpeg.write_jpeg(p) for p in payloads])
        assert [b"".join(im.thumb.tobytes() for im in x) for x in pieces] == payloads == [b"".join(im.thumb.tobytes() for im in x) for x in whole]
        monkeypatch.setattr(jpeg, "MOST_ROWS", 8191)
