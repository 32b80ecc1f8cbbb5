"""Media columns: baseline JPEG read and written in numpy, down to the DC coefficients.

``read_jpeg`` parses the markers of baseline (SOF0) images with any sampling factors and Huffman-decodes their scans.
Parts between restart markers don't depend on each other, so all parts of all images of a call advance in lockstep,
one Huffman symbol a step, as numpy lanes. AC coefficients are decoded and skipped; the DC coefficients of the first
component give a luminance thumbnail of one sample per block.

``write_jpeg`` stores bytes losslessly as such an image: a byte is a flat 8x8 block, that is one DC coefficient under
a quantiser of 8, and there is a restart marker after each row of blocks.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import grouped_texts, table, utf8

#: Samples a row, and rows an image at most (65535 lines of pixels); longer payloads become several images in a row.
ROW, MOST_ROWS = 576, 8191
#: Rows coded at a time, and bytes of scans decoded together: what numpy holds at once doesn't grow with the text.
CODED_ROWS, DECODED_BYTES = 1024, 4 << 20
#: Code lengths of the DC table: counts for 1..16 bits, then the categories (the usual luminance table).
DC_BITS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: The AC table only needs "end of block".
AC_BITS, AC_VALUES = bytes([1] + [0] * 15), bytes([0])
#: Bits of the longest block: a code of 6, 8 bits more, 1 for "end of block".
CODE_BITS = 15


def huffman(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(value, code, length) by the canonical rule."""
    out, code, k = [], 0, 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            out.append((values[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits that may follow: length * 256 + value; 0 if no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for v, code, n in huffman(bits, values):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + v
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: the bits of its code, extra bits and end of block; and how many."""
    dc, (_, eob, eob_n) = {v: (c, n) for v, c, n in huffman(DC_BITS, DC_VALUES)}, huffman(AC_BITS, AC_VALUES)[0]
    bits, size = np.zeros((511, CODE_BITS), np.uint8), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = dc[cat]
        value = (code << cat | (d if d >= 0 else d + (1 << cat) - 1)) << eob_n | eob
        n += cat + eob_n
        bits[d + 255, :n] = [value >> k & 1 for k in range(n - 1, -1, -1)]
        size[d + 255] = n
    return bits, size


_BITS, _SIZE = _tables()


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def write_jpeg(payload: bytes) -> bytes:
    """Bytes (a positive multiple of ROW) as baseline JPEG images; more than MOST_ROWS rows take several images."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    step = ROW * MOST_ROWS
    return b"".join(_write(payload[k : k + step]) for k in range(0, len(payload), step))


def _coded(payload: bytes) -> list[bytes]:
    """The entropy-coded bytes of each row of samples."""
    rows = len(payload) // ROW
    v = np.frombuffer(payload, np.uint8).reshape(rows, ROW).astype(np.int16) - 128
    d = np.diff(v, axis=1, prepend=np.int16(0)) + 255  # the prediction starts anew in each row
    size = _SIZE[d]
    used = size.sum(1)
    width = (used + 7) // 8 * 8
    # one flat bit array in which each row starts at a byte, filled up with ones
    flat = _BITS[d.ravel()]
    keep = np.arange(CODE_BITS)[None, :] < size.ravel()[:, None]
    bits = np.ones(int(width.sum()), np.uint8)
    starts = np.concatenate(([0], np.cumsum(width)[:-1]))
    where = np.ones(len(bits), bool)
    for k in range(7):  # at most seven bits of filling
        at = (starts + used + k)[used + k < width]
        where[at] = False
    bits[where] = flat[keep]
    data = np.packbits(bits).tobytes()
    ends = (np.cumsum(width) // 8).tolist()
    return [data[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *ends], ends, strict=False)]


def _write(payload: bytes) -> bytes:
    rows, parts = len(payload) // ROW, []
    for k in range(0, len(payload), ROW * CODED_ROWS):
        for coded in _coded(payload[k : k + ROW * CODED_ROWS]):
            if parts:
                parts.append(bytes((0xFF, 0xD0 + (len(parts) // 2) % 8)))
            parts.append(coded)
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\x00" + DC_BITS + DC_VALUES) + _segment(0xC4, b"\x10" + AC_BITS + AC_VALUES)
    head += _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    return head + b"".join(parts) + b"\xff\xd9"


@dataclass
class Image:
    """width, height in pixels; thumb: one luminance sample a block (uint8, rows by columns)."""

    width: int
    height: int
    thumb: np.ndarray


@dataclass
class _Scan:
    width: int
    height: int
    quant: int
    mcus: tuple[int, int]  # rows, columns
    blocks: list[tuple[int, int, int]]  # of one MCU: component, DC table, AC table
    sampling: tuple[int, int]  # of the first component: across, down
    tables: list[tuple[bytes, bytes]]
    parts: list[bytes]
    interval: int


def _parse(data: bytes, at: int) -> tuple[_Scan, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    quants, tables, frame, interval = {}, {}, None, 0
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quants[k] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + (wide > 0)) :]
        elif kind == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + m]
                body = body[17 + m :]
        elif kind == 0xC0 or kind == 0xC1:
            bits, h, w, m = struct.unpack_from(">BHHB", body)
            frame = h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(m)]
            if bits != 8:
                raise ValueError("not 8 bits a sample")
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xD0)) and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            break
    if frame is None:
        raise ValueError("a scan before the frame")
    h, w, comps = frame
    chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if len(chosen) != len(comps):
        raise ValueError("components in several scans aren't supported")
    ends, raw = [], data[at:]
    k, cut = 0, []
    while True:  # markers: not a stuffed 0, not filling
        k = raw.find(b"\xff", k)
        if k < 0 or k + 1 >= len(raw):
            raise ValueError("the scan has no end")
        kind = raw[k + 1]
        if kind == 0 or kind == 0xFF:
            k += 1 + (kind == 0)
        elif 0xD0 <= kind <= 0xD7:
            cut.append(k)
            k += 2
        else:
            break
    starts, ends = [0, *(c + 2 for c in cut)], [*cut, k]
    at += k
    while data[at : at + 2] != b"\xff\xd9":
        n = struct.unpack_from(">H", data, at + 2)[0]
        at += 2 + n
    if len(comps) == 1:  # one component: a unit is one block
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    mcus = -(-h // (8 * most_v)), -(-w // (8 * most_h))
    used, blocks = [], []
    for i, (key, across, down, _) in enumerate(comps):
        sel = chosen[key]
        used += [tables[sel >> 4], tables[16 + (sel & 15)]]
        blocks += [(i, 2 * i, 2 * i + 1)] * (across * down)
    parts = [raw[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(starts, ends, strict=True)]
    return _Scan(w, h, quants[comps[0][3]], mcus, blocks, (comps[0][1], comps[0][2]), used, parts, interval or mcus[0] * mcus[1]), at + 2


def read_jpegs(files: list[bytes]) -> list[list[Image]]:
    """The images of each file (a file may hold several, one after the other)."""
    out: list[list[Image]] = [[] for _ in files]
    scans: list[_Scan] = []
    owner, held = [], 0

    def decode() -> None:
        for k, s, t in zip(owner, scans, _decode(scans), strict=True):
            out[k].append(Image(s.width, s.height, t))
        scans.clear()
        owner.clear()

    for k, data in enumerate(files):
        at = 0
        while at < len(data):
            s, after = _parse(data, at)
            scans.append(s)
            owner.append(k)
            held, at = held + after - at, after
            if held >= DECODED_BYTES:
                decode()
                held = 0
    decode()
    return out


def _decode(scans: list[_Scan]) -> list[np.ndarray]:
    groups: dict[tuple, list[int]] = {}
    for k, s in enumerate(scans):  # images with the same layout and tables go together
        groups.setdefault((tuple(s.blocks), tuple(s.tables), s.interval), []).append(k)
    out: list[np.ndarray | None] = [None] * len(scans)
    for (blocks, _, interval), of in groups.items():
        todo = []
        for k in of:
            total = scans[k].mcus[0] * scans[k].mcus[1]
            left = [min(interval, total - j) for j in range(0, total, interval)]
            if len(left) != len(scans[k].parts):
                raise ValueError("parts of the scan are missing")
            todo += left
        dc = _lanes([p for k in of for p in scans[k].parts], np.array(todo), list(blocks), scans[of[0]].tables)
        at = 0
        for k in of:
            s = scans[k]
            n = len(s.parts)
            rows, (across, down) = dc[at : at + n], s.sampling
            at += n
            per = across * down
            flat = rows.reshape(-1)[: s.mcus[0] * s.mcus[1] * per] if n == 1 or rows.shape[1] == interval * per else None
            grid = flat.reshape(s.mcus[0], s.mcus[1], down, across).transpose(0, 2, 1, 3).reshape(s.mcus[0] * down, s.mcus[1] * across)
            grid = grid[: -(-s.height // 8) if per == 1 else None, : -(-s.width // 8) if per == 1 else None]
            value = np.floor(grid.astype(np.int64) * s.quant / 8 + 0.5) + 128
            out[k] = np.clip(value, 0, 255).astype(np.uint8)
    return out


def _lanes(parts: list[bytes], todo: np.ndarray, blocks: list[tuple[int, int, int]], tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """DC coefficients of the first component, a row for each part: every part is one lane of the lockstep decoder."""
    n, per = len(parts), sum(b[0] == 0 for b in blocks)
    data = np.frombuffer(b"".join(p + b"\xff\xff\xff\xff" for p in parts), np.uint8)
    word = data[:-3].astype(np.uint32) << 24
    word |= data[1:-2].astype(np.uint32) << 16
    word |= data[2:-1].astype(np.uint32) << 8
    word |= data[3:]
    size = np.array([len(p) + 4 for p in parts], np.int64)
    start = (np.cumsum(size) - size) * 8
    end = start + (size - 4) * 8
    bit = start.copy()
    lut = np.concatenate([lookup(*t) for t in tables])
    out = np.zeros((n, int(todo.max()) * per), np.int32)
    pred = np.zeros((n, 1 + max(b[0] for b in blocks)), np.int32)

    def take(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The next ``count`` bits (16 at most) of each lane."""
        w = word[np.minimum(at >> 3, len(word) - 1)].astype(np.int64)
        return (w << (at & 7) & 0xFFFFFFFF) >> (32 - count)

    lanes = np.arange(n)
    flat = [_flat(tables[d], tables[a]) for _, d, a in blocks]
    for m in range(int(todo.max())):
        if len(lanes) and (todo[lanes] <= m).any():
            lanes = lanes[todo[lanes] > m]
        every = len(lanes) == n
        of = 0
        for (comp, dc_table, ac_table), (flat_value, flat_bits) in zip(blocks, flat, strict=True):
            pos = bit if every else bit[lanes]
            peek = word[pos >> 3] << (pos & 7).astype(np.uint32) >> 16
            value, used = flat_value[peek], flat_bits[peek]
            if used.all():
                pos = pos + used
            else:
                slow = np.flatnonzero(used == 0)
                pos = pos + used
                value[slow], pos[slow] = _block(take, lut, pos[slow], dc_table << 16, ac_table << 16)
            if every:
                pred[:, comp] += value
                now = pred[:, comp]
                bit = pos
            else:
                now = pred[lanes, comp] = pred[lanes, comp] + value
                bit[lanes] = pos
            if comp == 0:
                out[lanes, m * per + of] = now
                of += 1
        if (bit > end).any():
            raise ValueError("damaged scan")
    return out


@functools.lru_cache(16)
def _flat(dc_table: tuple[bytes, bytes], ac_table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that hold a whole flat block (DC code, its extra bits, end of block): the difference and the
    number of bits; else 0 bits."""
    i, dc, ac = np.arange(1 << 16), lookup(*dc_table), lookup(*ac_table)
    n, cat = dc >> 8, dc & 255
    extra = (i << n & 0xFFFF) >> np.maximum(16 - cat, 0)
    value = np.where(extra < (1 << cat >> 1), extra - (1 << cat) + 1, extra)
    rest = ac[i << np.minimum(n + cat, 16) & 0xFFFF]
    used = n + cat + (rest >> 8)
    whole = (dc > 0) & (rest > 0) & (rest & 255 == 0) & (used <= 16)
    return np.where(whole, value, 0).astype(np.int32), np.where(whole, used, 0).astype(np.int64)


def _block(take, lut: np.ndarray, pos: np.ndarray, dc_at: int, ac_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Any block: its DC difference, and where the next one starts."""
    full = np.full(len(pos), 16, np.int64)
    code = lut[dc_at + take(pos, full)]
    cat = (code & 255).astype(np.int64)
    pos = pos + (code >> 8)
    extra = take(pos, cat)
    pos = pos + cat
    value = np.where(extra < (1 << cat >> 1), extra - (1 << cat) + 1, extra)
    bad = code == 0
    k, left = np.ones(len(pos), np.int64), np.arange(len(pos))
    while len(left):  # AC: run and size, then so many bits to skip; 0 ends the block
        code = lut[ac_at + take(pos[left], full[: len(left)])]
        sym = (code & 255).astype(np.int64)
        bad[left] |= code == 0
        pos[left] += (code >> 8) + (sym & 15)
        k[left] += np.where(sym == 0, 64, (sym >> 4) + 1)
        left = left[(k[left] < 64) & (code != 0)]
    if bad.any():
        raise ValueError("damaged scan")
    return value, pos


def pad(raw: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of ROW."""
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


def feature(images: list[Image]) -> str:
    """Dimensions and hashes of the thumbnails: whether each cell of an 8x9 grid of means is brighter than its right
    neighbour, 64 bits an image."""
    out = []
    for im in images:
        h, w = im.thumb.shape
        rows, cols = np.arange(8) * h // 8, np.arange(9) * w // 9
        sums = np.add.reduceat(np.add.reduceat(im.thumb.astype(np.int64), rows, 0), np.unique(cols), 1) if h >= 8 else np.add.reduceat(im.thumb[np.minimum(rows, h - 1)].astype(np.int64), np.unique(cols), 1)
        n = np.diff(np.append(np.unique(cols), w))
        mean = sums // n
        mean = mean[:, np.searchsorted(np.unique(cols), cols)]
        out.append(f"{im.width}x{im.height}:{int.from_bytes(np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes(), 'big'):016x}")
    return ";".join(out)


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_file: bool = False) -> DataFrame:
    """id, width, height, thumb_hash, and what the store query needs, for each whole text kept as a JPEG file.

    The bytes of the payload that the digests are of come from decoding the stored file. Null and empty texts have a
    payload of one row of 255. Equal texts give equal rows. keep_file adds the file itself (column ``media``)."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int" + ", media binary" * keep_file

    def run(it):
        import pyarrow as pa

        sha = hashlib.sha256
        for keys, texts in grouped_texts(it, 3 << 20):
            raws = [utf8(t) for t in texts]
            files = [write_jpeg(pad(r)) for r in raws]
            images = read_jpegs(files)
            back = [b"".join(im.thumb.tobytes() for im in x) for x in images]
            cols = [
                pa.array(keys),
                pa.array([len(r) for r in raws], pa.int64()),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([sha(b).hexdigest() for b in back]),
                pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([sha(f).hexdigest() for f in files]),
                pa.array([feature(x) for x in images]),
                pa.array([x[0].width for x in images], pa.int32()),
                pa.array([sum(im.height for im in x) for x in images], pa.int32()),
            ]
            if keep_file:
                cols.append(pa.array(files, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0].strip("`") for c in schema.split(", ")])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
