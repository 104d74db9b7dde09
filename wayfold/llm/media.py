"""Media columns: texts held as progressive JPEG files and read back, with full-resolution RGB.

A text's payload (its UTF-8 bytes, zeros up to a positive multiple of 64) is stored in the format's
own unit, the quantised coefficient: one 8x8 block holds 64 payload bytes in zigzag order.  A byte
becomes an AC coefficient of size category 8 (b, or b - 255 below 128), so its magnitude bits are
the byte itself; a DC coefficient alternates between two levels so that every difference has
category 9.  The file is 4:2:0 with three components and, for each, a first DC scan, two spectral
bands of a first AC scan, and successive-approximation scans that add the last bit.

The reader accumulates scans into coefficient arrays.  Scans whose symbols are all of one kind are
read as arrays; any other progressive scan goes through the bit-by-bit reader.  The inverse
transform is one matrix product, chroma is repeated to full resolution, and pixels become RGB.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files and features;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import slices, to_bytes

#: Blocks of an end-of-band run at most, and MCU columns of an image (the format's limits).
RUN_LIMIT, COLUMNS = 32767, 4000
BANDS = ((1, 5), (6, 63))
LEVELS = np.array([256, 639], np.int32)


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order, from the rule of the diagonals."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


def _inverse_transform() -> np.ndarray:
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[_zigzag()].astype(np.float32)


_IDCT = _inverse_transform()
_B = np.arange(256)
_MAGNITUDE = np.where(_B >= 128, _B, 255 - _B)
#: A first-scan AC coefficient as coded (a zero bit and seven magnitude bits), and its last bit.
_FIRST = np.where(_B >= 128, _MAGNITUDE >> 1, 127 - (_MAGNITUDE >> 1)).astype(np.uint8)
_LAST = (_MAGNITUDE & 1).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(component: int, table: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, table, ss, se, ah << 4 | al])) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    spare = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes()


def _huffman(kind: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for n in sorted(lengths) for s in lengths[n]))


_TABLES = _huffman(0x00, {1: [9]}) + _huffman(0x10, {1: [7]}) + _huffman(0x11, {4: [n << 4 for n in range(15)]})


def geometry(blocks: int) -> tuple[int, int]:
    """MCU columns and rows that hold so many blocks, six to an MCU."""
    units = -(-blocks // 6)
    columns = min(units, COLUMNS)
    return columns, -(-units // columns)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    blocks = len(payload) // 64
    columns, rows = geometry(blocks)
    if rows > 4095:
        raise ValueError("a payload of over 6 GB does not fit one image")
    data = np.zeros((6 * columns * rows, 64), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    first, last = _FIRST[data], _LAST[data]
    n = columns * rows
    spans = ((1, 0, 4 * n), (2, 4 * n, 5 * n), (3, 5 * n, 6 * n))
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, bytes([0]) + b"\x01" * 64), _segment(0xC2, frame), _TABLES]
    for c, a, b in spans:
        level = (data[a:b, 0] >> 1) + LEVELS[np.arange(b - a) & 1]
        step = np.diff(level, prepend=0)
        coded = np.where(step < 0, step + 511, step).astype(">u2").view(np.uint8).reshape(-1, 2)
        out.append(_scan(c, 0, 0, 0, 0, 1, _packed(np.unpackbits(coded, axis=1)[:, 6:].ravel())))
    for ss, se in BANDS:
        out += [_scan(c, 0, ss, se, 0, 1, first[a:b, ss : se + 1].tobytes()) for c, a, b in spans]
    for c, a, b in spans:
        out.append(_scan(c, 0, 0, 0, 1, 0, _packed(data[a:b, 0] & 1)))
    for c, a, b in spans:
        bits = []
        for at in range(a, b, RUN_LIMIT):
            run = min(RUN_LIMIT, b - at)
            n = run.bit_length() - 1
            head = f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")
            bits += [np.array([int(x) for x in head], np.uint8), last[at : at + run, 1:].ravel()]
        out.append(_scan(c, 1, 1, 63, 1, 0, _packed(np.concatenate(bits))))
    return b"".join(out) + b"\xff\xd9"


class _Bits:
    """Bit by bit reading of one scan."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0
        self.at += 1
        return byte >> (7 - (self.at - 1) % 8) & 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that is not in its Huffman table")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _ac_first(bits: _Bits, table, blocks, ss, se, al):
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(bits.symbol(table), 16)
            if s:
                k += r
                block[k] = bits.signed(s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: _Bits, table, blocks, ss, se, al):
    run, one = 0, 1 << al

    def refine(block, k):
        if bits.bit():
            block[k] += one if block[k] > 0 else -one

    for block in blocks:
        k = ss
        while k <= se and not run:
            r, s = divmod(bits.symbol(table), 16)
            value = 0
            if s:
                value = one if bits.bit() else -one
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= se:
                if block[k]:
                    refine(block, k)
                elif r:
                    r -= 1
                else:
                    if value:
                        block[k] = value
                    k += 1
                    break
                k += 1
        if run:
            for k in range(k, se + 1):
                if block[k]:
                    refine(block, k)
            run -= 1


def _read_scan(data: bytes, blocks: np.ndarray, dc, ac, ss, se, ah, al, whole: bool) -> None:
    """One scan of one component into its blocks; whole scans of one kind of symbol as arrays."""
    n = len(blocks)
    if ss == 0:
        if ah:
            blocks[:, 0] |= (np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int16) << al)
        elif whole and dc.get((1, 0)) == 9 and len(dc) == 1 and 8 * len(data) >= 10 * n:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=10 * n).reshape(n, 10)
            step = bits[:, 1:].astype(np.int32) @ (1 << np.arange(8, -1, -1))
            blocks[:, 0] = np.cumsum(np.where(bits[:, 1] == 1, step, step - 511)) << al
        else:
            reader, level = _Bits(data), 0
            for block in blocks:
                level += reader.signed(reader.symbol(dc))
                block[0] = level * (1 << al)
        return
    width = se - ss + 1
    if not ah:
        raw = np.frombuffer(data, np.uint8)
        if whole and ac.get((1, 0)) == 7 and len(ac) == 1 and len(raw) == n * width and not (raw & 128).any():
            value = raw.astype(np.int16)
            blocks[:, ss : se + 1] = (np.where(raw & 64, value, value - 127) * (1 << al)).reshape(n, width)
        else:
            _ac_first(_Bits(data), ac, blocks, ss, se, al)
        return
    band = blocks[:, ss : se + 1]
    if whole and band.all():
        reader, bits, done = _Bits(data), np.unpackbits(np.frombuffer(data, np.uint8)), 0
        while done < n:
            r, s = divmod(reader.symbol(ac), 16)
            run = (1 << r) + reader.take(r) if not s and r < 15 else 0
            if not run or done + run > n:
                break
            add = bits[reader.at : reader.at + run * width].reshape(run, width).astype(np.int16) << al
            blocks[done : done + run, ss : se + 1] += np.where(band[done : done + run] > 0, add, -add)
            reader.at += run * width
            done += run
        if done == n:
            return
        raise ValueError("an end-of-band run passes the end of its scan")
    _ac_refine(_Bits(data), ac, blocks, ss, se, al)


_MARKER = re.compile(rb"\xff[^\x00]", re.DOTALL)


def coefficients(media: bytes, whole: bool = True):
    """(comments, rows, columns, coefficients of each component in zigzag order) of a 4:2:0 file."""
    at, comments, tables, planes, height, width = 2, [], {}, {}, 0, 0
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xC4:
            code, used = 0, 17
            found = {}
            for length, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    found[length, code] = body[used]
                    code, used = code + 1, used + 1
                code <<= 1
            tables[body[0]] = found
        elif marker == 0xC2:
            height, width = struct.unpack_from(">HH", body, 1)
            n = (height // 16) * (width // 16)
            planes = {c: np.zeros((n * (4 if c == 1 else 1), 64), np.int16) for c in (1, 2, 3)}
        elif marker == 0xDA:
            end = _MARKER.search(media, at).start()
            data = media[at:end].replace(b"\xff\x00", b"\xff")
            component, table, ss, se, approx = body[1:6]
            _read_scan(data, planes[component], tables.get(table >> 4, {}), tables.get(0x10 | table & 15, {}), ss, se, approx >> 4, approx & 15, whole)
            at = end
    return comments, height // 16, width // 16, [planes[c] for c in (1, 2, 3)]


def payload_of(comments, planes) -> bytes:
    blocks = np.concatenate(planes)
    data = np.where(blocks > 0, blocks, blocks + 255).astype(np.uint8)
    for a, b in zip(np.cumsum([0, *map(len, planes)]), np.cumsum([*map(len, planes)])):
        dc = blocks[a:b, 0].astype(np.int32)
        data[a:b, 0] = dc - 2 * LEVELS[np.arange(b - a) & 1]
    return data.tobytes()[: int(comments[0].partition(b"=")[2])]


def rgb(rows: int, columns: int, planes) -> np.ndarray:
    """Pixels (16 rows, 16 columns, 3) of accumulated coefficients."""

    def plane(blocks, high, wide):
        pixels = blocks.astype(np.float32) @ _IDCT + np.float32(128)
        return np.clip(pixels, 0, 255).reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)

    y = plane(planes[0], 2 * rows, 2 * columns)
    cb, cr = (plane(p, rows, columns).repeat(2, 0).repeat(2, 1) - np.float32(128) for p in planes[1:])
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0] = y + np.float32(1.402) * cr
    out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    out[..., 2] = y + np.float32(1.772) * cb
    return np.clip(out + np.float32(0.5), 0, 255).astype(np.uint8)


def feature(pixels: np.ndarray) -> str:
    """Height, width, and the exact sums of each colour."""
    sums = pixels.sum(axis=(0, 1), dtype=np.int64)
    return ",".join(map(str, (*pixels.shape[:2], *sums.tolist())))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(tensors: bool):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), to_bytes(batch.column("text"))):
                    media = encode(text + bytes(-len(text) % 64 if text else 64))
                    comments, rows, columns, planes = coefficients(media)
                    back = payload_of(comments, planes)
                    pixels = rgb(rows, columns, planes)
                    row = (doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels))
                    out.append(row + ((media, pixels.tobytes(), list(pixels.shape)) if tensors else ()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "rgb", "shape"]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def media_columns(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """The stored file, its read-back digests, and (with tensors) file, RGB bytes and shape of every document."""
    Scratch(docs.sparkSession, "media")
    schema = SCHEMA + (", media binary, rgb binary, shape array<int>" if tensors else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored(tensors), schema)


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), tensors=False)
