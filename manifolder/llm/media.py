"""AVI motion-JPEG in binary columns: lossless payload storage, decoding, shots.

Writing.  A payload byte is the mean of one 8 x 8 block of a grey baseline
JPEG: the DC coefficient is quantised by 8, so block value and byte are equal
and any decoder returns it exactly.  Blocks have no AC coefficients.  The DC
code gives a difference of category s a code word of 9 - s bits, which with
its s extra bits and the one-bit end-of-block makes every block 10 bits long,
so frames are packed and unpacked by array operations.

Reading.  Chunks are found by the RIFF indexes (OpenDML's ``indx`` with its
``ix##`` chunks, which reach beyond a gigabyte, or ``idx1``), or by walking
every ``movi`` list where there is none.  Frames are decoded with the tables
that they bring along, or with the standard ones where they leave them out, as
motion-JPEG does.  Frames whose code words make all blocks equally long are
decoded all at once; others, including those with AC coefficients, block by
block.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks in a row and in a column of a frame, and frames a second, of what is written.
BLOCKS = (16, 12)
FPS = 25
FRAME = BLOCKS[0] * BLOCKS[1]


@lru_cache(maxsize=1)
def zigzag() -> list[tuple[int, int]]:
    """Rows and columns along the anti-diagonals of an 8 x 8 block, direction alternating."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return sorted(cells, key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a canonical Huffman table given as (bits, symbol) in order."""
    code, previous, out = 0, 0, {}
    for bits, symbol in lengths:
        code <<= bits - previous
        out[symbol] = (code, bits)
        code, previous = code + 1, bits
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(1 for bits, _ in lengths if bits == n) for n in range(1, 17)]
    return bytes([kind, *counts, *(s for _, s in lengths)])


_DC = [(9 - s, s) for s in range(8, -1, -1)]
_AC = [(1, 0)]


# The typical Huffman tables of the JPEG standard, as the number of codes of each length from 1 to 16
# bits and the symbols in order; motion-JPEG frames may leave them out.
_STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738"
        "393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5"
        "a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a63646566"
        "6768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8"
        "c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def _lengths(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) in order."""
    return list(zip([n for n, c in enumerate(counts, 1) for _ in range(c)], symbols))


@lru_cache(maxsize=1)
def standard_tables() -> dict[int, list[tuple[int, int]]]:
    return {kind: _lengths(bytes.fromhex(counts), bytes.fromhex(symbols)) for kind, (counts, symbols) in _STANDARD.items()}


@lru_cache(maxsize=1)
def _header() -> bytes:
    width, height = BLOCKS[0] * 8, BLOCKS[1] * 8
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, _huffman(0x00, _DC) + _huffman(0x10, _AC)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


@lru_cache(maxsize=1)
def _block_words() -> np.ndarray:
    """The 10 bits of a block by its difference from the one before, plus 255."""
    codes, out = _codes(_DC), np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, _ = codes[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        out[diff + 255] = ((code << size) | extra) << 1  # the end of block is a 0
    return out


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG for each ``FRAME`` bytes of a payload."""
    values = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    diffs = np.diff(values, axis=1, prepend=np.int16(128))
    words = _block_words()[diffs + 255].reshape(-1, 4)
    joined = words[:, 0] << np.uint64(30) | words[:, 1] << np.uint64(20) | words[:, 2] << np.uint64(10) | words[:, 3]
    scans = joined.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size, head = FRAME * 10 // 8, _header()
    return [b"".join((head, scans[k : k + size].replace(b"\xff", b"\xff\x00"), b"\xff\xd9")) for k in range(0, len(scans), size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return b"".join((name, struct.pack("<I", len(body)), body, b"\0" * (len(body) % 2)))


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI with one motion-JPEG stream and an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    places = 4 + np.cumsum(sizes + sizes % 2 + 8) - (sizes + sizes % 2 + 8)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, places, sizes
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    body = b"".join((b"AVI ", headers, movi, _chunk(b"idx1", index.tobytes())))
    return _chunk(b"RIFF", body)


def store_payload(payload: bytes) -> bytes:
    """The AVI that has ``payload``, a multiple of ``FRAME`` bytes, in its blocks."""
    return write_avi(encode_frames(payload), BLOCKS[0] * 8, BLOCKS[1] * 8)


def _chunks(data: bytes, at: int, stop: int):
    """(name, where the body begins, size) of the chunks between two places, as far as they are whole."""
    while at + 8 <= stop:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, size
        at += 8 + size + size % 2


def _is_video(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _indexed(data: bytes, at: int, size: int) -> list[tuple[int, int]]:
    """(place, size) of the frames that an OpenDML index lists: of a super index those of all its parts."""
    words, kind, n, name, base = struct.unpack_from("<HxBI4sQ", data, at)
    if kind == 0:
        out = []
        for k in range(min(n, (size - 24) // 16)):
            place, _, _ = struct.unpack_from("<QII", data, at + 24 + 16 * k)
            out += _indexed(data, place + 8, int.from_bytes(data[place + 4 : place + 8], "little"))
        return out
    if kind != 1 or not _is_video(name):
        return []
    entries = (struct.unpack_from("<II", data, at + 24 + 4 * words * k) for k in range(min(n, (size - 24) // (4 * words))))
    return [(base + place, length & 0x7FFFFFFF) for place, length in entries]  # the top bit marks what isn't a key frame


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the compressed frames of the first video stream.

    Later ``RIFF`` parts of a large file, ``AVIX``, are read, too.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movies, index, opened = float(FPS), [], None, []
    stack = [(body + 4, min(len(data), body + size)) for name, body, size in _chunks(data, 0, len(data)) if name == b"RIFF" and data[body : body + 4] in (b"AVI ", b"AVIX")][::-1]
    while stack:
        for name, body, size in _chunks(data, *stack.pop()):
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movies.append((body, min(len(data), body + size)))
            elif name == b"LIST":
                stack.append((body + 4, body + size))
            elif name == b"avih" and (us := int.from_bytes(data[body : body + 4], "little")):
                fps = 1e6 / us
            elif name == b"idx1":
                index = data[body : body + size]
            elif name == b"indx":
                opened = opened or _indexed(data, body, size)
    if opened:
        return fps, [data[at : at + size] for at, size in opened]
    if index and movies:
        frames, movi = [], movies[0][0]
        for name, _, place, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
            if _is_video(name):
                at = movi + place if data[movi + place : movi + place + 4] == name else place
                frames.append(data[at + 8 : at + 8 + size])
        return fps, frames
    return fps, [data[body : body + size] for movi, end in movies for name, body, size in _walked(data, movi + 4, end) if _is_video(name)]


def _walked(data: bytes, at: int, stop: int):
    """The chunks of a ``movi`` list, and those of the ``rec `` lists in it."""
    for name, body, size in _chunks(data, at, stop):
        if name == b"LIST":
            yield from _walked(data, body + 4, min(stop, body + size))
        else:
            yield name, body, size


class _Frame:
    """Header of a baseline JPEG: size, tables and where its scan begins."""

    def __init__(self, data: bytes):
        self.quant: dict[int, list[int]] = {}
        self.lengths: dict[int, list[tuple[int, int]]] = dict(standard_tables())
        self.components: list[tuple[int, int, int, int]] = []
        self.tables: dict[int, tuple[int, int]] = {}
        self.restart = self.width = self.height = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            while data[at + 1] == 0xFF:  # a marker may have fill bytes before it
                at += 1
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + n]))
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    kind, counts = body[0], body[1:17]
                    symbols = body[17 : 17 + sum(counts)]
                    self.lengths[kind] = _lengths(counts, symbols)
                    body = body[17 + sum(counts) :]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG frames are decoded")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                break
        self.scan = at

    def block_bits(self) -> int:
        """Bits of every block if all are equally long and without AC coefficients, else 0."""
        if len(self.components) != 1 or self.restart:
            return 0
        dc, ac = self.tables[self.components[0][0]]
        lengths, end = self.lengths.get(dc, []), self.lengths.get(16 + ac, [])
        totals = {bits + s for bits, s in lengths}
        return totals.pop() + end[0][0] if len(totals) == 1 and len(end) == 1 and end[0][1] == 0 else 0


@lru_cache(maxsize=64)
def _parsed(header: bytes) -> _Frame:
    return _Frame(header)


@lru_cache(maxsize=8)
def _block_diffs(header: bytes) -> np.ndarray:
    """The DC difference for each bit pattern of a block of constant length."""
    frame = _parsed(header)
    bits = frame.block_bits()
    dc, ac = frame.tables[frame.components[0][0]]
    codes, tail = _codes(frame.lengths[dc]), frame.lengths[16 + ac][0][0]
    out = np.zeros(1 << bits, np.int32)
    for s, (code, _) in codes.items():
        for extra in range(1 << s):
            value = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            out[((code << s) | extra) << tail] = value
    return out


def _fast_blocks(header: bytes, scans: list[bytes], blocks: int) -> np.ndarray:
    """(frames, blocks) of DC values; all scans have constant-length blocks."""
    bits = _parsed(header).block_bits()
    size = (bits * blocks + 7) // 8
    whole = np.frombuffer(b"".join(s.replace(b"\xff\x00", b"\xff")[:size] for s in scans), np.uint8).reshape(-1, size)
    if bits == 10 and blocks % 4 == 0:
        wide = np.zeros((len(scans) * blocks // 4, 8), np.uint8)
        wide[:, 3:] = whole.reshape(-1, 5)
        joined = wide.view(">u8").ravel().astype(np.uint64)
        words = np.stack([joined >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).reshape(len(scans), blocks)
    else:
        spread = np.unpackbits(whole, axis=1)[:, : bits * blocks].reshape(len(scans), blocks, bits)
        words = spread.astype(np.int64) @ (1 << np.arange(bits)[::-1])
    return np.cumsum(_block_diffs(header)[words], axis=1)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    return basis


def _lookup(lengths: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bits, symbol) of the code that each 16-bit window begins with; 0 bits where none does."""
    out = [(0, 0)] * (1 << 16)
    for symbol, (code, bits) in _codes(lengths).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = [(bits, symbol)] * (1 << (16 - bits))
    return out


@lru_cache(maxsize=16)
def _lookup_of(lengths: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    return _lookup(list(lengths))


class _Bits:
    """Bits of a scan through a window of 64, refilled as they are read; ones follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.window = data, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 6]
        self.at += 6
        if len(more) < 6:
            more += b"\xff" * (6 - len(more))
        self.window = (self.window & (1 << self.held) - 1) << 48 | int.from_bytes(more, "big")
        self.held += 48

    def take(self, n: int) -> int:
        if self.held < n:
            self._fill()
        self.held -= n
        return self.window >> self.held & (1 << n) - 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.held < 16:
            self._fill()
        bits, symbol = table[self.window >> (self.held - 16) & 0xFFFF]
        if not bits or self.at > len(self.data) + 64:
            raise ValueError("broken JPEG scan")
        self.held -= bits
        return symbol

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _scan_parts(scan: bytes) -> list[bytes]:
    """The entropy-coded parts of a scan between its restart markers, without stuffed bytes."""
    parts, begin = [], 0
    for mark in re.finditer(rb"\xff+([^\x00\xff])", scan):
        parts.append(scan[begin : mark.start()])
        begin = mark.end()
        if not 0xD0 <= mark[1][0] <= 0xD7:
            break
    else:
        parts.append(scan[begin:])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes of any baseline JPEG, at the size of their own sampling."""
    frame = _Frame(data)
    parts = _scan_parts(data[frame.scan :])
    hmax, vmax = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    shapes = [(down * v, across * h) for _, h, v, _ in frame.components]
    coefficients = [np.zeros((rows * columns, 64), np.int32) for rows, columns in shapes]
    order = [r * 8 + c for r, c in zigzag()]
    tables = {name: (_lookup_of(tuple(frame.lengths[dc])), _lookup_of(tuple(frame.lengths[16 + ac]))) for name, (dc, ac) in frame.tables.items()}
    before, part = [0] * len(shapes), 0
    bits = _Bits(parts[0] if parts else b"")
    for mcu in range(across * down):
        if frame.restart and mcu and mcu % frame.restart == 0:
            part, before = part + 1, [0] * len(shapes)
            bits = _Bits(parts[part])
        for c, (name, h, v, _) in enumerate(frame.components):
            dc, ac = tables[name]
            for b in range(h * v):
                block = coefficients[c][((mcu // across) * v + b // h) * shapes[c][1] + (mcu % across) * h + b % h]
                before[c] += bits.signed(bits.symbol(dc))
                block[0] = before[c]
                at = 1
                while at < 64:
                    value = bits.symbol(ac)
                    if value == 0:
                        break
                    at += value >> 4
                    if value & 15:
                        block[order[at]] = bits.signed(value & 15)
                    at += 1
    basis, planes = _cosines(), []
    for (rows, columns), values, (_, _, _, q) in zip(shapes, coefficients, frame.components):
        scale = np.zeros(64)
        scale[order] = frame.quant[q]
        pixels = np.clip(np.rint(basis @ (values * scale).reshape(-1, 8, 8) @ basis.T + 128), 0, 255)
        planes.append(pixels.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8).astype(np.uint8))
    return planes


def block_means(frames: list[bytes]) -> np.ndarray:
    """(frames, blocks) of the grey values of the blocks of equally large frames."""
    if not frames:
        return np.zeros((0, 0), np.uint8)
    first = _Frame(frames[0])
    header = frames[0][: first.scan]
    if first.block_bits() and all(f.startswith(header) for f in frames):
        blocks = -(-first.width // 8) * -(-first.height // 8)
        step = first.quant[first.components[0][3]][0]
        values = _fast_blocks(header, [f[len(header) : -2] for f in frames], blocks) * step
        return np.clip((values + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    planes = [decode_jpeg(f)[0] for f in frames]
    return np.array([np.rint(p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).mean(axis=(1, 3))).ravel() for p in planes]).astype(np.uint8)


def shots(values: np.ndarray, bins: int = 16, window: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A cut is where the histogram difference of neighbouring frames exceeds
    ``least`` and the mean plus ``factor`` deviations of the ``window``
    differences on either side.
    """
    n = len(values)
    if not n:
        return []
    flat = values.astype(np.int64) * bins // 256 + np.arange(n)[:, None] * bins
    histogram = np.bincount(flat.ravel(), minlength=n * bins).reshape(n, bins)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * values.shape[1])
    m = len(change)
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    low, high = np.maximum(np.arange(m) - window, 0), np.minimum(np.arange(m) + window + 1, m)
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - change**2) / others - mean**2, 0))
    cuts = (np.flatnonzero(change > np.maximum(least, mean + factor * spread)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and them filled up with spaces to a positive multiple of ``FRAME``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def _batches_of(column, most: int = 2_000_000):
    """Stretches of a column of about ``most`` bytes, at least one row each."""
    start, size = 0, 0
    for k in range(len(column)):
        value = column[k]
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(column):
        yield start, len(column)


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): an AVI for the whole text of every row.

    A null text is an empty one and has a frame of spaces.  Repeated rows and
    ids are stored each; an empty table stays empty; other columns are not
    read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in _batches_of(batch.column(1)):
                some = batch.slice(a, b - a)
                padded = [payload_of(t) for t in some.column(1).to_pylist()]
                frames = encode_frames(b"".join(p for _, p in padded))
                media, at = [], 0
                for _, p in padded:
                    media.append(write_avi(frames[at : at + len(p) // FRAME], BLOCKS[0] * 8, BLOCKS[1] * 8))
                    at += len(p) // FRAME
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([n for n, _ in padded], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, brightness): a row for each shot of every media value.

    Null or broken media give one row with null times, so no row of ``media``
    is lost.  Repeated rows and ids have their clips each; an empty table has
    none; other columns are not read.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    fps, frames = parse_avi(data.as_py() or b"")
                    values = block_means(frames)
                    rows += [(key, k, round(1000 * a / fps), round(1000 * b / fps), float(values[a:b].mean())) for k, (a, b) in enumerate(shots(values))]
                except _BROKEN:
                    rows.append((key, 0, None, None, None))
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=["doc_id", "clip", "start_ms", "end_ms", "brightness"])

    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id {kind}, clip int, start_ms long, end_ms long, brightness double")


def _features(fps: float, own: np.ndarray, data: bytes) -> tuple:
    payload = own.tobytes()
    found = shots(own)
    longest = max((z - y for y, z in found), default=0)
    mean = int(own.sum(dtype=np.int64)) * 1000 // max(1, own.size)
    feature = f"frames={len(own)};shots={len(found)};longest_ms={round(1000 * longest / fps)};brightness={mean}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)


_BROKEN = (ValueError, KeyError, IndexError, struct.error)


def _read_back(stored: list[bytes | None]) -> list[tuple]:
    """The features of each media value; values of one kind of frames are decoded all at once."""
    try:
        parsed = [parse_avi(m) for m in stored]
        values = block_means([f for _, frames in parsed for f in frames])
        ends = np.cumsum([len(frames) for _, frames in parsed])
        return [_features(fps, values[z - len(frames) : z], data) for (fps, frames), z, data in zip(parsed, ends, stored)]
    except (TypeError, *_BROKEN):  # some value is null, broken or of another kind: one by one
        rows = []
        for data in stored:
            if data is None:
                rows.append((None,) * 6)
                continue
            try:
                fps, frames = parse_avi(data)
                rows.append(_features(fps, block_means(frames), data))
            except _BROKEN:
                rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None))
        return rows


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): payload, checksums and shot features.

    A null value has null features; one that can't be decoded has its own size
    and checksum and otherwise nulls, so every row, repeated ones included, has
    its row.  A film without frames has an empty payload.  An empty table gives
    an empty result; other columns are not read.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in _batches_of(batch.column(2), 4_000_000):
                some = batch.slice(a, b - a)
                rows = _read_back(some.column(2).to_pylist())
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n_bytes", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
