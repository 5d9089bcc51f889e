"""Media columns: AVI files of motion JPEG, written, read back and cut into shots.

`store` turns bytes into an AVI file: frames of 24 x 24 samples, each frame a baseline grayscale
JPEG in which a sample is one 8 x 8 block of constant value. Such a block is its DC coefficient
alone, and with a quantizer of 8 that coefficient is the sample, so that the JPEG is lossless.
`clips` parses the RIFF chunks and the index, decodes the intra frames, and detects shots: a cut
stands where the difference of neighbouring frames' histograms exceeds the mean of the differences
around it by some deviations.

Frames of constant blocks yield a sample a block and are decoded side by side in numpy. All other
baseline frames (AC coefficients, colour with any sampling, restart intervals, several scans, no
code tables, as motion JPEG may leave out the standard ones) are decoded one by one, coefficients,
inverse transform and all; of these the luma plane counts.

Cases: null and empty texts are one frame of padding. Texts are taken whole, of any length. A null
medium, one that is no AVI, and one with a frame that is damaged or not baseline have a null payload,
null shots and the reason as `error`; a file without frames has an empty payload and no shots.
Repeated rows give equal results, ties of differences are no cut. An empty table gives an empty
result. Other columns are carried along, but for those named as the result's own, whose place these
take.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.bpe import slices
from attesta.llm.tables import read

SIDE = 24
SAMPLES = SIDE * SIDE
RATE = 25
BINS = 16
SLICE = 2 << 20
#: Headers of plain frames that a task keeps.
MOST_HEADERS = 64
#: The end of a scan's bytes, and the restarts within.
ENDS, RESTARTS = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff[\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: DC categories 0 to 11 with codes of 4 bits; the end of a block is the one AC symbol, a single bit.
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8]) * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
EOI = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs by d from the one before, at index d + 255."""
    d = np.arange(-255, 256)
    size = np.array([int(abs(x)).bit_length() for x in d])
    low = np.where(d >= 0, d, d + (1 << size) - 1)
    return (((size << size) | low) << 1).astype(np.int32), (size + 5).astype(np.int32)


CODE, CODE_BITS = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of the rows of samples (frames x 576 bytes)."""
    d = np.empty(samples.shape, np.int32)
    d[:, 0] = samples[:, 0].astype(np.int32) - 128
    d[:, 1:] = samples[:, 1:].astype(np.int32) - samples[:, :-1]
    d += 255
    bits = CODE_BITS[d]
    ends = np.cumsum(bits, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends - bits + (first[:-1] * 8)[:, None]
    word = (CODE[d] << (24 - bits - (at & 7))).ravel()
    at = (at >> 3).ravel()
    total = int(first[-1])
    buf = np.bincount(at, weights=word >> 16, minlength=total + 2) + np.bincount(at + 1, weights=(word >> 8) & 255, minlength=total + 2) + np.bincount(at + 2, weights=word & 255, minlength=total + 2)[: total + 2]
    buf = buf[:total].astype(np.uint8)
    buf[first[1:] - 1] |= ((1 << (n_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(buf == 255)
    raw = np.insert(buf, stuffed + 1, 0).tobytes()
    first = (first + np.searchsorted(stuffed, first)).tolist()
    return [HEAD + raw[a:b] + EOI for a, b in zip(first, first[1:])]


def write_avi(frames: list[bytes], rate: int = RATE, side: int = SIDE * 8) -> bytes:
    """A RIFF AVI file with one video stream of motion JPEG and an index."""
    sizes = np.array([len(f) for f in frames], np.uint32)
    padded = sizes + (sizes & 1)
    offsets = 4 + np.concatenate([[0], np.cumsum(padded[:-1] + 8)])
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = struct.unpack("<I", b"00dc")[0], 0x10, offsets, sizes
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, len(frames), 0, 1, int(sizes.max(initial=0)), side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), int(sizes.max(initial=0)), 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side, 0, 0, 0, 0)
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    movi = chunk(b"LIST", b"movi" + b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames of the first video stream, by the index (or, without one, by the movi list)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = float(RATE), None, None
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        at, end = todo.pop(0)
        while at + 8 <= min(end, len(data)):
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = (at + 8, at + 8 + size)
            elif kind == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif kind == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 8 + 20)
                if not scale or not per:
                    raise ValueError("no frame rate")
                rate = per / scale
            elif kind == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        index = index[(index[:, 0] >> 16) == struct.unpack("<H", b"dc")[0]]
        base = movi[0] if len(index) and int(index[0, 2]) < movi[0] else 0  # offsets count from movi or from the file's start
        starts, sizes = (index[:, 2].astype(np.int64) + base + 8).tolist(), index[:, 3].tolist()
        return rate, [data[a : a + n] for a, n in zip(starts, sizes)]
    frames, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] == b"dc":
            frames.append(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return rate, frames


class Header:
    """What the segments before the scan of a plain frame (one plane, own code tables, no restarts) say: size, the DC quantizer and the tables."""

    def __init__(self, jpeg: bytes):
        at, quant, dc, ac, blocks, q = 2, {}, {}, {}, None, 0
        while True:
            marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                _, height, width, n, _, _, q = struct.unpack(">BHHBBBB", body[:9])
                if n != 1:
                    raise ValueError("not a single plane")
                blocks = ((height + 7) // 8, (width + 7) // 8)
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = self._table(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDA:
                self.dc, self.ac = dc[body[2] >> 4], ac[body[2] & 15]
                break
            elif marker == 0xDD or 0xC1 <= marker <= 0xCF:
                raise ValueError("not a plain baseline frame")
        self.text, self.blocks, self.quant = jpeg[:at], blocks, quant[q]
        self.short = self._short()

    @staticmethod
    def _table(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
        out, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def _short(self) -> np.ndarray:
        """By the next 16 bits: (difference + 2048) << 8 | bits, for a block with no AC coefficient; 0 for others."""
        out = np.zeros(1 << 16, np.int32)
        ends = [k for k, symbol in self.ac.items() if symbol == 0]
        for (n, code), size in self.dc.items():
            for end_n, end in ends:
                bits = n + size + end_n
                if bits <= 16 and size <= 11:
                    low = np.arange(1 << size)
                    d = np.where(low >= (1 << size >> 1), low, low - (1 << size) + 1) if size else np.zeros(1, int)
                    start = ((((code << size) | low) << end_n) | end) << (16 - bits)
                    for a, x in zip(start.tolist(), d.tolist()):
                        out[a : a + (1 << (16 - bits))] = (x + 2048) << 8 | bits
        return out

    def slow(self, scan: bytes) -> np.ndarray:
        """DC differences of a scan with AC coefficients, bit by bit."""
        raw = scan.replace(b"\xff\x00", b"\xff")
        bits, n_bits, at = int.from_bytes(raw + b"\xff" * 4, "big"), len(raw) * 8 + 32, 0

        def take(n):
            nonlocal at
            at += n
            return (bits >> (n_bits - at)) & ((1 << n) - 1)

        def symbol(table):
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("bad code")

        out = []
        for _ in range(self.blocks[0] * self.blocks[1]):
            size = symbol(self.dc)
            low = take(size)
            out.append(low if not size or low >> (size - 1) else low - (1 << size) + 1)
            k = 1
            while k < 64:
                s = symbol(self.ac)
                if s == 0:
                    break
                k += (s >> 4) + 1
                take(s & 15)
        return np.array(out, np.int32)


#: Fixed values of the JPEG standard (annex K): numbers of codes by length, and the symbols that come before the others, which ascend.
STANDARD_DC = ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00")
STANDARD_AC = ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77")
STANDARD_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)
#: Row and column of the k-th coefficient, and the transform's basis.
ZIGZAG = np.array(sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))).T
BASIS = np.cos(np.pi / 16 * np.outer(np.arange(8), 2 * np.arange(8) + 1)) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _by_next(counts: bytes, symbols: bytes) -> list[int]:
    """length << 8 | symbol of the code at the head of any 16 bits; 0 where there is none."""
    out = np.zeros(1 << 16, np.int64)
    for (length, code), symbol in Header._table(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out.tolist()


@cache
def _standard() -> dict[tuple[int, int], list[int]]:
    """The standard's tables by class (DC 0, AC 1) and number."""
    every = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for k in (0, 1):
        first = list(bytes.fromhex(STANDARD_FIRST[k]))
        out[0, k] = _by_next(bytes.fromhex(STANDARD_DC[k]), bytes(range(12)))
        out[1, k] = _by_next(bytes.fromhex(STANDARD_AC[k]), bytes(first + sorted(set(every) - set(first))))
    return out


class Plane:
    """A component of a frame: sampling factors, quantizer, and coefficients by row and column of blocks."""

    def __init__(self, number: int, factors: int, quant: int):
        self.number, self.h, self.v, self.quant = number, factors >> 4, factors & 15, quant
        if not self.h or not self.v:
            raise ValueError("bad sampling factors")


def decode_jpeg(jpeg: bytes) -> list[np.ndarray]:
    """The planes of a baseline frame, each as large as the frame; a plane sampled more thinly has its samples repeated."""
    try:
        return _decode_jpeg(jpeg)
    except (IndexError, KeyError, StopIteration, TypeError, struct.error) as damage:
        raise ValueError("damaged frame") from damage


def _decode_jpeg(jpeg: bytes) -> list[np.ndarray]:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quants, tables, planes, interval, at, scans = {}, dict(_standard()), [], 0, 2, 0
    height = width = 0
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("damaged frame")
        marker = jpeg[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                kind = ">u2" if body[0] >> 4 else "u1"
                n = 128 if body[0] >> 4 else 64
                quants[body[0] & 15] = np.frombuffer(body, kind, 64, 1).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _by_next(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("only frames of 8 bits and known size are read")
            planes = [Plane(*body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
            most_h, most_v = max(p.h for p in planes), max(p.v for p in planes)
            if height * width > 256 * len(jpeg) * most_h * most_v:
                raise ValueError("damaged frame")  # a block takes two bits at least
            for p in planes:
                # whole units of blocks, and the blocks that a scan of this plane alone has
                p.grid = np.zeros((-(-height // (8 * most_v)) * p.v, -(-width // (8 * most_h)) * p.h, 64), np.int32)
                p.own = (-(-height * p.v // (8 * most_v)), -(-width * p.h // (8 * most_h)))
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            found = [(next(p for p in planes if p.number == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            used = [(p, tables[0, t >> 4], tables[1, t & 15]) for p, t in found]
            end = ENDS.search(jpeg, at)
            end = end.start() if end else len(jpeg)
            _scan(RESTARTS.split(jpeg[at:end]), used, interval)
            at, scans = end, scans + 1
    if not scans:
        raise ValueError("no scan")
    out = []
    for p in planes:
        blocks = np.zeros((*p.grid.shape[:2], 8, 8))
        blocks[:, :, ZIGZAG[0], ZIGZAG[1]] = p.grid * quants[p.quant]
        samples = np.clip(np.rint(BASIS.T @ blocks @ BASIS) + 128, 0, 255).astype(np.uint8)
        samples = samples.swapaxes(1, 2).reshape(samples.shape[0] * 8, -1)
        rows, columns = np.arange(height) * p.v // most_v, np.arange(width) * p.h // most_h
        out.append(samples[np.ix_(rows, columns)])
    return out


def _scan(parts: list[bytes], used: list[tuple[Plane, list[int], list[int]]], interval: int) -> None:
    """Coefficients of the planes of a scan, whose bytes are cut at its restarts."""
    if len(used) == 1:
        p, dc, ac = used[0]
        units = [[(p, dc, ac, r, c)] for r in range(p.own[0]) for c in range(p.own[1])]
    else:
        first = used[0][0]
        rows, columns = first.grid.shape[0] // first.v, first.grid.shape[1] // first.h
        units = [[(p, dc, ac, y * p.v + i, x * p.h + j) for p, dc, ac in used for i in range(p.v) for j in range(p.h)] for y in range(rows) for x in range(columns)]
    interval = interval or len(units)
    for part, start in zip(parts, range(0, len(units), interval)):
        raw = part.replace(b"\xff\x00", b"\xff")
        at, end, raw = 0, len(raw) * 8, raw + b"\xff" * 4
        last = dict.fromkeys((p for p, _, _ in used), 0)
        for p, dc, ac, r, c in (b for unit in units[start : start + interval] for b in unit):
            block, k, table = p.grid[r, c], 0, dc
            while k < 64:
                i = at >> 3
                got = table[((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (8 - (at & 7))) & 0xFFFF]
                if not got:
                    raise ValueError("bad code")
                at += got >> 8
                run, size = (0, got & 255) if table is dc else (got >> 4 & 15, got & 15)
                if table is ac and not size and run < 15:
                    break
                i = at >> 3
                low = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) >> (8 - (at & 7)) & 0xFFFF) >> (16 - size)
                at += size
                value = low if not size or low >> (size - 1) else low - (1 << size) + 1
                k += run
                if k == 0 and table is dc:
                    last[p] += value
                    value, table = last[p], ac
                block[k] = value
                k += 1
            if at > end:
                raise ValueError("a scan ends early")
    if len(parts) * interval < len(units):
        raise ValueError("a scan ends early")


def decode_frames(frames: list[bytes], headers: dict[bytes, Header]) -> list[np.ndarray | ValueError]:
    """Samples of each frame: one a block, row by row, where all blocks are constant, else the luma plane; or what is wrong with it.

    Plain frames with one header are decoded side by side.
    """
    groups: dict[bytes, list[int]] = {}
    last, other = None, []
    for i, f in enumerate(frames):
        if last is None or not f.startswith(last):
            last = next((h for h in headers if f.startswith(h)), None)
            if last is None:
                try:
                    made = Header(f)
                except (ValueError, IndexError, KeyError, TypeError, struct.error):
                    other.append(i)
                    continue
                last = made.text
                if len(headers) >= MOST_HEADERS:
                    headers.clear()
                headers[last] = made
        groups.setdefault(last, []).append(i)
    out: list[np.ndarray | None] = [None] * len(frames)
    for text, which in groups.items():
        h = headers.get(text) or Header(text)
        n = h.blocks[0] * h.blocks[1]
        scans = [frames[i][len(text) : -2 if frames[i].endswith(EOI) else None] for i in which]
        raw = np.frombuffer(b"".join(scans), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in scans])[:-1]])
        stuffed = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1
        raw = np.concatenate([np.delete(raw, stuffed), np.full(4, 255, np.uint8)]).astype(np.uint32)
        word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at = (starts - np.searchsorted(stuffed, starts)) * 8
        limit = len(word) - 1
        ends = np.concatenate([at[1:], [8 * (len(raw) - 4)]])
        diff = np.empty((n, len(which)), np.int32)
        odd = np.zeros(len(which), bool)
        for k in range(n):
            got = h.short[(word[np.minimum(at >> 3, limit)] >> (8 - (at & 7))) & 0xFFFF]
            diff[k] = got
            at += got & 255
        odd = (diff == 0).any(axis=0) | (at > ends)
        diff = (diff >> 8) - 2048
        mean = np.cumsum(diff, axis=0) * h.quant
        image = np.clip((mean + 4) // 8 + 128, 0, 255).astype(np.uint8)
        image = np.ascontiguousarray(image.T)
        for j, i in enumerate(which):
            out[i] = image[j]
        other += [which[j] for j in np.flatnonzero(odd)]
    for i in other:
        try:
            out[i] = decode_jpeg(frames[i])[0].ravel()
        except ValueError as wrong:
            out[i] = wrong
    return out


def shots(images: list[np.ndarray], counts: np.ndarray, reach=8, deviations=2.5, least=0.05) -> list[list[int]]:
    """First frames of the shots of each file. counts: frames of each file; images: all frames, file after file.

    The threshold of a frame adapts to the differences of up to `reach` frames on either side.
    """
    if not images:
        return [[] for _ in counts]
    sizes = np.array([len(x) for x in images], np.int64)
    frame = np.repeat(np.arange(len(images)), sizes)
    level = np.concatenate(images) // (256 // BINS)
    hist = np.bincount(frame * BINS + level, minlength=len(images) * BINS).reshape(-1, BINS) / sizes[:, None]
    diff = np.zeros(len(images))
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    ends = np.cumsum(counts)
    start = np.repeat(ends - counts, counts)
    end = np.repeat(ends, counts)
    i = np.arange(len(images))
    diff[i == start] = 0
    low, high = np.maximum(start + 1, i - reach), np.minimum(end, i + reach + 1)
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    n = np.maximum(high - low - 1, 1)
    mean = (s1[high] - s1[np.minimum(low, high)] - diff) / n
    var = np.maximum((s2[high] - s2[np.minimum(low, high)] - diff * diff) / n - mean * mean, 0)
    cut = (diff > np.maximum(least, np.round(mean + deviations * np.sqrt(var), 9))) & (i > start)
    where = np.flatnonzero(cut)
    bounds = np.searchsorted(where, np.concatenate([[0], ends]))
    first = ends - counts
    return [[0, *(where[a:b] - f).tolist()] if n else [] for a, b, f, n in zip(bounds, bounds[1:], first, counts)]


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def store(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, padded with 255, as an AVI file."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                raw = [t.encode() for t in texts]
                counts = [max(1, -(-len(r) // SAMPLES)) for r in raw]
                payload = b"".join(r.ljust(n * SAMPLES, b"\xff") for r, n in zip(raw, counts, strict=True))
                frames = encode_frames(np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES))
                ends = np.cumsum(counts).tolist()
                media = [write_avi(frames[e - n : e]) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    docs = docs.select(id_col, text_col)
    return docs.mapInArrow(run, f"{_kinds(docs, [id_col])}, n_bytes bigint, media binary")


def _read(data: bytes | None) -> tuple[float, list[bytes]] | ValueError:
    """read_avi with what is wrong as a value; an empty frame repeats the one before."""
    try:
        if data is None:
            raise ValueError("no file")
        rate, frames = read_avi(data)
    except (ValueError, struct.error) as wrong:
        return ValueError(str(wrong) if isinstance(wrong, ValueError) else "damaged file")
    for k in range(1, len(frames)):
        frames[k] = frames[k] or frames[k - 1]
    return rate, frames


def clips(stored: DataFrame, media_col="media") -> DataFrame:
    """stored with payload (the decoded samples), shots: array of (clip_no, start_s, end_s, frames), and error."""

    def of_files(files: list, headers: dict[bytes, Header]) -> list[tuple]:
        """payload, shots, error of each file."""
        frames = [[] if isinstance(x, ValueError) else x[1] for x in files]
        images = iter(decode_frames([f for of in frames for f in of], headers))
        images = [[next(images) for _ in of] for of in frames]
        errors = [x if isinstance(x, ValueError) else next((i for i in of if isinstance(i, ValueError)), None) for x, of in zip(files, images, strict=True)]
        good = [of for of, e in zip(images, errors, strict=True) if e is None]
        firsts = iter(shots([i for of in good for i in of], np.array([len(of) for of in good], np.int64)))
        out = []
        for x, of, e in zip(files, images, errors, strict=True):
            if e is not None:
                out.append((None, None, str(e)))
                continue
            first = next(firsts)
            found = [{"clip_no": k, "start_s": a / x[0], "end_s": b / x[0], "frames": b - a} for k, (a, b) in enumerate(zip(first, [*first[1:], len(of)]))]
            out.append((b"".join(i.tobytes() for i in of), found, None))
        return out

    def run(batches):
        headers: dict[bytes, Header] = {}
        kind = pa.list_(pa.struct([("clip_no", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
        for batch in batches:
            media = batch.column(columns.index(media_col))
            at = 0
            while at < batch.num_rows:
                files, n, to = [], 0, at
                while to < batch.num_rows and n < 2 * SLICE:
                    data = media[to].as_py()
                    files.append(_read(data))
                    n, to = n + len(data or b""), to + 1
                payload, found, errors = zip(*of_files(files, headers))
                yield pa.RecordBatch.from_arrays([*[x.slice(at, to - at) for x in batch.columns], pa.array(payload, pa.binary()), pa.array(found, kind), pa.array(errors, pa.string())], [*columns, "payload", "shots", "error"])
                at = to

    columns = [c for c in stored.columns if c == media_col or c.lower() not in ("payload", "shots", "error")]
    stored = stored.select(*[f"`{c}`" for c in columns])
    return stored.mapInArrow(run, f"{_kinds(stored, columns)}, payload binary, shots array<struct<clip_no:int,start_s:double,end_s:double,frames:int>>, error string")


def clip_rows(read_back: DataFrame, id_col="doc_id") -> DataFrame:
    """One row for each timed clip."""
    return read_back.select(id_col, F.inline("shots"))


def query(spark, sf_dir):
    out = clips(store(read(spark, sf_dir, "documents")))
    feature = F.concat(F.size("shots").cast("string"), F.lit(" shots: "), F.array_join(F.transform("shots", lambda c: c["frames"].cast("string")), ","))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.size("shots").alias("n_shots"),
    )
