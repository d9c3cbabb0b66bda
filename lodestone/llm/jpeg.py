"""Progressive JPEG: coefficient arrays in and out, and full-resolution RGB tensors.

``encode`` writes quantised DCT coefficients as a progressive JPEG (spectral selection and successive
approximation, 4:2:0 chroma); ``decode`` accumulates the scans of any progressive Huffman-coded JPEG with
8-bit samples into coefficient arrays; ``rgb`` inverse-transforms them in numpy, upsamples chroma and
gives a height x width x 3 uint8 tensor.

Media columns keep a payload without loss as the format's own unit, the quantised coefficient: byte b is
stored as b if b > 127, else as b - 255, so that every coefficient has the size category 8. Each AC scan
then has one Huffman symbol and a constant number of bits a block, which both directions handle as
whole arrays; scans of other files go through the general bit reader.

Images of one size are made together, and images whose segments are equal are read together: an array's
first axis is the image, so that short texts share their calls of numpy.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, read, released, shared_dir

#: Row-major position of the k-th coefficient in zigzag order.
ZIGZAG = np.array([r * 8 + (s - r) for s in range(15) for r in (range(min(s, 7), max(0, s - 7) - 1, -1) if s % 2 == 0 else range(max(0, s - 7), min(s, 7) + 1))])
_UNZIGZAG = np.argsort(ZIGZAG)
#: Spectral bands of the AC scans.
BANDS = ((1, 5), (6, 63))
#: MCU columns of a media column's image.
MCU_COLUMNS = 2
STRIP = 256
#: Bytes of payload or media that are worked on together; a larger image is alone.
TOGETHER = 1 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuff(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


def _pad(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _huffman(table: int, lengths: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([table, *(len(lengths.get(i, [])) for i in range(1, 17))]) + bytes(s for i in sorted(lengths) for s in lengths[i]))


#: DC differences of size 0 to 11: 4-bit codes in order of size.
_DC_CODES = {4: list(range(12))}


def _dc_codes(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC differences as codes, and their numbers of bits, 15 at most."""
    size = np.ceil(np.log2(np.abs(d) + 1.0)).astype(np.int64)
    return (size << size) | np.where(d < 0, d + (1 << size) - 1, d), size + 4


def _spread(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits of codes of n bits, one code after another."""
    shift = n.astype(np.int16)[..., None] - np.arange(1, 16, dtype=np.int16)
    return ((code.astype(np.int16)[..., None] >> np.maximum(shift, 0)) & 1).astype(np.uint8)[shift >= 0]


def _dc_bits(values: np.ndarray) -> np.ndarray:
    return _spread(*_dc_codes(np.diff(values, prepend=0)))


def _dc_scan(d: np.ndarray) -> list[bytes]:
    """DC differences, a row an image, as the data of its scan: a row's last code are the ones that fill its last byte."""
    code, n = _dc_codes(d)
    fill = -n.sum(1, keepdims=True) % 8
    code, n = np.concatenate([code, (1 << fill) - 1], axis=1), np.concatenate([n, fill], axis=1)
    raw, ends = np.packbits(_spread(code, n)).tobytes(), (np.cumsum(n.sum(1)) // 8).tolist()
    return [_stuff(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _bit_scan(bits: np.ndarray) -> list[bytes]:
    """Rows of bits, one an image, each filled up with ones."""
    out = np.packbits(bits, axis=1)
    out[:, -1] |= (1 << -bits.shape[1] % 8) - 1
    return _byte_scan(out)


def _byte_scan(rows: np.ndarray) -> list[bytes]:
    raw, n = rows.tobytes(), rows.shape[1]
    return [_stuff(raw[i : i + n]) for i in range(0, len(raw), n)]


def _is_even8(blocks: np.ndarray) -> bool:
    a = np.abs(blocks[..., 1:])
    return bool(((a >= 128) & (a < 256)).all())


def encode(components: list[np.ndarray], width: int, height: int, sampling: list[tuple[int, int]]) -> bytes:
    """A progressive JPEG with all quantiser steps 1.

    components: for each one its blocks (rows, columns, 64 in row-major order), rows and columns whole MCUs;
    magnitudes of AC coefficients are from 128 to 255 and of DC ones at most 255.
    """
    return encode_all([c[None] for c in components], width, height, sampling)[0]


def encode_all(components: list[np.ndarray], width: int, height: int, sampling: list[tuple[int, int]]) -> list[bytes]:
    """Images of one size, each as `encode` makes it; the image is the first axis of the components."""
    head = [b"\xff\xd8", _segment(0xDB, b"\x00" + b"\x01" * 64)]
    head.append(_segment(0xC2, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
    head.append(_huffman(0x00, _DC_CODES))
    images = len(components[0])
    zig = [np.take(c, ZIGZAG, axis=-1).reshape(images, -1, 64) for c in components]
    if not all(map(_is_even8, zig)):
        raise ValueError("AC magnitudes must be from 128 to 255")
    zig = [z.astype(np.int16, copy=False) for z in zig]
    # DC, all components interleaved, without the last bit; then the last bits.
    per = [h * v for h, v in sampling]
    dc = [z[:, _interleaved(*c.shape[1:3], h, v), 0] for z, c, (h, v) in zip(zig, components, sampling, strict=True)]
    chosen = bytes([len(components)]) + b"".join(bytes([i + 1, 0]) for i in range(len(components)))
    heads = [b"".join([*head, _segment(0xDA, chosen + b"\x00\x00\x01")]), _segment(0xDA, chosen + b"\x00\x00\x10")]
    scans = [_dc_scan(_by_mcu([np.diff(x >> 1, prepend=0) for x in dc], per)), _bit_scan(_by_mcu([(x & 1).astype(np.uint8) for x in dc], per))]
    size = [np.abs(z).astype(np.uint8) for z in zig]
    table = _huffman(0x10, {1: [0x07]})
    for i, (z, m) in enumerate(zip(zig, size, strict=True)):
        first = (m >> 1) ^ np.where(z < 0, 127, 0).astype(np.uint8)  # 64 to 127 or, of negative ones, 127 less that: seven bits, after the one-bit code 0
        for lo, hi in BANDS:
            heads.append(table + _segment(0xDA, bytes([1, i + 1, 0x00, lo, hi, 0x01])))
            scans.append(_byte_scan(first[:, :, lo : hi + 1].reshape(images, -1)))
            table = b""
    table = _huffman(0x10, {1: [0x00]})
    for i, m in enumerate(size):
        for lo, hi in BANDS:
            fix = np.zeros((images, m.shape[1], hi - lo + 2), np.uint8)  # the one-bit end-of-band code, then a correction bit for each coefficient
            fix[:, :, 1:] = m[:, :, lo : hi + 1] & 1
            heads.append(table + _segment(0xDA, bytes([1, i + 1, 0x00, lo, hi, 0x10])))
            scans.append(_bit_scan(fix.reshape(images, -1)))
            table = b""
    return [b"".join([x for pair in zip(heads, one, strict=True) for x in pair] + [b"\xff\xd9"]) for one in zip(*scans, strict=True)]


def _interleaved(rows: int, cols: int, h: int, v: int) -> np.ndarray:
    """Block numbers in the order of an interleaved scan."""
    return np.arange(rows * cols).reshape(rows // v, v, cols // h, h).transpose(0, 2, 1, 3).ravel()


def _by_mcu(values: list[np.ndarray], per: list[int]) -> np.ndarray:
    """Rows of values of each component, in the order of an interleaved scan."""
    return np.concatenate([x.reshape(len(x), -1, n) for x, n in zip(values, per, strict=True)], axis=2).reshape(len(values[0]), -1)


class _Table(dict):
    """Symbols by (bits, code); sizes: the numbers of bits that occur."""

    sizes: list[int] = []


class _Bits:
    """Reads bits from entropy-coded data without stuffing."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.n, self.acc = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            chunk = self.data[self.at : self.at + 6]
            self.acc = (self.acc << 48) | int.from_bytes(chunk.ljust(6, b"\xff"), "big")
            self.at, self.n = self.at + 6, self.n + 48
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, table: _Table) -> int:
        code = had = 0
        for n in table.sizes:
            code = code << (n - had) | self.take(n - had)
            if (found := table.get((n, code))) is not None:
                return found
            had = n
        raise ValueError("no such Huffman code")


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class _Component:
    def __init__(self, number: int, h: int, v: int, table: int) -> None:
        self.number, self.h, self.v, self.table = number, h, v, table


#: The marker after entropy-coded data.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def _walk(data: bytes, at: int) -> tuple[list[tuple[int, bytes]], list[bytes], int]:
    """Of the image that begins there: its segments (marker and body), the entropy-coded data of its scans, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    segments, raws, at = [], [], at + 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            at += 2
            break
        n = data[at + 2] << 8 | data[at + 3]
        segments.append((marker, data[at + 4 : at + 2 + n]))
        at += 2 + n
        if marker == 0xDA:
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            raws.append(data[at:end])
            at = end
    return segments, raws, at


def decode(data: bytes) -> tuple[int, int, list[np.ndarray], list[tuple[int, int]], list[np.ndarray]]:
    """Width, height, coefficients of each component (rows, columns, 64 row-major; rows and columns fill whole MCUs), sampling factors, quantiser steps (64 row-major each)."""
    segments, raws, _ = _walk(data, 0)
    width, height, comps, sampling, steps = decode_all(segments, [raws])
    return width, height, [c[0] for c in comps], sampling, steps


def decode_all(segments: list[tuple[int, bytes]], raws: list[list[bytes]]) -> tuple[int, int, list[np.ndarray], list[tuple[int, int]], list[np.ndarray]]:
    """Of images with the same segments, given by the data of their scans: as `decode`, the image is the first axis of the coefficients."""
    quant, huff, comps, restart = {}, {}, [], 0
    width = height = 0
    coef: dict[int, np.ndarray] = {}
    scans = zip(*raws, strict=True)
    for marker, body in segments:
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                steps = np.zeros(64, np.int64)
                steps[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quant[k], body = steps, body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts, table, code, k = body[1:17], _Table(), 0, 17
                for size, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[size, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                table.sizes = [i for i, c in enumerate(counts, 1) if c]
                huff[body[0]], body = table, body[k:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            precision, height, width, count = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of 8 bits are read only")
            comps = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            wide, high = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in comps:
                coef[c.number] = np.zeros((len(raws), high * c.v, wide * c.h, 64), np.int32)
                c.used = (-(-(-(-height * c.v // vmax)) // 8), -(-(-(-width * c.h // hmax)) // 8))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded JPEG is read")
        elif marker == 0xDA:
            k = body[0]
            chosen = [(next(c for c in comps if c.number == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(k)]
            lo, hi, approx = body[1 + 2 * k : 4 + 2 * k]
            _scan(next(scans), chosen, lo, hi, approx >> 4, approx & 15, huff, coef, restart)
    return width, height, [np.take(coef[c.number], _UNZIGZAG, axis=-1) for c in comps], [(c.h, c.v) for c in comps], [quant[c.table] for c in comps]


def _scan(raws: tuple[bytes, ...], chosen: list, lo: int, hi: int, high: int, low: int, huff: dict, coef: dict, restart: int) -> None:
    """One scan of each image into the coefficient arrays (zigzag order)."""
    if lo and not restart and _even_scan(raws, chosen[0], lo, hi, high, low, huff, coef):
        return
    if not lo and not restart and high:
        return _dc_fix(raws, chosen, low, coef)
    if not lo and not restart and _dc_first(raws, chosen, low, huff, coef):
        return
    for i, raw in enumerate(raws):
        _scan_bits(raw, chosen, lo, hi, high, low, huff, {k: c[i] for k, c in coef.items()}, restart)


def _scan_bits(raw: bytes, chosen: list, lo: int, hi: int, high: int, low: int, huff: dict, coef: dict, restart: int) -> None:
    """Any scan of one image, bit by bit."""
    parts = [raw] if not restart else _split_restarts(raw)
    if len(chosen) > 1:
        units = _mcu_units(chosen, coef)
    else:
        c, dc, ac = chosen[0]
        cols = coef[c.number].shape[1]
        units = [[(c, dc, ac, r * cols + x)] for r in range(c.used[0]) for x in range(c.used[1])]
    step = restart or len(units)
    for part, start in zip(parts, range(0, max(1, len(units)), max(1, step)), strict=False):
        bits, last, run = _Bits(part.replace(b"\xff\x00", b"\xff")), {}, 0
        for unit in units[start : start + step]:
            for c, dc, ac, i in unit:
                block = coef[c.number].reshape(-1, 64)[i]
                if not lo:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        size = bits.symbol(huff[dc])
                        last[c.number] = last.get(c.number, 0) + _extend(bits.take(size) if size else 0, size)
                        block[0] = last[c.number] << low
                elif not high:
                    run = _ac_first(bits, huff[0x10 | ac], block, lo, hi, low, run)
                else:
                    run = _ac_refine(bits, huff[0x10 | ac], block, lo, hi, low, run)


def _mcu_units(chosen: list, coef: dict) -> list[list[tuple]]:
    orders = [_interleaved(*coef[c.number].shape[:2], c.h, c.v).reshape(-1, c.h * c.v).tolist() for c, _, _ in chosen]
    return [[(c, dc, ac, i) for (c, dc, ac), order in zip(chosen, orders, strict=True) for i in order[m]] for m in range(len(orders[0]))]


def _split_restarts(raw: bytes) -> list[bytes]:
    parts, start, at = [], 0, 0
    while (at := raw.find(b"\xff", at)) >= 0:
        if 0xD0 <= raw[at + 1] <= 0xD7:
            parts.append(raw[start:at])
            start = at + 2
        at += 2
    return [*parts, raw[start:]]


def _plain(raws: tuple[bytes, ...], n: int) -> np.ndarray | None:
    """The first n bytes of each, without stuffing; None if one has fewer."""
    found = [r.replace(b"\xff\x00", b"\xff")[:n] for r in raws]
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(raws), n) if all(len(x) == n for x in found) else None


def _set_dc(values: np.ndarray, chosen: list, coef: dict, put: Callable[[np.ndarray, object, np.ndarray], None]) -> None:
    """Gives the values of a DC scan (a row an image, in the scan's order) to `put` by component: the coefficients, the blocks' places among them, and the blocks' values."""
    if len(chosen) == 1:
        c = chosen[0][0]
        put(coef[c.number][:, : c.used[0], : c.used[1], 0], ..., values.reshape(len(values), *c.used))
        return
    sizes = [c.h * c.v for c, _, _ in chosen]
    table, at = values.reshape(len(values), -1, sum(sizes)), 0
    for (c, _, _), n in zip(chosen, sizes, strict=True):
        x = coef[c.number]
        put(x.reshape(len(x), -1, 64)[:, :, 0], (slice(None), _interleaved(*x.shape[1:3], c.h, c.v)), table[:, :, at : at + n].reshape(len(x), -1))
        at += n


def _dc_blocks(chosen: list, coef: dict) -> int:
    """Blocks of an image in a DC scan."""
    if len(chosen) == 1:
        return chosen[0][0].used[0] * chosen[0][0].used[1]
    return sum(coef[c.number].shape[1] * coef[c.number].shape[2] for c, _, _ in chosen)


def _dc_fix(raws: tuple[bytes, ...], chosen: list, low: int, coef: dict) -> None:
    """A DC refinement scan: one bit a block."""
    n = _dc_blocks(chosen, coef)
    if (raw := _plain(raws, -(-n // 8))) is None:
        raise ValueError("a scan ends early")

    def put(x: np.ndarray, where: object, values: np.ndarray) -> None:
        x[where] |= values.astype(np.int32) << low

    _set_dc(np.unpackbits(raw, axis=1)[:, :n], chosen, coef, put)


@lru_cache(16)
def _lookup(codes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and bits of their codes, by the next 16 bits; no bits where there is no code."""
    symbols, lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for (n, code), symbol in codes:
        at = slice(code << (16 - n), (code + 1) << (16 - n))
        symbols[at], lengths[at] = symbol, n
    return symbols, lengths


def _dc_first(raws: tuple[bytes, ...], chosen: list, low: int, huff: dict, coef: dict) -> bool:
    """A first DC scan with one table: where the next code would begin is worked out for every bit at once, so that only these steps are taken one by one. False if it isn't such a scan or has odd codes."""
    n = _dc_blocks(chosen, coef)
    if not n or len({dc for _, dc, _ in chosen}) > 1:
        return False
    symbols, lengths = _lookup(tuple(huff[chosen[0][1]].items()))
    data = [r.replace(b"\xff\x00", b"\xff") for r in raws]
    b = np.frombuffer(b"".join(data) + b"\xff" * 8, np.uint8).astype(np.uint64)
    ahead = np.zeros(len(b) - 7, np.uint64)  # the eight bytes from each one on
    for i in range(8):
        ahead |= b[i : len(b) - 7 + i] << np.uint64(56 - 8 * i)
    next16 = ((ahead[:, None] >> np.arange(48, 40, -1, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).ravel()
    follows = (np.arange(len(next16), dtype=np.int32) + lengths[next16] + symbols[next16]).tolist()
    starts, end = [], 0
    for x in data:
        p, end = 8 * end, end + len(x)
        for _ in range(n):
            starts.append(p)
            p = follows[p] if p < 8 * end else p
        if p > 8 * end or starts[-1] >= 8 * end:
            return False
    at = np.array(starts, np.int64).reshape(len(data), n)
    size, length = symbols[next16[at]].astype(np.int64), lengths[next16[at]]
    if size.max() > 16 or not length.all():
        return False
    shift = (64 - (at & 7) - length - size).astype(np.uint64)
    extra = (ahead[at >> 3] >> shift).astype(np.int64) & ((1 << size) - 1)
    d = extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0)

    def put(x: np.ndarray, where: object, values: np.ndarray) -> None:
        x[where] = (np.cumsum(values.reshape(len(values), -1), axis=1) << low).reshape(values.shape)

    _set_dc(d, chosen, coef, put)
    return True


def _even_scan(raws: tuple[bytes, ...], one: tuple, lo: int, hi: int, high: int, low: int, huff: dict, coef: dict) -> bool:
    """An AC scan whose table has one one-bit code, as whole arrays; False if it isn't such a scan."""
    c, _, ac = one
    table, n = huff[0x10 | ac], hi - lo + 1
    if list(table) != [(1, 0)]:
        return False
    symbol = table[1, 0]
    part = coef[c.number][:, : c.used[0], : c.used[1], lo : hi + 1]
    count = part.shape[1] * part.shape[2]
    if not high and symbol >> 4 == 0 and 0 < symbol < 16:  # no zeros before any coefficient, all of one size
        bits = 1 + symbol
        if (raw := _plain(raws, -(-count * n * bits // 8))) is None:
            return False
        if bits == 8:
            v = raw.astype(np.int32)
        else:
            v = np.unpackbits(raw, axis=1)[:, : count * n * bits].reshape(len(raw), -1, bits).astype(np.int32) @ (1 << np.arange(bits - 1, -1, -1))
        v -= ((1 << symbol) - 1) * (v >> (symbol - 1) == 0)
        part[:] = (v * (1 << low)).reshape(part.shape)
        return True
    if high and symbol == 0 and part.all():  # each band ends at once: a correction bit for each coefficient
        if (raw := _plain(raws, -(-count * (n + 1) // 8))) is None:
            return False
        fix = np.unpackbits(raw, axis=1)[:, : count * (n + 1)].reshape(*part.shape[:3], n + 1)[..., 1:].astype(np.int32) << low
        part += np.where(part < 0, -fix, fix)
        return True
    return False


def _ac_first(bits: _Bits, table: dict, block: np.ndarray, lo: int, hi: int, low: int, run: int) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        s = bits.symbol(table)
        r, size = s >> 4, s & 15
        if size:
            k += r
            v = _extend(bits.take(size), size)
            block[k] = v << low if v > 0 else -(-v << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) + (bits.take(r) if r else 0) - 1
    return 0


def _ac_refine(bits: _Bits, table: dict, block: np.ndarray, lo: int, hi: int, low: int, run: int) -> int:
    k, step = lo, 1 << low

    def fix(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & step:
            block[k] += step if block[k] > 0 else -step

    if not run:
        while k <= hi:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif r < 15:
                run = (1 << r) + (bits.take(r) if r else 0)
                break
            while k <= hi:
                if block[k]:
                    fix(k)
                elif r == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run:
        while k <= hi:
            if block[k]:
                fix(k)
            k += 1
        run -= 1
    return run


def _basis() -> np.ndarray:
    """The 8x8 inverse DCT as a 64x64 matrix of integers scaled by 4096, so that sums are exact in float64 in any order."""
    x, u = np.mgrid[:8, :8]
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    one[:, 0] = 1 / np.sqrt(8)
    return np.round(np.kron(one, one).T * 4096)


_IDCT = _basis()
#: Half a sample and the shift of levels, in the basis's scale.
_LEVEL = 128.5 * 4096
#: Up to this coefficient all sums are below 2^24 and exact in float32 too.
_EXACT32 = int((2**24 - _LEVEL) / np.abs(_IDCT).sum(0).max())


def samples(blocks: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Blocks (.., rows, columns, 64) as 8-bit samples (.., 8 rows, 8 columns)."""
    *images, r, c, _ = blocks.shape
    flat = blocks.reshape(-1, 64)
    out = np.empty((len(flat), 64), np.uint8)
    for i in range(0, len(flat), 4096):
        x = flat[i : i + 4096] * steps
        kind = np.float32 if max(x.max(), -x.min()) <= _EXACT32 else np.float64
        y = x.astype(kind) @ _IDCT.astype(kind)
        y += kind(_LEVEL)
        y *= kind(1 / 4096)
        out[i : i + 4096] = np.clip(y, 0, 255, out=y)
    return np.swapaxes(out.reshape(-1, r, c, 8, 8), 2, 3).reshape(*images, 8 * r, 8 * c)


def rgb(data: bytes) -> np.ndarray:
    """The full-resolution RGB tensor: chroma is repeated to the size of luma."""
    width, height, comps, sampling, steps = decode(data)
    return to_rgb(width, height, comps, sampling, steps)


def to_rgb(width: int, height: int, comps: list[np.ndarray], sampling: list[tuple[int, int]], steps: list[np.ndarray]) -> np.ndarray:
    """Coefficients (.., rows, columns, 64) as RGB (.., height, width, 3)."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)

    def grown(x: np.ndarray, h: int, v: int) -> np.ndarray:
        *n, r, c = x.shape
        by, bx = vmax // v, hmax // h
        return np.broadcast_to(x[..., :, None, :, None], (*n, r, by, c, bx)).reshape(*n, r * by, c * bx)[..., :height, :width]

    planes = [samples(b, q) for b, q in zip(comps, steps, strict=True)]
    if len(planes) == 1:
        return np.repeat(grown(planes[0], *sampling[0])[..., None], 3, -1)
    y, (cb, cr) = grown(planes[0], *sampling[0]).astype(np.int16), (p.astype(np.int32) - 128 for p in planes[1:3])
    size = sampling[1]
    if size != sampling[2]:
        cb, cr, size = grown(cb, *sampling[1]), grown(cr, *sampling[2]), (hmax, vmax)
    out = np.empty((*y.shape, 3), np.uint8)
    for i, v in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[..., i] = np.clip(y + grown(((v + 32768) >> 16).astype(np.int16), *size), 0, 255)
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\x00" * (64 * max(1, -(-len(raw) // 64)) - len(raw)), len(raw)


@lru_cache(64)
def _layout(rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which payload block stands where, for an image of so many MCU rows: six blocks an MCU, 4 of luma, 1 of each chroma."""
    n = np.arange(6 * rows * MCU_COLUMNS).reshape(rows, MCU_COLUMNS, 6)
    y = n[:, :, :4].reshape(rows, MCU_COLUMNS, 2, 2).transpose(0, 2, 1, 3).reshape(2 * rows, 2 * MCU_COLUMNS)
    return y, n[:, :, 4], n[:, :, 5]


def _frames(blocks: int) -> Iterator[int]:
    """MCU rows of each image of a payload: JPEG has at most 65,535 lines, so a long payload has several images."""
    rows = -(-blocks // (6 * MCU_COLUMNS))
    while rows > 0:
        yield min(rows, 4000)
        rows -= 4000


def _together(parts: list, size: Callable[[object], int]) -> Iterator[list]:
    """Parts that are worked on in one go."""
    some, total = [], 0
    for x in parts:
        if some and total + size(x) > TOGETHER:
            yield some
            some, total = [], 0
        some.append(x)
        total += size(x)
    if some:
        yield some


def store(data: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as one progressive JPEG after another, with the payload's length in front in a comment of each."""
    return store_all([data])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Payloads as `store` has them; images of one size are made together."""
    by_rows: dict[int, list[tuple[int, int]]] = {}
    made: list[dict[int, bytes]] = [{} for _ in payloads]
    for k, data in enumerate(payloads):
        at = 0
        for rows in _frames(len(data) // 64):
            by_rows.setdefault(rows, []).append((k, at))
            made[k][at] = b""
            at += 64 * 6 * rows * MCU_COLUMNS
    for rows, parts in by_rows.items():
        size = 64 * 6 * rows * MCU_COLUMNS
        for some in _together(parts, lambda _, n=size: n):
            b = np.frombuffer(b"".join(payloads[k][at : at + size].ljust(size, b"\x00") for k, at in some), np.uint8).reshape(len(some), -1, 64)
            units = b - np.int16(255) * (b < 128)
            images = encode_all([units[:, i] for i in _layout(rows)], 16 * MCU_COLUMNS, 16 * rows, [(2, 2), (1, 1), (1, 1)])
            for (k, at), one in zip(some, images, strict=True):
                made[k][at] = one[:2] + _segment(0xFE, struct.pack(">Q", len(payloads[k]))) + one[2:]
    return [b"".join(x.values()) for x in made]


def restore(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload and the RGB tensors, from the stored bytes alone."""
    return restore_all([media])[0]


def restore_all(stored: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """Media as `restore` has them; images whose segments are equal but for comments are read together."""
    alike: dict[tuple, list[tuple[int, int, list[bytes], int]]] = {}
    lengths, found = [], []
    for k, media in enumerate(stored):
        at, n, images = 0, 0, 0
        while at < len(media):
            start = at
            segments, raws, at = _walk(media, at)
            n = struct.unpack(">Q", segments[0][1])[0]
            alike.setdefault(tuple(s for s in segments if s[0] != 0xFE), []).append((k, images, raws, at - start))
            images += 1
        lengths.append(n)
        found.append([(b"", None)] * images)
    for segments, parts in alike.items():
        for some in _together(parts, lambda x: x[3]):
            width, height, comps, sampling, steps = decode_all(segments, [raws for _, _, raws, _ in some])
            tensors = to_rgb(width, height, comps, sampling, steps)
            units = np.empty((len(some), sum(c.shape[1] * c.shape[2] for c in comps), 64), np.uint8)
            for where, c in zip(_layout(height // 16), comps, strict=True):
                units[:, where] = c + 255 * (c < 0)
            for (k, image, _, _), u, t in zip(some, units, tensors, strict=True):
                found[k][image] = (u.tobytes(), t)
    return [(b"".join(p for p, _ in x)[:n], [t for _, t in x]) for x, n in zip(found, lengths, strict=True)]


def feature(tensors: list[np.ndarray]) -> str:
    """height x width : mean of R, G, B : crc32 of the tensors."""
    crc = 0
    for t in tensors:
        crc = zlib.crc32(np.ascontiguousarray(t), crc)
    n = sum(t.shape[0] * t.shape[1] for t in tensors)
    sums = sum(t.reshape(t.shape[0], -1).sum(0, dtype=np.int64).reshape(-1, 3).sum(0) for t in tensors).tolist()
    return f"{sum(t.shape[0] for t in tensors)}x{tensors[0].shape[1]}:{','.join(f'{s / n:.4f}' for s in sums)}:{crc:08x}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, zeros up to a positive multiple of 64, as progressive JPEG. A null text is empty."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STRIP):
                c = b.slice(i, STRIP)
                made = [payload(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(store_all([p for p, _ in made]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, images array<struct<height:int,width:int,rgb:binary>>"


def _images_column(found: list[list[np.ndarray]]) -> pa.Array:
    flat = [t for x in found for t in x]
    columns = [pa.array([t.shape[0] for t in flat], pa.int32()), pa.array([t.shape[1] for t in flat], pa.int32()), pa.array([t.tobytes() for t in flat], pa.binary())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(columns, ["height", "width", "rgb"]))


def describe(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back: digests of payload and media, a feature of the RGB tensors, and the tensors themselves (row-major, 3 channels), one for each image."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in _OUT.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for i in range(0, b.num_rows, STRIP):
                first = i
                for some in _together([x.as_py() for x in b.column(2).slice(i, STRIP)], len):
                    found = restore_all(some)
                    rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(t)) for m, (p, t) in zip(some, found, strict=True)]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), b.column(1).slice(first, len(rows)), *columns, _images_column([t for _, t in found])], names=names)
                    first += len(rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _OUT)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder; what is returned comes from reading that table. A null text is empty, equal texts have equal values, rows keep null and equal ids."""
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    to_media(read(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return describe(spark.read.parquet(path))
