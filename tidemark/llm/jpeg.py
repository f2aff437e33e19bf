"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which become full-resolution RGB tensors.

The decoder reads any Huffman-coded progressive JPEG of 8 bits and one or three components. Where a scan's codes all turn
out to have one size, it is decoded for all blocks at once; that is checked against the data, so the result is what bit-by-bit
decoding gives. The encoder stores bytes: 64 to a block, one in each quantised coefficient, over three components with halved
chroma, in scans of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in scan order: diagonals in turn, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _idct() -> np.ndarray:
    """The matrix that takes 64 coefficients in scan order to 64 samples."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.kron(one, one)[_zigzag()].astype(np.float32)


IDCT = _idct()
ZIGZAG = _zigzag()
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Component:
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that exist in scans of this component alone
    cols: int = 0
    coefficients: np.ndarray = field(default=None, repr=False)  # (rows and columns padded to whole MCUs, 64) in scan order


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray]
    comment: bytes
    h: int
    v: int
    mcu_rows: int
    mcu_cols: int

    def strips(self, mcus: int = 4096) -> Iterator[np.ndarray]:
        """The RGB tensor (rows, width, 3) uint8, a few rows of MCUs at a time."""
        step = max(1, mcus // self.mcu_cols)
        for r in range(0, self.mcu_rows, step):
            n = min(step, self.mcu_rows - r)
            planes = []
            for c in self.components.values():
                block = c.coefficients[r * c.v : (r + n) * c.v]
                samples = (block * self.tables[c.table]).astype(np.float32).reshape(-1, 64) @ IDCT
                plane = samples.reshape(n * c.v, -1, 8, 8).swapaxes(1, 2).reshape(n * c.v * 8, -1) + 128
                np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
                planes.append(plane.repeat(self.v // c.v, 0).repeat(self.h // c.h, 1))
            rows = min(n * self.v * 8, self.height - r * self.v * 8)
            planes = [p[:rows, : self.width] for p in planes]
            if len(planes) == 1:
                yield np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
                continue
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
            yield np.clip(np.rint(rgb, out=rgb), 0, 255, out=rgb).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        return np.concatenate(list(self.strips()))


class _Bits:
    """Bits of a scan, one byte each; zeros follow the end."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        self.raw = None

    def take(self, n: int) -> int:
        if self.raw is None:
            self.raw = self.bits.tobytes()
        out = 0
        for i in range(self.at, self.at + n):
            out = out << 1 | (self.raw[i] if i < len(self.raw) else 0)
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("a scan has bits that are no code")

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1

    def array(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.zeros(n - len(out), np.uint8)])


def _scan(data: list[bytes], interval: int, image: Image, ids: list[tuple[int, int, int]], dc: dict, ac: dict, ss: int, se: int, ah: int, al: int) -> None:
    """Adds one scan to the coefficients: data by restart interval."""
    comps = [(image.components[i], d, a) for i, d, a in ids]
    if len(comps) > 1:
        units = []  # the blocks of each MCU in turn
        for c, d, a in comps:
            b = np.arange(c.coefficients.shape[0] * c.coefficients.shape[1]).reshape(image.mcu_rows, c.v, image.mcu_cols, c.h)
            units.append(b.transpose(0, 2, 1, 3).reshape(image.mcu_rows * image.mcu_cols, -1))
        total = len(units[0])
    else:
        c = comps[0][0]
        units = [(np.arange(c.rows)[:, None] * c.coefficients.shape[1] + np.arange(c.cols)).reshape(-1, 1)]
        total = len(units[0])
    flat = [c.coefficients.reshape(-1, 64) for c, _, _ in comps]
    at = 0
    for part in data:
        n = min(interval or total, total - at)
        rows = [u[at : at + n] for u in units]
        at += n
        if ss == 0:
            if ah:
                _dc_refine(_Bits(part), flat, rows, al)
            else:
                _dc_first(part, flat, rows, [dc[d] for _, d, _ in comps], al)
        elif ah:
            _ac_refine(_Bits(part), flat[0], rows[0][:, 0], ac[comps[0][2]], ss, se, al)
        else:
            _ac_first(part, flat[0], rows[0][:, 0], ac[comps[0][2]], ss, se, al)


def _dc_first(part: bytes, flat: list[np.ndarray], rows: list[np.ndarray], codes: list[dict], al: int) -> None:
    n = sum(r.size for r in rows)
    if all(c.get((1, 0)) == 0 for c in codes) and 8 * len(part) >= n and not any(part[: n // 8]) and not (n % 8 and part[n // 8] >> (8 - n % 8)):
        return  # every difference is zero
    bits, last = _Bits(part), [0] * len(rows)
    for unit in range(len(rows[0])):
        for j, r in enumerate(rows):
            for block in r[unit]:
                last[j] += bits.signed(bits.symbol(codes[j]))
                flat[j][block, 0] = last[j] << al


def _dc_refine(bits: _Bits, flat: list[np.ndarray], rows: list[np.ndarray], al: int) -> None:
    width = sum(r.shape[1] for r in rows)
    got = bits.array(width * len(rows[0])).reshape(len(rows[0]), width)
    at = 0
    for f, r in zip(flat, rows, strict=True):
        f[r, 0] |= got[:, at : at + r.shape[1]].astype(np.int16) << al
        at += r.shape[1]


def _ac_first(part: bytes, flat: np.ndarray, rows: np.ndarray, codes: dict, ss: int, se: int, al: int) -> None:
    band = se - ss + 1
    if codes.get((1, 0)) == 7 and len(part) == len(rows) * band:  # a code of one bit and seven of its number: one byte
        x = np.frombuffer(part, np.uint8)
        if x.max(initial=0) < 128:
            x = x.reshape(len(rows), band).astype(np.int16)
            flat[rows, ss : se + 1] = np.where(x >= 64, x, x - 127) << al
            return
    bits, run = _Bits(part), 0
    for block in rows:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(bits.symbol(codes), 16)
            if s:
                k += r
                flat[block, k] = bits.signed(s) << al if k <= 63 else 0
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: _Bits, flat: np.ndarray, rows: np.ndarray, codes: dict, ss: int, se: int, al: int) -> None:
    one, i = 1 << al, 0

    def correct(block: int, ks: list[int]) -> None:
        for k in ks:
            if bits.take(1):
                flat[block, k] += one if flat[block, k] > 0 else -one

    while i < len(rows):
        block, k = rows[i], ss
        while k <= se:
            r, s = divmod(bits.symbol(codes), 16)
            if s == 0 and r < 15:  # this block's rest and whole blocks after it have corrections only
                run = (1 << r) + bits.take(r)
                if k > ss:
                    correct(block, [j for j in range(k, se + 1) if flat[block, j]])
                    run, i = run - 1, i + 1
                some = rows[i : i + run]
                band = flat[some, ss : se + 1]
                known = band != 0
                fix = np.zeros(band.shape, np.int16)
                fix[known] = bits.array(int(known.sum()))
                flat[some, ss : se + 1] = band + np.where(band > 0, fix, -fix) * one
                i += len(some) - 1
                break
            value = (one if bits.take(1) else -one) if s else 0
            while k <= se:
                if flat[block, k]:
                    correct(block, [k])
                elif r == 0:
                    if value:
                        flat[block, k] = value
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        i += 1


def decode(data: bytes) -> Image:
    """A progressive JPEG's coefficients after all its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, interval, image, comment = 2, 0, None, b""
    tables: dict[int, np.ndarray] = {}
    dc: dict[int, dict] = {}
    ac: dict[int, dict] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                tables[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                codes, code, k = {}, 0, 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                (ac if body[0] >> 4 else dc)[body[0] & 15] = codes
                body = body[k:]
        elif kind == 0xC2:
            height, width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            if body[0] != 8 or n not in (1, 3):
                raise ValueError("only 8 bits and one or three components are read")
            comps = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            h, v = max(c.h for c in comps.values()), max(c.v for c in comps.values())
            image = Image(width, height, comps, tables, comment, h, v, -(-height // (8 * v)), -(-width // (8 * h)))
            for c in comps.values():
                c.rows, c.cols = -(-(-(-height * c.v // v)) // 8), -(-(-(-width * c.h // h)) // 8)
                c.coefficients = np.zeros((image.mcu_rows * c.v, image.mcu_cols * c.h, 64), np.int16)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            n = body[0]
            ids = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            ss, se, a = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            raw = data[at:end]
            parts = re.split(rb"\xff[\xd0-\xd7]", raw) if interval else [raw]
            _scan([p.replace(b"\xff\x00", b"\xff") if b"\xff" in p else p for p in parts], interval, image, ids, dc, ac, ss, se, a >> 4, a & 15)
            at = end
    if image is None:
        raise ValueError("a JPEG without a frame")
    image.comment = comment
    return image


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(which: int, lengths: dict[int, bytes]) -> bytes:
    return _segment(0xC4, bytes([which, *(len(lengths.get(n, b"")) for n in range(1, 17))]) + b"".join(lengths[n] for n in sorted(lengths)))


def _packed(bits: np.ndarray) -> bytes:
    """Bits as scan data: ones fill the last byte, a zero byte follows each 0xFF."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    out = np.packbits(bits).tobytes()
    return out.replace(b"\xff", b"\xff\x00") if b"\xff" in out else out


def _sos(ids: tuple[int, ...], ss: int, se: int, ah: int, al: int, ac_table: int = 0) -> bytes:
    return _segment(0xDA, bytes([len(ids), *(x for i in ids for x in (i, ac_table)), ss, se, ah << 4 | al]))


_HEAD = _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
_TABLES = _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _table(0x00, {1: b"\0"}) + _table(0x10, {1: b"\x07"}) + _table(0x11, {4: bytes(n << 4 for n in range(15))})


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold a payload of a positive multiple of 64 bytes.

    A block's first byte is its DC coefficient, 0 to 255, sent bit by bit in scans of successive approximation. Any other byte is an
    AC coefficient of 128 to 255 in size (its low seven bits) and positive from 0x80 on; a first scan sends seven bits
    and a last one the lowest. The payload's length is the comment.
    """
    n = len(payload)
    if not n or n % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    need = -(-n // 384)
    cols = int(np.ceil(np.sqrt(need)))
    rows = -(-need // cols)
    t = rows * cols
    blocks = np.frombuffer(payload + bytes(t * 384 - n), np.uint8).reshape(6 * t, 64)
    out = [b"\xff\xd8", _HEAD, _segment(0xFE, str(n).encode()), _TABLES]
    out.append(_segment(0xC2, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    first = blocks[: 4 * t, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(t, 4)
    dc = np.concatenate([first, blocks[4 * t : 5 * t, :1], blocks[5 * t :, :1]], 1).reshape(-1)
    out += [_sos((1, 2, 3), 0, 0, 0, 8), _packed(np.zeros(6 * t, np.uint8))]
    planes = np.unpackbits(dc[:, None], axis=1)
    for k in range(8):
        out += [_sos((1, 2, 3), 0, 0, 8 - k, 7 - k), _packed(np.ascontiguousarray(planes[:, k]))]
    half = (blocks & 127) >> 1
    sent = half ^ np.where(blocks & 128, np.uint8(64), np.uint8(63))
    for i, (a, b) in enumerate(((0, 4 * t), (4 * t, 5 * t), (5 * t, 6 * t)), 1):
        for ss, se in ((1, 5), (6, 63)) if i == 1 else ((1, 63),):
            out += [_sos((i,), ss, se, 0, 1), sent[a:b, ss : se + 1].tobytes()]
    low = blocks & 1
    for i, (a, b) in enumerate(((0, 4 * t), (4 * t, 5 * t), (5 * t, 6 * t)), 1):
        bits = []
        for at in range(a, b, 32767):  # as many blocks as one run of ends takes
            run = min(32767, b - at)
            size = run.bit_length() - 1
            code = size << size | run - (1 << size)  # four bits of code, then the run's own
            bits += [np.array([code >> j & 1 for j in range(size + 3, -1, -1)], np.uint8), low[at : at + run, 1:].reshape(-1)]
        out += [_sos((i,), 1, 63, 1, 0, 1), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def restore(image: Image) -> bytes:
    """The payload that store() put into an image."""
    parts = []
    for c in image.components.values():
        x = c.coefficients.reshape(-1, 64)
        out = (np.abs(x) & 127).astype(np.uint8)
        out[x > 0] |= 128
        out[:, 0] = x[:, 0]
        parts.append(out)
    return np.concatenate(parts).tobytes()[: int(image.comment)]
