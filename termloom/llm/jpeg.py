"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, an inverse
transform gives the planes, chroma is upsampled and the result is an RGB tensor.

The decoder takes any 8-bit progressive file with one to three components (spectral
selection, successive approximation, restart intervals, any Huffman tables). Parts of
a scan that are plain bit fields (refinement bits, end-of-band runs, tables of a single
code) are read as arrays; only Huffman symbols of varying length are read one by one.

A byte string is kept as the *quantised coefficients* of an image, JPEG's own lossless
unit: byte b is the coefficient b (b >= 128) or b - 255 (b < 128), whose eight
magnitude bits are b. The first AC scans carry its upper seven bits, the refinement
scans its last.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed by the format: index in natural order of each zigzag position.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i % 8 if s % 2 == 0 else i // 8)))
MCU_COLUMNS = 3
#: Payload bytes of one image at most; longer ones take several images.
TILE = 576 * 1024


def _basis() -> np.ndarray:
    """64 x 64: row k gives the samples of the k-th zigzag coefficient."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)[ZIGZAG]


BASIS = _basis()


# ---------------------------------------------------------------- reading


class Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        self.data, self.at = raw.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def window(self) -> int:
        """The next 32 bits."""
        p = self.at >> 3
        return int.from_bytes(self.data[p : p + 5], "big") >> (8 - (self.at & 7)) & 0xFFFFFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.window() >> (32 - n)
        self.at += n
        return v

    def symbol(self, table: list) -> int:
        length, value = table[self.window() >> 16]
        if not length:
            raise ValueError("no such Huffman code")
        self.at += length
        return value

    def array(self, n: int) -> np.ndarray:
        p, off = self.at >> 3, self.at & 7
        got = np.unpackbits(np.frombuffer(self.data, np.uint8, min((off + n + 7) // 8, len(self.data) - p), p))[off : off + n]
        if len(got) < n:
            raise ValueError("a scan ends early")
        self.at += n
        return got


@lru_cache(maxsize=256)
def lookup(spec: bytes) -> list:
    """(length, symbol) for every 16-bit window, from the 16 counts and the symbols."""
    table: list = [(0, 0)] * 65536
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = [(length, spec[at])] * (1 << (16 - length))
            code += 1
            at += 1
        code <<= 1
    return table


def single_code(spec: bytes) -> tuple[int, int] | None:
    """(length, symbol) of a table with one code only."""
    return next((n + 1, spec[16]) for n in range(16) if spec[n]) if sum(spec[:16]) == 1 else None


def extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks, padded to whole MCUs
    cols: int = 0
    own_rows: int = 0  # blocks that hold samples
    own_cols: int = 0
    coefs: np.ndarray = field(default=None)


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    restart: int = 0


@lru_cache(maxsize=512)
def _order(grids: tuple[tuple[int, int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(component, block) of every block of an interleaved scan, in order. grids: (h, v, rows, cols)."""
    h, v, rows, cols = grids[0]
    my, mx = rows // v, cols // h
    comp, block = [], []
    y, x = np.arange(my)[:, None], np.arange(mx)[None, :]
    for c, (h, v, _, cols) in enumerate(grids):
        for dy in range(v):
            for dx in range(h):
                comp.append(np.full((my, mx), c))
                block.append((y * v + dy) * cols + x * h + dx)
    return np.stack(comp, -1).reshape(-1), np.stack(block, -1).reshape(-1)


def _scan_blocks(frame: Frame, parts: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
    """(component, block) of each block of a scan and the blocks of one restart unit."""
    if len(parts) == 1:
        c = parts[0]
        block = (np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)[None, :]).reshape(-1)
        return np.zeros(len(block), np.int64), block, 1
    comp, block = _order(tuple((c.h, c.v, c.rows, c.cols) for c in parts))
    return comp, block, sum(c.h * c.v for c in parts)


def _dc_first(bits: Bits, comp, block, parts, tables, al: int) -> None:
    pred, out = [0] * len(parts), []
    data, at = bits.data, bits.at
    luts = [lookup(t) for t in tables]
    for c in comp.tolist():
        p = at >> 3
        w = int.from_bytes(data[p : p + 5], "big") >> (8 - (at & 7)) & 0xFFFFFFFF
        length, size = luts[c][w >> 16]
        if not length:
            raise ValueError("no such Huffman code")
        at += length + size
        if size:
            d = w >> (32 - length - size) & ((1 << size) - 1)
            pred[c] += d if d >> (size - 1) else d - (1 << size) + 1
        out.append(pred[c])
    bits.at = at
    got = np.array(out, np.int32) << al
    for c, part in enumerate(parts):
        mine = comp == c
        part.coefs[block[mine], 0] = got[mine]


def _dc_refine(bits: Bits, comp, block, parts, al: int) -> None:
    got = bits.array(len(comp)).astype(np.int32) << al
    for c, part in enumerate(parts):
        mine = comp == c
        part.coefs[block[mine], 0] |= got[mine]


def _ac_first(bits: Bits, block, part: Component, spec: bytes, ss: int, se: int, al: int) -> None:
    one = single_code(spec)
    if one and one[1] >> 4 == 0 and one[1] & 15:  # every coefficient: the code, then its bits
        length, size = one
        width = se - ss + 1
        got = bits.array(len(block) * width * (length + size)).reshape(-1, length + size)
        if size + length == 8 and not got[:, :length].any():
            value = np.packbits(got, axis=1)[:, 0].astype(np.int32)
        else:
            value = got[:, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1) << al
        part.coefs[block, ss : se + 1] = value.reshape(-1, width)
        return
    table, run = lookup(spec), 0
    for b in block.tolist():
        if run:
            run -= 1
            continue
        k, row = ss, part.coefs[b]
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                row[k] = extend(bits.take(s), s) << al
                k += 1
            elif r < 15:
                run = (1 << r) + bits.take(r) - 1
                break
            else:
                k += 16


def _correct(bits: Bits, part: Component, blocks: np.ndarray, lo: int, se: int, step: int) -> None:
    """One correction bit for each coefficient that is not zero, block by block."""
    sub = part.coefs[blocks, lo : se + 1]
    there = sub != 0
    add = np.zeros(sub.shape, np.int32)
    add[there] = bits.array(int(there.sum()))
    part.coefs[blocks, lo : se + 1] = sub + np.sign(sub) * add * step


def _ac_refine(bits: Bits, block, part: Component, spec: bytes, ss: int, se: int, al: int) -> None:
    table, step, i = lookup(spec), 1 << al, 0
    while i < len(block):
        row, k, run = part.coefs[block[i]], ss, 0
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                new = step if bits.take(1) else -step
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= se:
                if row[k]:
                    if bits.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif r:
                    r -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        if run:
            if k > ss:  # the rest of this block, then whole blocks
                _correct(bits, part, block[i : i + 1], k, se, step)
                i, run = i + 1, run - 1
            if run:
                _correct(bits, part, block[i : i + run], ss, se, step)
                i += run
        else:
            i += 1


#: A larger frame is refused: a few damaged bytes could ask for 50 GB.
MOST_PIXELS = 1 << 27


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from ``at`` on (cut at restart markers) and where they end."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no marker ends the scan")
        kind = data[at + 1]
        if kind == 0:
            at += 2
            continue
        out.append(data[start:at])
        if not 0xD0 <= kind <= 0xD7:
            return out, at
        at += 2
        start = at


def read_frame(data: bytes) -> Frame:
    """Decode a progressive JPEG to its quantised coefficients (zigzag order)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, frame, quants, huff, comments, restart = 2, None, {}, {}, [], 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quants[which] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[n + 1 :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huff[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not width or not height:
                raise ValueError("only 8-bit frames of known size")
            if width * height > MOST_PIXELS:
                raise ValueError("the frame is too large")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c in parts:
                c.rows, c.cols = my * c.v, mx * c.h
                c.own_cols, c.own_rows = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
                c.coefs = np.zeros((c.rows * c.cols, 64), np.int32)
            frame = Frame(width, height, parts)
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comments.append(body)
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            by_id = {c.ident: c for c in frame.components}
            parts = [by_id[body[1 + 2 * i]] for i in range(n)]
            dc, ac = [body[2 + 2 * i] >> 4 for i in range(n)], [body[2 + 2 * i] & 15 for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            segments, at = _segments(data, at)
            comp, block, unit = _scan_blocks(frame, parts)
            span = restart * unit if restart else len(block)
            for i, raw in enumerate(segments):
                bits = Bits(raw)
                cs, bs = comp[i * span : (i + 1) * span], block[i * span : (i + 1) * span]
                if ss == 0 and ah == 0:
                    _dc_first(bits, cs, bs, parts, [huff[t] for t in dc], al)
                elif ss == 0:
                    _dc_refine(bits, cs, bs, parts, al)
                elif ah == 0:
                    _ac_first(bits, bs, parts[0], huff[16 + ac[0]], ss, se, al)
                else:
                    _ac_refine(bits, bs, parts[0], huff[16 + ac[0]], ss, se, al)
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("only progressive Huffman frames")
    if frame is None:
        raise ValueError("no frame")
    frame.quants, frame.comments, frame.restart = quants, comments, restart
    return frame


def to_rgb(frame: Frame) -> np.ndarray:
    """height x width x 3 samples of a frame; chroma is replicated to full resolution."""
    hm, vm = max(c.h for c in frame.components), max(c.v for c in frame.components)
    planes = []
    for c in frame.components:
        samples = (c.coefs * frame.quants[c.quant]).astype(np.float64) @ BASIS
        # the small bias settles ties alike whatever the order of summation
        samples = np.clip(np.floor(samples + (128.5 + 1e-6)), 0, 255).astype(np.int32)
        plane = samples.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
        if c.v < vm:
            plane = np.repeat(plane, vm // c.v, axis=0)
        if c.h < hm:
            plane = np.repeat(plane, hm // c.h, axis=1)
        planes.append(plane[: frame.height, : frame.width])
    y = planes[0]
    if len(planes) == 1:
        return np.repeat(y[:, :, None], 3, axis=2).astype(np.uint8)
    cb, cr = planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.int32)
    half = 1 << 15
    out[..., 0] = y + ((91881 * cr + half) >> 16)
    out[..., 1] = y - ((22554 * cb + 46802 * cr + half) >> 16)
    out[..., 2] = y + ((116130 * cb + half) >> 16)
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


# ---------------------------------------------------------------- writing


def segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def flat_table(symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    return bytes([len(symbols) if n == length else 0 for n in range(1, 17)]) + bytes(symbols)


_DC_TABLE, _AC_TABLE, _RUN_TABLE = flat_table(list(range(10)), 4), flat_table([0x07], 1), flat_table([r << 4 for r in range(15)], 4)
_TABLES = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\x00" + _DC_TABLE + b"\x10" + _AC_TABLE + b"\x11" + _RUN_TABLE)


def packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bit fields laid end to end, filled up with ones."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    which = np.repeat(np.arange(len(lengths)), lengths)
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    bits[:total] = values[which] >> (ends[which] - 1 - np.arange(total)) & 1
    return np.packbits(bits).tobytes()


def _scan(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([i, t]) for i, t in parts) + bytes([ss, se, ah << 4 | al])
    return segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _run_code(n: int) -> str:
    r = n.bit_length() - 1
    return format(r, "04b") + (format(n - (1 << r), f"0{r}b") if r else "")


def write_payload(payload: bytes) -> bytes:
    """One progressive JPEG whose coefficients are the payload, in 4:2:0."""
    mrows = max(1, -(-len(payload) // (MCU_COLUMNS * 6 * 64)))
    grids = ((2, 2, 2 * mrows, 2 * MCU_COLUMNS), (1, 1, mrows, MCU_COLUMNS), (1, 1, mrows, MCU_COLUMNS))
    blocks = np.full(MCU_COLUMNS * 6 * mrows * 64, 255, np.uint8)
    blocks[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = blocks.reshape(-1, 64)
    cuts = np.cumsum([r * c for _, _, r, c in grids])
    planes = np.split(blocks, cuts[:-1])

    comp, block = _order(grids)
    byte = blocks[np.concatenate(([0], cuts[:-1]))[comp] + block, 0].astype(np.int32)
    dc = np.where(byte >= 128, byte, byte - 255)
    diff = np.empty_like(dc)
    for c in range(3):
        mine = comp == c
        diff[mine] = np.diff(dc[mine] >> 1, prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    value = size << size | np.where(diff >= 0, diff, diff + (1 << size) - 1)
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), _TABLES]
    out.append(segment(0xC2, b"\x08" + (16 * mrows).to_bytes(2, "big") + (16 * MCU_COLUMNS).to_bytes(2, "big") + b"\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, packed(value, size + 4)))
    for ss, se in ((1, 5), (6, 63)):
        out += [_scan([(i + 1, 0)], ss, se, 0, 1, (p[:, ss : se + 1] >> 1).tobytes()) for i, p in enumerate(planes)]
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, packed(dc & 1, np.ones(len(dc)))))
    for i, p in enumerate(planes):
        low = np.where(p[:, 1:] >= 128, p[:, 1:], 255 - p[:, 1:]) & 1
        bits = []
        for a in range(0, len(low), 32767):
            run = low[a : a + 32767]
            bits += [np.array(list(_run_code(len(run))), np.uint8), run.reshape(-1)]
        flat = np.concatenate(bits)
        fill = np.ones(-len(flat) % 8, np.uint8)
        out.append(_scan([(i + 1, 1)], 1, 63, 1, 0, np.packbits(np.concatenate([flat, fill])).tobytes()))
    out.append(b"\xff\xd9")
    return b"".join(out)


def read_payload(frame: Frame) -> bytes:
    """The payload a frame keeps in its coefficients."""
    n = next(int(c[8:]) for c in frame.comments if c.startswith(b"payload "))
    coefs = np.concatenate([c.coefs for c in frame.components]).reshape(-1)
    return np.where(coefs > 0, coefs, coefs + 255).astype(np.uint8).tobytes()[:n]


# ---------------------------------------------------------------- columns


def store(payload: bytes) -> list[bytes]:
    """The images that keep a payload."""
    return [write_payload(payload[i : i + TILE]) for i in range(0, max(1, len(payload)), TILE)]


def describe(images: list[bytes]) -> tuple[bytes, str]:
    """(payload, feature) of stored images; the feature gives size, channel sums and a
    checksum of the RGB tensors."""
    payload, height, sums, crc, width = [], 0, np.zeros(3, np.int64), 0, 0
    for image in images:
        frame = read_frame(image)
        payload.append(read_payload(frame))
        rgb = to_rgb(frame)
        height, width = height + rgb.shape[0], rgb.shape[1]
        sums += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        crc = zlib.crc32(rgb.tobytes(), crc)
    return b"".join(payload), f"{width}x{height};rgb={sums[0]},{sums[1]},{sums[2]};crc={crc:08x}"
