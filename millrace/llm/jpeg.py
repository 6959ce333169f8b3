"""Progressive JPEG: a decoder in numpy, and a writer that carries bytes.

The decoder reads baseline markers and SOF2 frames: every scan, whatever its
spectral selection and successive approximation, adds to the coefficient arrays
of its components; then blocks are dequantised, inverse-transformed, put
together, chroma is upsampled and the picture converted to RGB.

Entropy-coded scans are decoded symbol by symbol.  A scan of uniform layout (one
code word for each coefficient, or one for each block followed by correction
bits) has its code words at known places; there the decoder cuts all fields out
at once, and accepts them only if every code word is the expected one, which is
what reading symbol by symbol would have found.

The writer stores a byte ``b`` as an AC coefficient of magnitude ``256 + b``, 63
to a block, in blocks of a 4:2:0 picture: Y blocks first, then Cb, then Cr.  Two
spectral bands of Y and one of each chroma component come without their lowest
bit, refinement scans add it.  Coefficients are the format's unit and are coded
without loss, so the bytes are read back exactly; the pixels follow from them.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


def zigzag() -> np.ndarray:
    """Natural positions (8 * row + column) in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def _transform(bits: int = 13) -> np.ndarray:
    """64 x 64 inverse DCT of natural-order coefficients, in whole 2**-bits.

    Whole numbers keep sums exact in float64, so results don't depend on how many
    blocks are multiplied at once.
    """
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.rint(np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64) * (1 << bits))


SCALE_BITS = 13
INVERSE = _transform(SCALE_BITS)
#: Blocks worked on at a time; a multiple of 8, so that chunks of bits end on bytes.
CHUNK = 4096


class JpegError(ValueError):
    """The data is not a progressive JPEG that this decoder reads."""


@dataclass
class Component:
    identifier: int
    h: int
    v: int
    table: int
    across: int = 0  # blocks in a row of the padded grid
    down: int = 0
    wide: int = 0  # blocks in a row of a non-interleaved scan
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty((0, 64), np.int32))


class Huffman:
    """Canonical code: (length, word) to symbol, and the first symbols' words."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol: dict[tuple[int, int], int] = {}
        self.word: dict[int, tuple[int, int]] = {}
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.symbol[length, code] = symbols[at]
                self.word[symbols[at]] = (length, code)
                at += 1
                code += 1
            code <<= 1


class Bits:
    """Bits of one entropy-coded segment, most significant first; ones past its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def read(self, n: int) -> int:
        while self.left < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.value = (self.value << 8) | byte
            self.left += 8
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.read(1)
            found = table.symbol.get((length, code))
            if found is not None:
                return found
        raise JpegError("no such code word")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        value = self.read(size)
        return value if value >> (size - 1) else value - (1 << size) + 1


class Decoder:
    """Decodes one progressive JPEG; coefficients are kept in zigzag order."""

    def __init__(self, data: bytes, fast: bool = True):
        self.data, self.fast = data, fast
        self.quantisers: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Huffman] = {}
        self.components: dict[int, Component] = {}
        self.interval, self.width, self.height, self.comments = 0, 0, 0, []
        self.fast_scans = self.scans = 0
        self._parse()

    # -- markers

    def _parse(self) -> None:
        data = self.data
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        at = 2
        while True:
            at = data.index(b"\xff", at)
            marker = data[at + 1]
            if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD7:
                at += 1
                continue
            if marker == 0xD9:
                return
            length = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                end = at
                while True:  # the next marker that is neither stuffing nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise JpegError("not a progressive Huffman frame")

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            kind, size = (">u2", 128) if wide else ("u1", 64)
            self.quantisers[number] = np.frombuffer(body[at + 1 : at + 1 + size], kind).astype(np.int64)
            at += 1 + size

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at] >> 4, body[at] & 15] = Huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or not self.height or not self.width:
            raise JpegError("8-bit pictures of known size only")
        parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
        self.mcus = (-(-self.width // (8 * most_h)), -(-self.height // (8 * most_v)))
        for c in parts:
            c.across, c.down = self.mcus[0] * c.h, self.mcus[1] * c.v
            c.wide = -(-(-(-self.width * c.h // most_h)) // 8)
            c.high = -(-(-(-self.height * c.v // most_v)) // 8)
            c.coefficients = np.zeros((c.across * c.down, 64), np.int32)
        self.components = {c.identifier: c for c in parts}
        self.most = most_h, most_v

    # -- scans

    def _blocks(self, parts: list[Component]) -> tuple[list[Component], np.ndarray, np.ndarray]:
        """Order of the scan: component number and block index; and blocks in an MCU."""
        if len(parts) == 1:
            c = parts[0]
            index = (np.arange(c.high)[:, None] * c.across + np.arange(c.wide)).ravel()
            return parts, np.zeros(len(index), np.int64), index
        columns, owners = [], []
        my, mx = np.divmod(np.arange(self.mcus[0] * self.mcus[1]), self.mcus[0])
        for k, c in enumerate(parts):
            for y in range(c.v):
                for x in range(c.h):
                    columns.append((my * c.v + y) * c.across + mx * c.h + x)
                    owners.append(k)
        return parts, np.tile(owners, len(my)), np.stack(columns, axis=1).ravel()

    def _scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        parts = [self.components[body[1 + 2 * i]] for i in range(n)]
        tables = [body[2 + 2 * i] for i in range(n)]
        first, last, approximation = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
        before, low = approximation >> 4, approximation & 15
        parts, owner, index = self._blocks(parts)
        per_mcu = 1 if n == 1 else sum(c.h * c.v for c in parts)
        step = self.interval * per_mcu or len(index)
        self.scans += 1
        for k, segment in enumerate(_segments(coded)):
            at, to = k * step, min((k + 1) * step, len(index))
            if at >= to:
                break
            if self.fast and self._uniform(parts, tables, owner[at:to], index[at:to], first, last, before, low, segment):
                self.fast_scans += 1
                continue
            bits = Bits(segment)
            if first == 0:
                self._dc(bits, parts, tables, owner[at:to], index[at:to], before, low)
            elif before == 0:
                self._ac_first(bits, parts[0], self.tables[1, tables[0] & 15], index[at:to], first, last, low)
            else:
                self._ac_refine(bits, parts[0], self.tables[1, tables[0] & 15], index[at:to], first, last, low)

    def _dc(self, bits: Bits, parts, tables, owner, index, before: int, low: int) -> None:
        previous = [0] * len(parts)
        for k, i in zip(owner.tolist(), index.tolist()):
            block = parts[k].coefficients[i]
            if before:
                block[0] |= bits.read(1) << low
            else:
                previous[k] += bits.signed(bits.symbol(self.tables[0, tables[k] >> 4]))
                block[0] = previous[k] << low

    def _ac_first(self, bits: Bits, part, table, index, first: int, last: int, low: int) -> None:
        skip = 0
        for i in index.tolist():
            if skip:
                skip -= 1
                continue
            at = first
            while at <= last:
                run, size = divmod(bits.symbol(table), 16)
                if size:
                    at += run
                    part.coefficients[i, at] = bits.signed(size) * (1 << low)
                    at += 1
                elif run == 15:
                    at += 16
                else:
                    skip = (1 << run) + bits.read(run) - 1
                    break

    def _ac_refine(self, bits: Bits, part, table, index, first: int, last: int, low: int) -> None:
        step, skip = 1 << low, 0

        def correct(block, at: int) -> None:
            if bits.read(1) and not abs(int(block[at])) & step:
                block[at] += step if block[at] > 0 else -step

        for i in index.tolist():
            block, at = part.coefficients[i], first
            if not skip:
                while at <= last:
                    run, size = divmod(bits.symbol(table), 16)
                    new = 0
                    if size:
                        new = step if bits.read(1) else -step
                    elif run < 15:
                        skip = (1 << run) + bits.read(run)
                        break
                    while at <= last:
                        if block[at]:
                            correct(block, at)
                        elif run:
                            run -= 1
                        else:
                            if new:
                                block[at] = new
                            at += 1
                            break
                        at += 1
            if skip:
                while at <= last:
                    if block[at]:
                        correct(block, at)
                    at += 1
                skip -= 1

    def _uniform(self, parts, tables, owner, index, first: int, last: int, before: int, low: int, segment: bytes) -> bool:
        """Decodes a segment of uniform layout at once; False if it isn't one."""
        n, width = len(index), last - first + 1
        if first == 0 and before:
            length, code, extra = 0, 0, 1
        elif first == 0:
            words = {self.tables[0, t >> 4].word.get(0) for t in tables}
            if len(words) != 1 or None in words:
                return False
            (length, code), extra = words.pop(), 0
        else:
            table = self.tables[1, tables[0] & 15]
            if before:
                if 0 not in table.word or not np.all(parts[0].coefficients[index, first : last + 1]):
                    return False
                (length, code), extra = table.word[0], width
            else:
                symbol = next(iter(table.word), 0)
                if symbol >> 4 or not 1 <= symbol <= 10:
                    return False
                (length, code), extra = table.word[symbol], symbol
        fields = width if first and not before else 1
        size = length + extra
        if len(segment) != -(-n * fields * size // 8):
            return False
        raw = np.frombuffer(segment, np.uint8)
        expected = np.array([(code >> (length - 1 - j)) & 1 for j in range(length)], np.uint8)
        decoded = []
        for start in range(0, n, CHUNK):
            count = min(CHUNK, n - start) * fields
            at = start * fields * size // 8
            bits = np.unpackbits(raw[at : at + -(-count * size // 8)])[: count * size].reshape(count, size)
            if length and not (bits[:, :length] == expected).all():
                return False
            if first == 0 and before:
                decoded.append(bits[:, 0])
            elif first and before:
                decoded.append(bits[:, length:])
            elif first:
                if extra == 8:
                    values = np.packbits(bits[:, length:], axis=1)[:, 0].astype(np.int32)
                else:
                    values = bits[:, length:].astype(np.int32) @ (1 << np.arange(extra)[::-1]).astype(np.int32)
                decoded.append(np.where(values >> (extra - 1), values, values - (1 << extra) + 1).reshape(-1, width))
        # accepted: only now the coefficients change
        for k, start in enumerate(range(0, n, CHUNK)):
            chosen = index[start : start + CHUNK]
            if first == 0:
                if before:
                    for j, part in enumerate(parts):
                        mine = owner[start : start + CHUNK] == j
                        part.coefficients[chosen[mine], 0] |= decoded[k][mine].astype(np.int32) << low
            elif before:
                block = parts[0].coefficients[chosen, first : last + 1]
                parts[0].coefficients[chosen, first : last + 1] = block + np.sign(block) * (decoded[k].astype(np.int32) << low)
            else:
                parts[0].coefficients[chosen, first : last + 1] = decoded[k] << low
        return True

    # -- pixels

    def planes(self) -> list[np.ndarray]:
        """Samples of each component over its padded grid."""
        out = []
        for c in self.components.values():
            table = INVERSE[ZIGZAG] * self.quantisers[c.table][:, None]
            samples = np.empty((len(c.coefficients), 64), np.uint8)
            for start in range(0, len(samples), CHUNK):
                sums = (c.coefficients[start : start + CHUNK].astype(np.float64) @ table).astype(np.int64)
                samples[start : start + CHUNK] = np.clip(((sums + (1 << (SCALE_BITS - 1))) >> SCALE_BITS) + 128, 0, 255)
            out.append(samples.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8))
        return out

    def rgb(self) -> np.ndarray:
        """The picture as height x width x 3 bytes; chroma is repeated to full resolution."""
        planes = []
        for plane, c in zip(self.planes(), self.components.values()):
            up, left = self.most[1] // c.v, self.most[0] // c.h
            if up > 1:
                plane = plane.repeat(up, axis=0)
            if left > 1:
                plane = plane.repeat(left, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        luma, blue, red = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        half = 1 << 15
        # ITU-R BT.601 in 2**-16
        out[:, :, 0] = np.clip(luma + ((91881 * red + half) >> 16), 0, 255)
        out[:, :, 1] = np.clip(luma - ((22554 * blue + 46802 * red + half) >> 16), 0, 255)
        out[:, :, 2] = np.clip(luma + ((116130 * blue + half) >> 16), 0, 255)
        return out


def _segments(coded: bytes):
    """Entropy-coded segments between restart markers, without stuffing."""
    if b"\xff" not in coded:
        yield coded
        return
    start = at = 0
    while (at := coded.find(b"\xff", at)) >= 0:
        if 0xD0 <= coded[at + 1] <= 0xD7:
            yield coded[start:at].replace(b"\xff\x00", b"\xff")
            start = at + 2
        at += 2
        if start == 0 and coded.count(b"\xff") == coded.count(b"\xff\x00"):
            break  # no restarts in this scan
    yield coded[start:].replace(b"\xff\x00", b"\xff")


# -- writing

PER_BLOCK = 63
#: Signs by zigzag position, so that the pictures are not all one slope.
_NEGATIVE = np.arange(1, 64) % 2 == 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, by_length: dict[int, bytes]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number, *(len(by_length.get(n, b"")) for n in range(1, 17))]) + b"".join(by_length.get(n, b"") for n in range(1, 17)))


def _scan_bytes(components: list[int], first: int, last: int, before: int, low: int, table: int, bits: list[np.ndarray]) -> bytes:
    header = _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, table)), first, last, before << 4 | low]))
    packed = []
    for part in bits:
        part = part.ravel()
        rest = -len(part) % 8
        packed.append(np.packbits(np.concatenate([part, np.ones(rest, np.uint8)]) if rest else part).tobytes())
    return header + b"".join(packed).replace(b"\xff", b"\xff\x00")


#: Quantisers of one, the Huffman tables that all pictures share: a zero DC
#: difference; coefficients of size 8 without a run; end of block.
_TABLES = _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _table(0, 0, {1: b"\x00"}) + _table(1, 0, {1: b"\x08", 2: b"\x00"}) + _table(1, 1, {1: b"\x00"})


def write(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose AC coefficients carry ``payload``."""
    blocks = max(1, -(-len(payload) // PER_BLOCK))
    mcus = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if max(across, down) * 16 > 65535:
        raise ValueError("the payload is larger than a picture can be")
    total = across * down
    values = np.zeros(total * 6 * PER_BLOCK, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, PER_BLOCK)
    parts = [values[: 4 * total], values[4 * total : 5 * total], values[5 * total :]]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_scan_bytes([1, 2, 3], 0, 0, 0, 1, 0x00, [np.zeros(6 * total, np.uint8)]))
    out.append(_scan_bytes([1, 2, 3], 0, 0, 1, 0, 0x00, [np.zeros(6 * total, np.uint8)]))
    for component, first, last in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        band, negative = parts[component - 1][:, first - 1 : last], _NEGATIVE[first - 1 : last]
        pieces = []
        for start in range(0, len(band), CHUNK):
            # magnitude 128 + b // 2 in eight bits; a negative number is written as its complement
            high = ((band[start : start + CHUNK] >> 1) | 0x80) ^ np.where(negative, 0xFF, 0).astype(np.uint8)
            bits = np.zeros((high.size, 9), np.uint8)
            bits[:, 1:] = np.unpackbits(high.reshape(-1, 1), axis=1)
            pieces.append(bits)
        out.append(_scan_bytes([component], first, last, 0, 1, 0x00, pieces))
    for component in (1, 2, 3):
        part = parts[component - 1]
        pieces = []
        for start in range(0, len(part), CHUNK):
            bits = np.zeros((len(part[start : start + CHUNK]), 64), np.uint8)
            bits[:, 1:] = part[start : start + CHUNK] & 1
            pieces.append(bits)
        out.append(_scan_bytes([component], 1, 63, 1, 0, 0x01, pieces))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(picture: Decoder) -> bytes:
    """The bytes that ``write`` put into a picture, from its coefficients."""
    length = next(int(c.split()[1]) for c in picture.comments if c.startswith(b"payload "))
    carried = [np.abs(c.coefficients[:, 1:]) - 256 for c in picture.components.values()]
    return np.concatenate([x.astype(np.uint8).ravel() for x in carried])[:length].tobytes()
