"""Media columns: a baseline JPEG parser, Huffman decoder and DC-only thumbnails in numpy.

``read_jpegs`` parses the markers of baseline JPEG files and decodes their scans. All restart intervals of all files
with the same tables are decoded side by side, one symbol of each per numpy step. A thumbnail has one pixel a block,
from the DC coefficient of the luminance. ``write_jpegs`` makes baseline grey files from quantized coefficients (all
quantizers 1), which carry any bytes without loss in the format's own unit: byte b is the coefficient ``VALUES[b]``.

Defined cases: null text is an empty payload (64 zero bytes); equal payloads give equal files and features; very long
payloads are a larger picture, coded in slices; a file that is no baseline JPEG gives null features; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Blocks between restart markers.
INTERVAL = 4
#: Bytes of payloads coded, and of files decoded, side by side; the coder works on slices that fit a core's cache.
SLICE = 1 << 20
CODED = 1 << 16
#: Bytes in order of their expected frequency in text; the rest follow by value. Byte 0 is coefficient 0.
FREQUENT = b" etnioasrhdlcumgpbfvwq.\n,\xc3\xa9zyxkj-TIAESONRDHLPMCUBFGVW'\":;()?!0123456789"


def _values() -> np.ndarray:
    order = [*FREQUENT, *(b for b in range(1, 256) if b not in FREQUENT)]
    out = np.zeros(256, np.int16)
    for rank, b in enumerate(order):
        out[b] = rank // 2 + 1 if rank % 2 == 0 else -(rank // 2 + 1)
    return out


VALUES = _values()
BYTES = np.zeros(513, np.uint8)
BYTES[VALUES.astype(int) + 256] = np.arange(256)

#: Code lengths: DC by category; AC by symbol (run << 4 | category), short for the categories of text without runs.
DC_LENGTHS = {c: max(3, c - 3) for c in range(12)}
AC_LENGTHS = {r << 4 | c: 12 for r in range(16) for c in range(1, 11)} | {0x00: 7, 0xF0: 11, 1: 2, 2: 2, 3: 2, 4: 3, 5: 5, 6: 6, 7: 6, 8: 9}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and (code, length) of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last if last else 0
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
        counts[last - 1] += 1
    return counts, symbols, codes


def _code_arrays(lengths: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for s, (c, k) in canonical(lengths)[2].items():
        code[s], size[s] = c, k
    return code, size


DC_CODE, DC_SIZE = _code_arrays(DC_LENGTHS, 16)
AC_CODE, AC_SIZE = _code_arrays(AC_LENGTHS, 256)
CATEGORY = np.array([int(v).bit_length() for v in range(2048)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table_segment(kind: int, lengths: dict[int, int]) -> bytes:
    counts, symbols, _ = canonical(lengths)
    return _segment(0xC4, bytes([kind << 4, *counts, *symbols]))


_TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _table_segment(0, DC_LENGTHS) + _table_segment(1, AC_LENGTHS) + _segment(0xDD, struct.pack(">H", INTERVAL))
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def picture_size(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of a picture that holds the blocks."""
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def _extra(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and extra bits of values."""
    size = CATEGORY[np.abs(v)]
    return size, np.where(v < 0, v + (np.int64(1) << size) - 1, v).astype(np.uint64)


def _ac_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bits and their number for the coefficients 1 to 63 of blocks (n, 63), with runs of zeros and ends of block."""
    n = len(v)
    cat, extra = _extra(v)
    some = cat > 0
    at = np.where(some, np.arange(1, 64), 0)
    before = np.maximum.accumulate(np.c_[np.zeros((n, 1), np.int64), at[:, :-1]], axis=1)
    run = np.where(some, np.arange(1, 64) - before - 1, 0)
    sym = (run & 15) << 4 | cat
    code, length = (AC_CODE[sym] << cat.astype(np.uint64)) | extra, AC_SIZE[sym] + cat
    for k in (3, 2, 1):  # up to three runs of 16 zeros before the symbol
        long = some & (run >= 16 * k)
        code = np.where(long, code | (AC_CODE[0xF0] << length.astype(np.uint64)), code)
        length = np.where(long, length + AC_SIZE[0xF0], length)
    code, length = np.where(some, code, 0).astype(np.uint64), np.where(some, length, 0)
    last = at.max(axis=1)
    ends = np.flatnonzero(last < 63)
    code[ends, last[ends]], length[ends, last[ends]] = AC_CODE[0], AC_SIZE[0]
    return code, length


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """AC code bits of each byte's coefficient after no zeros, and their number."""
    cat, extra = _extra(VALUES.astype(np.int64))
    return (AC_CODE[cat] << cat.astype(np.uint64)) | extra, AC_SIZE[cat] + cat


BYTE_CODE, BYTE_SIZE = _byte_codes()


def _scan_bytes(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks of 64 bytes (n, 64), and the first byte of each restart interval.

    ``first`` marks the blocks that open an interval; every interval is padded to whole bytes with ones.
    """
    n = len(blocks)
    dc = VALUES[blocks[:, 0]].astype(np.int64)
    dc[1:] -= np.where(first[1:], 0, VALUES[blocks[:-1, 0]])
    bits, size = BYTE_CODE[blocks], BYTE_SIZE[blocks]
    cat, extra = _extra(dc)
    bits[:, 0], size[:, 0] = (DC_CODE[cat] << cat.astype(np.uint64)) | extra, DC_SIZE[cat] + cat
    holes = np.flatnonzero((blocks[:, 1:] == 0).any(axis=1))
    if len(holes):
        bits[holes, 1:], size[holes, 1:] = _ac_codes(VALUES[blocks[holes, 1:]].astype(np.int64))
    opens = np.flatnonzero(first)
    total = np.add.reduceat(size.sum(axis=1), opens)
    pad, close = -total % 8, np.r_[opens[1:], n] - 1
    bits[close, 63] = (bits[close, 63] << pad.astype(np.uint64)) | ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))
    size[close, 63] += pad
    bits, size = bits.ravel(), size.ravel()
    while len(bits) % 2 == 0:  # join neighbours while they fit in a word
        joined = size[::2] + size[1::2]
        if joined.max() > 64:
            break
        bits = np.where(size[1::2] < 64, bits[::2] << np.minimum(size[1::2], 63).astype(np.uint64), 0).astype(np.uint64) | bits[1::2]
        size = joined
    used = size > 0
    if not used.all():
        bits, size = bits[used], size[used]
    off = np.cumsum(size) - size
    word, over = off >> 6, (off & 63) + size - 64  # over: bits that go on in the next word
    part = np.where(over <= 0, bits << np.maximum(-over, 0).astype(np.uint64), bits >> np.maximum(over, 0).astype(np.uint64))
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[starts]] = np.bitwise_or.reduceat(part, starts)
    far = np.flatnonzero(over > 0)
    out[word[far] + 1] |= bits[far] << (64 - over[far]).astype(np.uint64)
    begin = np.cumsum((total + pad) >> 3) - ((total + pad) >> 3)
    return out.byteswap().view(np.uint8)[: int((total + pad).sum()) >> 3], begin


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a multiple of 64 bytes)."""
    out, group, size = [], [], 0
    for p in payloads:
        group.append(p)
        size += len(p)
        if size >= SLICE:
            out += _write(group)
            group, size = [], 0
    return out + (_write(group) if group else [])


def _write(payloads: list[bytes]) -> list[bytes]:
    sizes = [picture_size(len(p) // 64) for p in payloads]
    each = np.array([w * h for w, h in sizes])
    data = np.zeros(int(each.sum()) * 64, np.uint8)
    begin = np.cumsum(each) - each
    for p, at in zip(payloads, begin.tolist()):
        data[at * 64 : at * 64 + len(p)] = np.frombuffer(p, np.uint8)
    within = np.arange(int(each.sum())) - np.repeat(begin, each)
    first = within % INTERVAL == 0
    scans, interval_at = [], []
    step, base = max(1, CODED // 64 // INTERVAL) * INTERVAL, 0
    lo = 0
    while lo < len(first):  # very long pictures are coded in slices that begin with an interval
        hi = min(len(first), lo + step)
        while hi < len(first) and not first[hi]:
            hi += 1
        scan, at = _scan_bytes(data[lo * 64 : hi * 64].reshape(-1, 64), first[lo:hi])
        scans.append(scan)
        interval_at.append(at + base)
        base += len(scan)
        lo = hi
    scan, at = np.concatenate(scans), np.concatenate(interval_at)
    number = (within[first] // INTERVAL).astype(np.int64)
    # Room for the zero after each 0xFF and for the marker before each interval but a picture's first.
    grown = np.ones(len(scan), np.int64)
    grown[scan == 0xFF] += 1
    marked = np.flatnonzero(number > 0)
    lead = np.zeros(len(scan), np.int64)
    lead[at[marked]] = 2
    place = np.cumsum(grown + lead) - grown
    full = np.zeros(int(place[-1] + grown[-1]), np.uint8)
    full[place] = scan
    full[place[at[marked]] - 2], full[place[at[marked]] - 1] = 0xFF, 0xD0 + (number[marked] - 1) % 8
    cuts = np.r_[place[at[number == 0]], len(full)].tolist()
    out = []
    for i, (p, (wide, high)) in enumerate(zip(payloads, sizes)):
        note = _segment(0xFE, b"payload=%d" % len(p))
        frame = _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        out.append(b"\xff\xd8" + note + _TABLES + frame + _SCAN + full[cuts[i] : cuts[i + 1]].tobytes() + b"\xff\xd9")
    return out


@dataclass
class Picture:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantizer
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | number: counts and symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    interval: int = 0
    notes: list[bytes] = field(default_factory=list)
    data: bytes = b""

    def blocks(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of the blocks of one unit of the scan."""
        at = {c[0]: (i, c[1] * c[2]) for i, c in enumerate(self.components)}
        if len(self.scan) == 1:
            return [(at[self.scan[0][0]][0], *self.scan[0][1:])]
        return [(at[c][0], d, a) for c, d, a in self.scan for _ in range(at[c][1])]

    def units(self) -> tuple[int, int]:
        """Units of the scan across and down."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:
            own = next(c for c in self.components if c[0] == self.scan[0][0])
            return -(-(-(-self.width * own[1] // h)) // 8), -(-(-(-self.height * own[2] // v)) // 8)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse_markers(media: bytes) -> Picture | None:
    """The markers of a baseline JPEG with one scan; None if it is none."""
    if media[:2] != b"\xff\xd8":
        return None
    p, at = Picture(), 2
    try:
        while True:
            while media[at] != 0xFF or media[at + 1] in (0, 0xFF):
                at += 1
            marker, n = media[at + 1], int.from_bytes(media[at + 2 : at + 4])
            body, at = media[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xC0:
                _, p.height, p.width, count = struct.unpack(">BHHB", body[:6])
                p.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) or marker == 0xD9:
                return None
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = 17 + sum(body[i + 1 : i + 17])
                    p.tables[body[i]] = body[i + 1 : i + n]
                    i += n
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    p.quantizers[body[i] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                    i += 65 + 64 * bool(wide)
            elif marker == 0xDD:
                p.interval = int.from_bytes(body[:2])
            elif marker == 0xFE:
                p.notes.append(body)
            elif marker == 0xDA:
                p.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                p.data = media[at:]
                return p if p.components and p.width and p.height else None
    except (IndexError, struct.error, ValueError):
        return None


def lookup(table: bytes, dc: bool) -> np.ndarray:
    """For every 16-bit prefix, what it codes: value << 16 | long << 14 | coefficients passed << 5 | bits.

    ``long`` marks a code whose extra bits go beyond the prefix; its value field holds the symbol and bits the code's.
    """
    out, at, i = np.zeros(1 << 16, np.int64), 0, 16
    prefix = np.arange(1 << 16)
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            n, symbol = 1 << (16 - length), table[i]
            size = symbol & 15
            passed = 1 if dc else 64 if symbol == 0 else (symbol >> 4) + 1
            if length + size > 16:
                out[at : at + n] = symbol << 16 | 1 << 14 | passed << 5 | length
            else:
                v = (prefix[at : at + n] >> (16 - length - size)) & ((1 << size) - 1)
                out[at : at + n] = _signed(v, np.int64(size)) << 16 | passed << 5 | length + size
            at, i = at + n, i + 1
    return out


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((v >> np.maximum(size - 1, 0)) == 0, v - (np.int64(1) << size) + 1, v)


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, and the first byte of each restart interval."""
    mark = np.flatnonzero(data[:-1] == 0xFF)
    after = data[mark + 1]
    end = mark[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    if len(end):
        data, mark, after = data[: end[0]], mark[mark < end[0]], after[mark < end[0]]
    drop = np.zeros(len(data) + 2, bool)
    drop[mark[after == 0] + 1] = True
    restart = mark[(after >= 0xD0) & (after <= 0xD7)]
    drop[restart], drop[restart + 1] = True, True
    keep = ~drop[: len(data)]
    return data[keep], np.r_[0, np.cumsum(keep)[restart]].astype(np.int64)


def decode_scans(pictures: list[Picture]) -> list[np.ndarray]:
    """Quantized coefficients (blocks in scan order, 64 in zigzag order) of pictures with equal tables and layout."""
    p = pictures[0]
    layout = p.blocks()
    luts = np.concatenate([lookup(p.tables[k << 4 | t], k == 0) for _, d, a in layout for k, t in ((0, d), (1, a))])
    per, kinds, many = len(layout), np.array([c for c, _, _ in layout]), len(p.components)
    pieces, begin, first, left, base, block = [], [], [], [], 0, 0
    totals = []
    for q in pictures:
        data, at = _intervals(np.frombuffer(q.data, np.uint8))
        wide, high = q.units()
        units = np.full(len(at), q.interval or wide * high, np.int64)
        units[-1] = wide * high - units[:-1].sum()
        if units[-1] < 0 or units[-1] > (q.interval or wide * high):
            raise ValueError("restart markers do not match the picture's size")
        pieces += [data, np.zeros(8, np.uint8)]
        begin.append((at + base) * 8)
        first.append(block + (np.cumsum(units) - units) * per)
        left.append(units * per)
        base, block = base + len(data) + 8, block + wide * high * per
        totals.append(wide * high * per)
    raw = np.concatenate([*pieces, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    window = window.astype(np.int64)
    bit, at, todo = np.concatenate(begin), np.concatenate(first) * 64, np.concatenate(left)
    spare = block * 64  # where ended intervals write until they leave
    out = np.zeros(spare + 64, np.int16)
    at[todo <= 0] = spare
    k, table = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    pred = np.zeros((many, len(bit)), np.int64)
    limit = (len(window) - 1) * 8
    while True:
        live = todo > 0
        if not live.all():
            bit, at, todo, k, table, pred = bit[live], at[live], todo[live], k[live], table[live], pred[:, live]
        if not len(bit):
            break
        for _ in range(16):
            peek = (window[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF
            found = luts[table + peek]
            bit = bit + (found & 31)
            v = found >> 16
            long = np.flatnonzero(found & 1 << 14)
            if len(long):
                size, b = v[long] & 15, np.minimum(bit[long], limit)
                v[long] = _signed((window[b >> 3] >> (32 - (b & 7) - size)) & ((1 << size) - 1), size)
                bit[long] += size
            start = np.flatnonzero(k == 0)
            if len(start):
                c = kinds[table[start] >> 17]
                pred[c, start] += v[start]
                v[start] = pred[c, start]
                table[start] += 1 << 16
            k = k + (found >> 5 & 127)
            out[at + np.minimum(k, 64) - 1] = v
            full = np.flatnonzero(k > 63)
            if len(full):
                k[full] = 0
                todo[full] -= 1
                at[full] = np.where(todo[full] > 0, at[full] + 64, spare)
                table[full] = (table[full] + (1 << 16)) % (per << 17)
                np.minimum(bit, limit, out=bit)
    ends = np.cumsum(totals) * 64
    return [out[e - t * 64 : e].reshape(-1, 64) for e, t in zip(ends.tolist(), totals)]


def thumbnail(p: Picture, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel a block, from the DC coefficients of the first component."""
    layout, (wide, high) = p.blocks(), p.units()
    own = [i for i, b in enumerate(layout) if b[0] == 0]
    dc = coefficients[:, 0].reshape(high * wide, len(layout))[:, own].astype(np.int64)
    _, h, v, q = p.components[0]
    if len(layout) == 1:
        h = v = 1
    grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    step = int(p.quantizers[q][0]) if q in p.quantizers else 1
    return np.clip((grid * step + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(t: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 8 grid of means is above the next (to the right, wrapping)."""
    rows, cols = np.arange(8) * t.shape[0] // 8, np.arange(8) * t.shape[1] // 8
    total = np.add.reduceat(np.add.reduceat(t, rows, axis=0, dtype=np.int64), cols, axis=1)
    mean = total / np.maximum(np.diff(np.append(cols, t.shape[1])), 1)
    bits = mean > mean[:, [1, 2, 3, 4, 5, 6, 7, 0]]
    return np.packbits(bits.ravel()).tobytes().hex()


def read_jpegs(media: list[bytes | None]) -> list[tuple[Picture, np.ndarray] | None]:
    """Markers and coefficients of each file; None for what is no baseline JPEG."""
    parsed = [parse_markers(m) if m else None for m in media]
    alike = defaultdict(list)
    for i, p in enumerate(parsed):
        if p:
            alike[(tuple(p.blocks()), tuple(sorted(p.tables.items())))].append(i)
    out: list[tuple[Picture, np.ndarray] | None] = [None] * len(media)
    for members in alike.values():
        group, size = [], 0
        for j, i in enumerate(members):
            group.append(i)
            size += len(parsed[i].data)
            if size >= SLICE or j == len(members) - 1:
                try:
                    for m, c in zip(group, decode_scans([parsed[m] for m in group])):
                        out[m] = (parsed[m], c)
                except (ValueError, KeyError, IndexError):
                    for m in group:  # one bad file must not spoil the others
                        try:
                            out[m] = (parsed[m], decode_scans([parsed[m]])[0])
                        except (ValueError, KeyError, IndexError):
                            out[m] = None
                group, size = [], 0
    return out


def payload_of(p: Picture, coefficients: np.ndarray) -> bytes:
    """The bytes that write_jpegs stored."""
    n = next(int(x[8:]) for x in p.notes if x.startswith(b"payload="))
    return BYTES[coefficients.ravel()[:n].astype(np.int64) + 256].tobytes()


def feature(p: Picture, coefficients: np.ndarray) -> str:
    t = thumbnail(p, coefficients)
    return f"{p.width}x{p.height}x{len(p.components)}:{t.shape[1]}x{t.shape[0]}:{thumbnail_hash(t)}"


def jpeg_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, width, height, components, thumb_width, thumb_height, thumb (bytes) and thumb_hash of a column of JPEG files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for got in read_jpegs(b.column(1).to_pylist()):
                if got is None:
                    rows.append((None,) * 7)
                    continue
                t = thumbnail(*got)
                rows.append((got[0].width, got[0].height, len(got[0].components), t.shape[1], t.shape[0], t.tobytes(), thumbnail_hash(t)))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [b.schema.names[0], "width", "height", "components", "thumb_width", "thumb_height", "thumb", "thumb_hash"])

    kind = df.schema[id_col].dataType.simpleString()
    made = f"`{id_col}` {kind}, width int, height int, components int, thumb_width int, thumb_height int, thumb binary, thumb_hash string"
    return df.select(id_col, media_col).mapInArrow(run, made)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as a baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            media = write_jpegs([t + bytes(64 - len(t) % 64 if len(t) % 64 or not t else 0) for t in texts])
            for at in range(0, len(texts), 512):
                part = slice(at, at + 512)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(media[part], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a media file, reads the stored files back and digests payload, file and feature."""
    stored, _ = materialise(store_texts(docs), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(2).to_pylist()
            rows = []
            for at in range(0, len(media), 256):
                for m, (p, c) in zip(media[at : at + 256], read_jpegs(media[at : at + 256])):
                    x = payload_of(p, c)
                    rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, c)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
