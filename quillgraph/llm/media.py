"""Media columns: progressive JPEG, written and read scan by scan with numpy."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import mapped, memo, read

UNIT = 64
#: Bits that the first scan of a band leaves to refinements.
AC_LOW, DC_LOW = 2, 1
#: Sampling of the three components, as blocks of an MCU across and down.
SAMPLING = ((2, 2), (1, 1), (1, 1))
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


@memo
def zigzag() -> np.ndarray:
    """Natural position of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda n: (n // 8 + n % 8, n // 8 if (n // 8 + n % 8) % 2 else n % 8)))


@memo
def inverse_cosine() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: samples of the block in natural order."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / 16) / 2
    c[0] /= math.sqrt(2)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[zigzag()].astype(np.float32)


# --- Huffman tables and bits ---------------------------------------------------------------------------------------


class Table:
    """A Huffman table from its symbols and the number of codes of each length."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = bytes(counts), bytes(symbols)
        self.code: dict[int, tuple[int, int]] = {}
        at = k = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[k : k + n]:
                self.code[s] = (at, length)
                at += 1
            k += n
            at <<= 1

    @functools.cached_property
    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """Code length and symbol by the next 16 bits; length 0 where no code fits."""
        length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, (c, n) in self.code.items():
            length[c << 16 - n : (c + 1) << 16 - n], symbol[c << 16 - n : (c + 1) << 16 - n] = n, s
        return length, symbol

    @staticmethod
    def even(symbols: list[int]) -> Table:
        """All codes equally long; the one of ones alone stays free."""
        n = max(1, len(symbols).bit_length())
        return Table(bytes(len(symbols) if i == n else 0 for i in range(1, 17)), bytes(symbols))


@memo
def table(counts: bytes, symbols: bytes) -> Table:
    """The same table object for the same table: what it looks codes up in is made once."""
    return Table(counts, symbols)


@memo
def tables() -> dict[tuple[int, int], Table]:
    """(class, id): differences of DC; a first scan whose coefficients all have one size; runs of ended bands."""
    return {(0, 0): Table.even(list(range(12))), (1, 0): Table.even([8 - AC_LOW]), (1, 1): Table.even([n << 4 for n in range(15)])}


def to_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest `lengths` bits of each value, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    shift = np.repeat(ends, lengths) - 1 - np.arange(total)
    return (np.repeat(values, lengths) >> shift & 1).astype(np.uint8)


def stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones, with a zero byte after each byte of ones."""
    fill = np.ones(-len(bits) % 8, np.uint8)
    return np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\x00")


class Bits:
    """The bits of a scan, read from the left."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a scan ends too early")
        self.at += n
        return out

    def number(self, n: int) -> int:
        out = 0
        for b in self.take(n).tolist():
            out = out << 1 | b
        return out

    def symbol(self, table: Table) -> int:
        window = self.bits[self.at : self.at + 16]
        key = int(window @ (1 << np.arange(15, 15 - len(window), -1))) if len(window) else 0
        length, symbol = table.look
        if not length[key]:
            raise ValueError("no such Huffman code")
        self.at += int(length[key])
        return int(symbol[key])


def extend(bits: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """The signed values that `size` extra bits stand for."""
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


# --- geometry ------------------------------------------------------------------------------------------------------


@memo
def mcu_order(wide: int, high: int) -> np.ndarray:
    """Index of each block, all of the first component, then of the second, ..., in the order of interleaved scans."""
    out, first = [], 0
    for h, v in SAMPLING:
        grid = np.arange(wide * h * high * v).reshape(high, v, wide, h) + first
        out.append(grid.transpose(0, 2, 1, 3).reshape(wide * high, h * v))
        first += grid.size
    return np.concatenate(out, 1).ravel()


def shape_for(blocks: int) -> tuple[int, int]:
    """MCUs across and down that hold so many blocks."""
    mcus = -(-blocks // sum(h * v for h, v in SAMPLING))
    wide = math.isqrt(mcus - 1) + 1
    return wide, -(-mcus // wide)


# --- writing -------------------------------------------------------------------------------------------------------


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def start_of_scan(parts: list[tuple[int, int, int]], low: int, high: int, ah: int, al: int) -> bytes:
    return segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, dc << 4 | ac]) for c, dc, ac in parts) + bytes([low, high, ah << 4 | al]))


def ended_runs(blocks: int) -> Iterator[tuple[int, int, int]]:
    """For runs of blocks whose bands hold nothing new: (blocks, symbol, extra bits' value)."""
    while blocks:
        run = min(blocks, 0x7FFF)
        n = run.bit_length() - 1
        yield run, n << 4, run - (1 << n)
        blocks -= run


def write(coefficients: np.ndarray, wide: int, high: int, note: bytes = b"") -> bytes:
    """A progressive JPEG of coefficients (blocks, 64) in zigzag order, all AC ones with 128 <= |value| <= 255.

    Scans: DC of all components, its lowest bit left out; bands of AC by component, two lowest bits left out; then a
    refinement scan for each bit left out. Every quantizer is 1, so coefficients are kept exactly.
    """
    dc, first, ended = (tables()[k] for k in ((0, 0), (1, 0), (1, 1)))
    order = mcu_order(wide, high)
    borders = np.cumsum([0, *(wide * h * high * v for h, v in SAMPLING)])
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xFE, note), segment(0xDB, bytes([0]) + b"\1" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))))
    out += [segment(0xC4, bytes([c << 4 | i]) + t.counts + t.symbols) for (c, i), t in tables().items()]
    # DC: differences to the component's block before, in interleaved order
    coarse = coefficients[:, 0] >> DC_LOW
    place = np.searchsorted(borders, order, side="right") - 1
    diff = np.zeros(len(order), np.int64)
    for c in range(len(SAMPLING)):
        mine = np.flatnonzero(place == c)
        diff[mine] = np.diff(coarse[order[mine]], prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code, length = (np.array([dc.code[s][k] for s in range(12)]) for k in (0, 1))
    out += [start_of_scan([(c, 0, 0) for c in range(3)], 0, 0, 0, DC_LOW), stuffed(to_bits(code[size] << size | extra, length[size] + size))]
    magnitude, negative = np.abs(coefficients), coefficients < 0
    width = 8 - AC_LOW
    extra = (magnitude >> AC_LOW) ^ (negative * ((1 << width) - 1))
    prefix, prefix_length = first.code[width]
    word = (extra | prefix << width).astype(np.uint16)
    for c, low, top in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        band = word[borders[c] : borders[c + 1], low : top + 1].astype(">u2").reshape(-1, 1).view(np.uint8)
        out += [start_of_scan([(c, 0, 0)], low, top, 0, AC_LOW), stuffed(np.unpackbits(band, axis=1)[:, 16 - width - prefix_length :].ravel())]
    for al in range(AC_LOW - 1, -1, -1):
        if al < DC_LOW:
            out += [start_of_scan([(c, 0, 0) for c in range(3)], 0, 0, al + 1, al), stuffed((coefficients[order, 0] >> al & 1).astype(np.uint8))]
        for c in range(3):
            fine, bits, at = (magnitude[borders[c] : borders[c + 1], 1:] >> al & 1).astype(np.uint8), [], 0
            for run, symbol, rest in ended_runs(len(fine)):
                (value, n), more = ended.code[symbol], symbol >> 4
                bits += [to_bits(np.array([value << more | rest]), np.array([n + more])), fine[at : at + run].ravel()]
                at += run
            out += [start_of_scan([(c, 0, 1)], 1, 63, al + 1, al), stuffed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# --- reading -------------------------------------------------------------------------------------------------------


class Reader:
    """Coefficients of a progressive JPEG with three components sampled 2x2, 1x1, 1x1 and sides that are multiples of 16."""

    def __init__(self, data: bytes):
        self.note, self.tables, self.quantizers = b"", {}, {}
        self.coefficients = np.zeros((0, 64), np.int32)
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDA:
                found = _MARKER.search(data, at)
                if not found:
                    raise ValueError("a scan has no end")
                self._scan(body, data[at : found.start()])
                at = found.start()
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    self.quantizers[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
                    body = body[65:]
            elif marker == 0xFE:
                self.note = body
            elif marker == 0xDD or 0xC0 <= marker <= 0xCF:
                raise ValueError(f"marker {marker:x} is not read here")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        if tuple((p[1] >> 4, p[1] & 15) for p in parts) != SAMPLING or self.height % 16 or self.width % 16:
            raise ValueError("another sampling or shape than is read here")
        self.ids, self.of = [p[0] for p in parts], [p[2] for p in parts]
        self.mcus = self.width // 16, self.height // 16
        self.borders = np.cumsum([0, *(self.mcus[0] * h * self.mcus[1] * v for h, v in SAMPLING)])
        self.coefficients = np.zeros((int(self.borders[-1]), 64), np.int32)

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        parts = [(self.ids.index(head[1 + 2 * i]), head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        low, top, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        bits = Bits(data)
        if low == 0:
            order = mcu_order(*self.mcus) if n > 1 else np.arange(*self.borders[parts[0][0] : parts[0][0] + 2])
            if ah:
                self.coefficients[order, 0] |= bits.take(len(order)).astype(np.int32) << al
            else:
                self._dc(bits, order, {c: self.tables[0, t] for c, t, _ in parts}, al)
        else:
            c, _, t = parts[0]
            band = self.coefficients[self.borders[c] : self.borders[c + 1], low : top + 1]
            (self._refine if ah else self._first)(bits, band, self.tables[1, t], al)

    def _dc(self, bits: Bits, order: np.ndarray, by: dict[int, Table], al: int) -> None:
        """Where each difference starts depends on those before: one look per bit says where the next would start, then they are walked."""
        padded = np.concatenate([bits.bits, np.ones(32, np.uint8)]).astype(np.int64)
        window = np.zeros(len(bits.bits) + 1, np.int64)
        for i in range(16):
            window = window << 1 | padded[i : i + len(window)]
        place = np.searchsorted(self.borders, order, side="right") - 1
        same = len(set(map(id, by.values()))) == 1
        hops, looks = {}, {}
        for c, t in by.items():
            length, size = (x[window] for x in t.look)
            looks[c] = length, size
            hops[c] = (np.arange(len(window)) + np.where(length > 0, length + size, 1 << 40)).tolist()
        at, starts = 0, []
        try:
            if same:
                hop = next(iter(hops.values()))
                for _ in range(len(order)):
                    starts.append(at)
                    at = hop[at]
            else:
                for c in place.tolist():
                    starts.append(at)
                    at = hops[c][at]
        except IndexError:
            raise ValueError("a DC scan ends too early") from None
        starts = np.array(starts, dtype=np.int64)
        for c, (length, size) in looks.items():
            mine = np.flatnonzero(place == c)
            s = starts[mine]
            n, z = length[s], size[s]
            # the extra bits, at most 11, from the window after the code
            extra = window[np.minimum(s + n, len(window) - 1)] >> (16 - z)
            self.coefficients[order[mine], 0] = np.cumsum(np.where(z > 0, extend(extra, z), 0)) << al

    def _first(self, bits: Bits, band: np.ndarray, table: Table, al: int) -> None:
        if len(table.symbols) == 1 and 0 < table.symbols[0] < 16:
            # the only symbol is "the next coefficient has this size": all take the same number of bits
            size, (code, length) = table.symbols[0], table.code[table.symbols[0]]
            rows = bits.take(band.size * (length + size)).reshape(band.size, -1)
            if (rows[:, :length] != [code >> length - 1 - i & 1 for i in range(length)]).any():
                raise ValueError("no such Huffman code")
            value = np.zeros(band.size, np.int32)
            for i in range(size):
                value = value << 1 | rows[:, length + i]
            value = extend(value, size)
            band[:] = (np.sign(value) * (np.abs(value) << al)).reshape(band.shape)
            return
        run = 0
        for row in band:
            if run:
                run -= 1
                continue
            k = 0
            while k < len(row):
                skip, size = divmod(bits.symbol(table), 16)
                if size == 0 and skip < 15:
                    run = (1 << skip) - 1 + (bits.number(skip) if skip else 0)
                    break
                k += skip
                if size:
                    v = int(extend(np.array(bits.number(size)), size))
                    row[k] = v << al if v > 0 else -(-v << al)
                k += 1

    def _refine(self, bits: Bits, band: np.ndarray, table: Table, al: int) -> None:
        def correct(part: np.ndarray) -> None:
            known = part != 0
            more = bits.take(int(known.sum())).astype(np.int32) << al
            part[known] += np.sign(part[known]) * more

        b = 0
        while b < len(band):
            row, k = band[b], 0
            while k < len(row):
                skip, size = divmod(bits.symbol(table), 16)
                if size == 0 and skip < 15:
                    run = (1 << skip) + (bits.number(skip) if skip else 0)
                    # what is left of this block and the run's other blocks: one bit for each coefficient known so far
                    correct(row[k:])
                    correct(band[b + 1 : b + run])
                    b += run - 1
                    break
                sign = (1 if bits.number(1) else -1) if size else 0
                fresh = np.flatnonzero(row[k:] == 0)
                stop = k + int(fresh[skip]) if skip < len(fresh) else len(row)
                correct(row[k:stop])
                if sign and stop < len(row):
                    row[stop] = sign << al
                k = stop + 1
            b += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, 0 to 255."""
        out = []
        for c, (h, v) in enumerate(SAMPLING):
            x = self.coefficients[self.borders[c] : self.borders[c + 1]].astype(np.float32)
            s = (x * self.quantizers[self.of[c]]) @ inverse_cosine() + 128
            s = s.reshape(self.mcus[1] * v, self.mcus[0] * h, 8, 8).transpose(0, 2, 1, 3)
            out.append(np.rint(s).clip(0, 255).reshape(self.mcus[1] * v * 8, -1))
        return out

    def rgb(self) -> np.ndarray:
        """The picture in full resolution, (height, width, 3) of unsigned bytes; chroma samples are repeated."""
        y, cb, cr = self.planes()
        cb, cr = cb - 128, cr - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, part in enumerate((1.402 * cr, -0.344136 * cb - 0.714136 * cr, 1.772 * cb)):
            out[..., i] = np.rint(y + part.repeat(2, 0).repeat(2, 1)).clip(0, 255)
        return out


# --- payloads ------------------------------------------------------------------------------------------------------


def store(payload: bytes) -> bytes:
    """A picture whose blocks of 64 coefficients are the payload's units of 64 bytes.

    A byte is the eight extra bits of a coefficient of size 8, so it comes back exactly and is never 0. Units fill the
    blocks of Y, then Cb, then Cr; the rest stay zero bytes, and a comment holds the payload's length.
    """
    wide, high = shape_for(len(payload) // UNIT)
    units = np.zeros((wide * high * sum(h * v for h, v in SAMPLING), UNIT), np.int32)
    units.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write(extend(units, 8), wide, high, b"payload %d" % len(payload))


def payload_of(reader: Reader) -> bytes:
    n = int(reader.note.split()[1])
    v = reader.coefficients.reshape(-1)[:n]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def feature(rgb: np.ndarray) -> str:
    """Height, width, the channels' means and the tensor's checksum."""
    means = ",".join(f"{m:.3f}" for m in rgb.reshape(-1, 3).mean(0))
    return f"{rgb.shape[0]}x{rgb.shape[1]};{means};{zlib.crc32(rgb):08x}"


def media(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """One row for each row of docs: its text stored as a picture and read back from the stored bytes.

    With `tensors` also media (the stored bytes), height, width and rgb (bytes of the decoded tensor, row by row).
    Null text counts as empty, which is one unit of zero bytes. Equal texts give equal values. Columns beside doc_id
    and text are not read; repeated rows give repeated results; an empty table gives an empty one.
    """
    schema = SCHEMA + (", media binary, height int, width int, rgb binary" if tensors else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def one(doc: int | None, text: str | None) -> tuple:
        payload, n = padded(text)
        stored = store(payload)
        reader = Reader(stored)
        got, rgb = payload_of(reader), reader.rgb()
        out = doc, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(rgb)
        return (*out, stored, rgb.shape[0], rgb.shape[1], rgb.tobytes()) if tensors else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # tensors are large: few rows at a time then
            for i in range(0, batch.num_rows, 64 if tensors else batch.num_rows or 1):
                part = batch.slice(i, 64 if tensors else batch.num_rows)
                rows = [one(d, t.as_py()) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), run, schema)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(read(spark, sf_dir, "documents"))
