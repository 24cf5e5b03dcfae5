import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from quillgraph.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 384, 385, 5000, 40_000])
def test_round_trip(n):
    rng = random.Random(n)
    text = "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(n))
    payload, size = M.padded(text)
    assert size == len(text.encode()) and len(payload) % 64 == 0 and payload and payload.startswith(text.encode())
    assert M.payload_of(M.Reader(M.store(payload))) == payload


def test_every_byte_comes_back():
    payload = bytes(range(256)) * 3 + b"\0" * 64 + b"\xff" * 64
    assert M.payload_of(M.Reader(M.store(payload))) == payload


def test_inverse_transform_is_the_formula():
    rng = np.random.default_rng(0)
    c = rng.integers(-50, 50, 64)
    natural = np.zeros(64)
    natural[M.zigzag()] = c
    f = natural.reshape(8, 8)
    k = lambda u: 1 / math.sqrt(2) if u == 0 else 1.0
    want = [[sum(k(u) * k(v) / 4 * f[v][u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose((c @ M.inverse_cosine()).reshape(8, 8), want, atol=1e-3)


def test_zigzag():
    assert M.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(M.zigzag()) == list(range(64))


def test_tensor():
    r = M.Reader(M.store(M.padded("some text " * 100)[0]))
    rgb = r.rgb()
    assert rgb.shape == (r.height, r.width, 3) and rgb.dtype == np.uint8
    y, cb, cr = (p[5 // s, 9 // s] for p, s in zip(r.planes(), (1, 2, 2), strict=True))
    assert rgb[5, 9, 0] == np.clip(np.rint(y + 1.402 * (cr - 128)), 0, 255)
    assert M.feature(rgb).endswith(f"{zlib.crc32(rgb.tobytes()):08x}")


def put(bits, value, n):
    bits.extend(value >> (n - 1 - i) & 1 for i in range(n))


def first_scan(rows, al, table):
    """An encoder of first scans written for the test: runs of zeros, ends of bands and their runs."""
    bits, ended = [], 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            put(bits, *table.code[n << 4])
            put(bits, ended - (1 << n), n)
            ended = 0

    for r in rows:
        v = [int(np.sign(x)) * (abs(int(x)) >> al) for x in r]
        last = max((i for i, x in enumerate(v) if x), default=-1)
        zeros = 0
        if last >= 0:
            flush()
        for x in v[: last + 1]:
            if not x:
                zeros += 1
                continue
            while zeros > 15:
                put(bits, *table.code[0xF0])
                zeros -= 16
            s = abs(x).bit_length()
            put(bits, *table.code[zeros << 4 | s])
            put(bits, x if x > 0 else x + (1 << s) - 1, s)
            zeros = 0
        ended += last < len(v) - 1
    flush()
    return np.array(bits, np.uint8)


def refining_scan(rows, al, table):
    bits = []
    for r in rows:
        mag = [abs(int(x)) >> al for x in r]
        last = max((i for i, m in enumerate(mag) if m == 1), default=-1)
        zeros, corrections = 0, []
        for k, m in enumerate(mag[: last + 1]):
            if m == 0:
                zeros += 1
                if zeros == 16:
                    put(bits, *table.code[0xF0])
                    bits += corrections
                    corrections, zeros = [], 0
            elif m > 1:
                corrections.append(m & 1)
            else:
                put(bits, *table.code[zeros << 4 | 1])
                bits += [int(r[k] > 0), *corrections]
                corrections, zeros = [], 0
        if last < len(mag) - 1:
            put(bits, *table.code[0])
            bits += corrections + [m & 1 for m in mag[last + 1 :] if m > 1]
    return np.array(bits, np.uint8)


@pytest.mark.parametrize("density", [0.02, 0.15, 0.6])
def test_general_scans(density):
    rng = np.random.default_rng(3)
    table = M.Table.even(sorted({z << 4 | s for z in range(16) for s in range(8)}))
    x = (rng.integers(-100, 100, (40, 63)) * (rng.random((40, 63)) < density)).astype(np.int32)
    x[5:8] = 0
    reader = M.Reader.__new__(M.Reader)
    for al in (0, 1, 2):
        band = np.zeros_like(x)
        reader._first(M.Bits(M.stuffed(first_scan(x, al, table))), band, table, al)
        assert (band == np.sign(x) * (abs(x) >> al << al)).all()
    band = np.sign(x) * (abs(x) >> 1 << 1)
    reader._refine(M.Bits(M.stuffed(refining_scan(x, 0, table))), band, table, 0)
    assert (band == x).all()


def test_broken_files():
    data = M.store(M.padded("x" * 500)[0])
    for bad in (b"", b"\x89PNG", data[: len(data) // 2]):
        with pytest.raises((ValueError, IndexError)):
            M.Reader(bad)


def test_operator(spark):
    df = spark.createDataFrame([(1, "text"), (2, "text"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.media(df, tensors=True).collect()}
    payload = b"text" + bytes(60)
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[1].tail_crc32 == zlib.crc32(payload) and got[1].n_bytes == 4
    assert got[1].media_sha256 == got[2].media_sha256 == hashlib.sha256(got[1].media).hexdigest() and got[1].media_bytes == len(got[1].media)
    assert (got[3].n_bytes, got[3].payload_bytes) == (0, 64) and len(got[1].rgb) == got[1].height * got[1].width * 3
