"""Lossless codecs of number arrays as Arrow functions (array column to binary column and back).

Parquet does the storage; these exist so that blocks of the codecs' formats can be made,
read and sized. Each codes a whole array at a time in numpy; only the XOR decoder walks
value by value, as each width is known only from the one before.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK, LIMIT, LEAD_BITS, WIDTH_BITS = 128, 255, 5, 7


def _bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of each value, most significant first, as one array of 0 and 1."""
    total = int(widths.sum())
    owner = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    return ((values[owner] >> (widths[owner] - 1 - place).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64; 64 for zero."""
    n = np.full(len(x), 64)
    y = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = y >= np.uint64(1) << np.uint64(s)
        n[big] -= s
        y[big] >>= np.uint64(s)
    return np.where(x > 0, n - 1, 64)


def _trailing(x: np.ndarray) -> np.ndarray:
    """Trailing zero bits of 64; 63 for zero."""
    low = x & (~x + np.uint64(1))
    return np.where(x > 0, 63 - _leading(np.where(x > 0, low, np.uint64(1))), 63)


def xor_encode(x: np.ndarray) -> bytes:
    """u32 count, u32 bits, the first 64 bits, then for each value a 0 if it repeats, or 1, leading zeros (31 at most), width and payload."""
    raw = np.asarray(x, np.float64).view(np.uint64)
    if not len(raw):
        return struct.pack("<II", 0, 0)
    d = raw[1:] ^ raw[:-1]
    lead = np.minimum(_leading(d), (1 << LEAD_BITS) - 1)
    trail = _trailing(d)
    width = 64 - lead - trail
    new = d != 0
    head = np.where(new, (np.uint64(1) << np.uint64(LEAD_BITS + WIDTH_BITS)) | (lead.astype(np.uint64) << np.uint64(WIDTH_BITS)) | width.astype(np.uint64), np.uint64(0))
    values = np.stack([head, np.where(new, d >> trail.astype(np.uint64), np.uint64(0))], 1).ravel()
    widths = np.stack([np.where(new, 1 + LEAD_BITS + WIDTH_BITS, 1), np.where(new, width, 0)], 1).ravel()
    bits = _bits(np.r_[raw[:1], values], np.r_[64, widths].astype(np.int64))
    return struct.pack("<II", len(raw), len(bits)) + np.packbits(bits).tobytes()


def xor_decode(b: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<II", b)
    if not n:
        return np.zeros(0)
    stream, at = int.from_bytes(b[8:], "big"), 8 * (len(b) - 8)

    def take(k: int) -> int:
        nonlocal at
        at -= k
        return stream >> at & (1 << k) - 1

    if len(b) < 1000:
        out = [take(64)]
        while len(out) < n:
            if take(1):
                lead, width = take(LEAD_BITS), take(WIDTH_BITS)
                out.append(out[-1] ^ take(width) << 64 - lead - width)
            else:
                out.append(out[-1])
        return np.array(out, np.uint64).view(np.float64)
    # Long streams: words of 128 bits at any byte, so that no step touches the whole stream.
    buf, pos = b[8:] + bytes(24), 0

    def pick(k: int) -> int:
        nonlocal pos
        first, skip = divmod(pos, 8)
        pos += k
        return int.from_bytes(buf[first : first + 10], "big") >> 80 - skip - k & (1 << k) - 1

    out = [pick(64)]
    while len(out) < n:
        if pick(1):
            lead, width = pick(LEAD_BITS), pick(WIDTH_BITS)
            out.append(out[-1] ^ pick(width) << 64 - lead - width)
        else:
            out.append(out[-1])
    return np.array(out, np.uint64).view(np.float64)


def zigzag(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> np.uint64(1)).view(np.int64) ^ -((z & np.uint64(1)).view(np.int64))


def pack_encode(x: np.ndarray) -> bytes:
    """u64 count, then blocks of 128 values: u8 width, u8 length, zigzag values of that width, least significant bit first."""
    z, out = zigzag(x), [struct.pack("<Q", len(x))]
    for i in range(0, len(z), BLOCK):
        part = z[i : i + BLOCK]
        width = max(1, int(part.max()).bit_length())
        bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        out.append(bytes([width, len(part)]) + np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def pack_decode(b: bytes) -> np.ndarray:
    (n,), at, out = struct.unpack_from("<Q", b), 8, [np.zeros(0, np.uint64)]
    while n > 0:
        width, size = b[at], b[at + 1]
        length = -(-width * size // 8)
        bits = np.unpackbits(np.frombuffer(b, np.uint8, length, at + 2), bitorder="little")[: width * size].reshape(size, width)
        out.append((bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64))
        at, n = at + 2 + length, n - size
    return unzigzag(np.concatenate(out))


def counts_encode(x: np.ndarray) -> bytes:
    """Values of 0 to 255 as bytes, deflated; all others as exceptions (place and value, packed). Negatives are kept."""
    x = np.asarray(x, np.int64)
    odd = np.flatnonzero((x < 0) | (x > LIMIT))
    main = zlib.compress(np.clip(x, 0, LIMIT).astype(np.uint8).tobytes(), 6)
    place, value = pack_encode(np.diff(odd, prepend=0)), pack_encode(x[odd])
    return struct.pack("<QQQ", len(x), len(main), len(place)) + main + place + value


def counts_decode(b: bytes) -> np.ndarray:
    n, main, place = struct.unpack_from("<QQQ", b)
    out = np.frombuffer(zlib.decompress(b[24 : 24 + main]), np.uint8, n).astype(np.int64)
    at = 24 + main
    out[np.cumsum(pack_decode(b[at : at + place]))] = pack_decode(b[at + place :])
    return out


def floats_encode(x: np.ndarray) -> bytes:
    """A tag byte and the smaller of the XOR stream (G) and the deflated values (Z)."""
    x = np.asarray(x, np.float64)
    a, b = xor_encode(x), zlib.compress(x.tobytes(), 6)
    return b"G" + a if len(a) <= len(b) else b"Z" + b


def floats_decode(b: bytes) -> np.ndarray:
    if b[:1] == b"G":
        return xor_decode(b[1:])
    if b[:1] == b"Z":
        return np.frombuffer(zlib.decompress(b[1:]), np.float64)
    raise ValueError(f"unknown float block {b[:1]!r}")


def table_encode(columns: dict[str, np.ndarray], **head: object) -> bytes:
    """A JSON header, a zero byte and the columns in half precision, deflated."""
    note = json.dumps(head | {"columns": {k: len(v) for k, v in columns.items()}}).encode()
    with np.errstate(over="ignore"):
        body = b"".join(np.asarray(v, np.float64).astype(np.float16).tobytes() for v in columns.values())
    return zlib.compress(note + b"\0" + body, 6)


def table_decode(b: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    note, _, body = zlib.decompress(b).partition(b"\0")
    head, at, out = json.loads(note), 0, {}
    for k, n in head.pop("columns").items():
        out[k], at = np.frombuffer(body, np.float16, n, at), at + 2 * n
    return head, out


def _encoder(fn, kind: str):
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else fn(np.array(v.as_py(), kind)) for v in x], pa.binary())

    return run


def _decoder(fn, kind: str):
    item = {"double": pa.float64(), "bigint": pa.int64()}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else fn(v.as_py()).tolist() for v in x], pa.list_(item))

    return run


def xor_pack(c: Column) -> Column:
    return _encoder(xor_encode, "float64")(c)


def xor_unpack(c: Column) -> Column:
    return _decoder(xor_decode, "double")(c)


def bit_pack(c: Column) -> Column:
    return _encoder(pack_encode, "int64")(c)


def bit_unpack(c: Column) -> Column:
    return _decoder(pack_decode, "bigint")(c)


def counts_pack(c: Column) -> Column:
    return _encoder(counts_encode, "int64")(c)


def counts_unpack(c: Column) -> Column:
    return _decoder(counts_decode, "bigint")(c)


def floats_pack(c: Column) -> Column:
    return _encoder(floats_encode, "float64")(c)


def floats_unpack(c: Column) -> Column:
    return _decoder(floats_decode, "double")(c)


def deflated_size(c: Column, level: int = 6) -> Column:
    """Bytes of the deflated binary."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else len(zlib.compress(v.as_py(), level)) for v in x], pa.int64())

    return run(c.cast("binary"))


def half(c: Column) -> Column:
    """The value rounded to half precision; infinite beyond it."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            y = x.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
        return pa.array(y, pa.float64(), mask=np.asarray(x.is_null()))

    return run(c.cast("double"))
