"""Byte codecs and number text that Spark's own functions lack, as Arrow-batched functions."""

from __future__ import annotations

import math
import sys
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Polynomial (reflected) of the 64-bit CRC, its check value over "123456789", and the version that seals a dump.
CRC64_POLYNOMIAL, CRC64_CHECK, DUMP_VERSION = 0x95AC9329AC4BC9B5, 0xE9C6D914C4B8D9CA, 11


def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CRC64_POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_CRC64 = _table()


def crc64(data: bytes, crc: int = 0) -> int:
    for byte in data:
        crc = _CRC64[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc


_CRC64_COLUMN = np.array(_CRC64, np.uint64)
#: Values that are still worth a step over all of them at once.
_FEW = 16


def crc64_many(values: list[bytes]) -> list[int]:
    """Checksums of many values, one byte of all of them at a time; the longest few are finished alone."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    starts = np.cumsum(sizes) - sizes
    crc, at = np.zeros(len(values), np.uint64), 0
    while (n := int(np.searchsorted(-sizes, -at, "left"))) > _FEW:
        crc[:n] = _CRC64_COLUMN[((crc[:n] ^ data[starts[:n] + at]) & np.uint64(0xFF)).astype(np.int64)] ^ (crc[:n] >> np.uint64(8))
        at += 1
    out = [0] * len(values)
    for place, i in enumerate(order):
        out[i] = crc64(values[i][at:], int(crc[place])) if sizes[place] > at else int(crc[place])
    return out


def seal(value: bytes) -> bytes:
    """A value with its version and checksum behind it."""
    body = value + DUMP_VERSION.to_bytes(2, "little")
    return body + crc64(body).to_bytes(8, "little")


def unseal(payload: bytes) -> bytes | None:
    """The value, or None if the version is newer or the checksum is wrong."""
    if len(payload) < 10 or int.from_bytes(payload[-10:-8], "little") > DUMP_VERSION or crc64(payload[:-8]) != int.from_bytes(payload[-8:], "little"):
        return None
    return payload[:-10]


def float_text(x: float) -> str:
    """Text of a double: integers plainly up to 2**62, else the fewest digits that read back, as digits * 10**k.

    With k of 0 or more they are written out if fewer than seven zeros follow, below that as a decimal fraction if k is over -7 or the number is of the order of 1e-3 to 1e3, and else with an exponent.
    """
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if x.is_integer() and abs(x) < 2.0**62:
        return str(int(x))
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    order = len(text) + exponent - 1  # of the first digit
    if exponent >= 0 and abs(order) < len(text) + 7:
        text += "0" * exponent
    elif -7 < exponent < 0 or (exponent < 0 and abs(order) < 4):
        point = len(text) + exponent
        text = f"{text[:point]}.{text[point:]}" if point > 0 else "0." + "0" * -point + text
    else:
        text = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'-' if order < 0 else '+'}{abs(order)}"
    return "-" * sign + text


def human_text(x: float) -> str:
    """Seventeen decimals with the zeros at the end taken off."""
    text = f"{Decimal(x):.17f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


#: Bytes that are looked through for references at once; furthest reference; bytes of a match that are compared for all places together.
LZF_BLOCK, LZF_BACK, LZF_TOGETHER = 1 << 16, 8192, 12


def _lzf_matches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose three bytes stand up to 8 KiB before, the last such place, and how many bytes are equal, up to LZF_TOGETHER."""
    threes = data[:-2].astype(np.int32) << 16 | data[1:-1].astype(np.int32) << 8 | data[2:]
    order = np.argsort(threes, kind="stable")
    same = np.flatnonzero(threes[order[1:]] == threes[order[:-1]])
    here, there = order[same + 1], order[same]
    near = np.flatnonzero(here - there <= LZF_BACK)
    near = near[np.argsort(here[near])]
    here, there = here[near], there[near]
    size, going = np.full(len(here), 3), np.arange(len(here))
    for n in range(3, LZF_TOGETHER):
        going = going[here[going] + n < len(data)]
        going = going[data[here[going] + n] == data[there[going] + n]]
        size[going] += 1
    return here, there, size


def lzf_compress(data: bytes) -> bytes:
    """LZF: literal runs of up to 32 bytes, and references of 3 to 264 bytes up to 8 KiB back."""
    out, i, written = bytearray(), 0, 0

    def spill(stop: int) -> None:
        for at in range(written, stop, 32):
            part = data[at : min(at + 32, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    column = np.frombuffer(data, np.uint8)
    for start in range(0, len(data) - 2, LZF_BLOCK):
        low = max(0, start - LZF_BACK)
        block = column[low : start + LZF_BLOCK + LZF_TOGETHER]
        for here, at, n in zip(*((x + y).tolist() for x, y in zip(_lzf_matches(block), (low, low, 0), strict=True)), strict=True):
            if here < i or here < start:
                continue
            if here >= start + LZF_BLOCK:
                break
            if n == LZF_TOGETHER:
                most = min(264, len(data) - here)
                while n + 16 <= most and data[at + n : at + n + 16] == data[here + n : here + n + 16]:
                    n += 16
                while n < most and data[at + n] == data[here + n]:
                    n += 1
            spill(here)
            back, size = here - at - 1, n - 2
            out.append(min(size, 7) << 5 | back >> 8)
            if size >= 7:
                out.append(size - 7)
            out.append(back & 0xFF)
            i = written = here + n
    spill(len(data))
    return bytes(out)


def lzf_decompress(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        i += 1
        if head < 32:
            out += data[i : i + head + 1]
            i += head + 1
            continue
        size = head >> 5
        if size == 7:
            size += data[i]
            i += 1
        size += 2
        back = ((head & 31) << 8 | data[i]) + 1
        i += 1
        at = len(out) - back
        if size <= back:
            out += out[at : at + size]
        else:  # what is written is read again
            out += (out[at:] * (size // back + 1))[:size]
    return bytes(out)


def _udf(kind: str, f):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v)).astype(object)

    return run


def dump_udf():
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        bodies = [None if v is None else bytes(v) + DUMP_VERSION.to_bytes(2, "little") for v in values]
        sums = iter(crc64_many([b for b in bodies if b is not None]))
        return pd.Series([None if b is None else b + next(sums).to_bytes(8, "little") for b in bodies], dtype=object)

    return run


def restore_udf():
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        payloads = [b"" if v is None else bytes(v) for v in values]
        sums = crc64_many([p[:-8] for p in payloads])
        good = [len(p) >= 10 and int.from_bytes(p[-10:-8], "little") <= DUMP_VERSION and c == int.from_bytes(p[-8:], "little") for p, c in zip(payloads, sums, strict=True)]
        return pd.Series([p[:-10] if ok else None for p, ok in zip(payloads, good, strict=True)], dtype=object)

    return run


def float_text_udf():
    return _udf("string", float_text)


def lzf_checked(rows):
    """(doc_id, n_bytes, same) of (doc_id, text): whether each text comes back from LZF, and the bytes that come back."""

    @F.pandas_udf("binary")
    def there(values: pd.Series) -> pd.Series:
        return values.map(lambda v: lzf_compress(v.encode())).astype(object)

    @F.pandas_udf("binary")
    def back(values: pd.Series) -> pd.Series:
        return values.map(lambda v: lzf_decompress(bytes(v))).astype(object)

    found = rows.withColumn("again", back(there("text")))
    return found.select("doc_id", F.octet_length("again").cast("long").alias("n_bytes"), (F.col("again") == F.col("text").cast("binary")).alias("same"))
