"""Scalar rules of the key-value model as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The slot count, and the generator of the CRC that places keys.
SLOTS, CRC16_POLYNOMIAL = 16384, 0x1021
#: Longest text that may be an integer, and longest short string.
INT_BYTES, SHORT_BYTES = 20, 44


def strict_long(text: Column) -> Column:
    """The integer a text spells canonically (no sign but a minus, no leading zeros, no spaces, in range), else null."""
    return F.when(text.rlike(r"\A(0|-?[1-9][0-9]*)\z"), text.try_cast("bigint"))


def strict_unsigned(text: Column) -> Column:
    """As ``strict_long`` for 0 to 2**64 - 1, as DECIMAL(20,0)."""
    value = F.when(text.rlike(r"\A(0|[1-9][0-9]{0,19})\z"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def strict_double(text: Column) -> Column:
    """A finite or infinite number without spaces, suffixes or NaN; else null."""
    lower = F.lower(text)
    endless = lower.rlike(r"\A[+-]?(inf|infinity)\z")
    number = lower.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z")
    return F.when(endless, F.when(lower.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(number, text.try_cast("double"))


def encoding(text: Column) -> Column:
    """How a string value is held: int, embstr or raw."""
    size = F.octet_length(text)
    return F.when((size <= INT_BYTES) & strict_long(text).isNotNull(), "int").when(size <= SHORT_BYTES, "embstr").otherwise("raw")


def _crc16_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 & 0xFFFF) ^ (CRC16_POLYNOMIAL if crc & 0x8000 else 0)
        out.append(crc)
    return out


_CRC16 = _crc16_table()


def crc16(text: Column) -> Column:
    """CRC-16 of the UTF-8 bytes, most significant bit first, from 0: a lookup a byte."""
    table = F.array(*map(F.lit, _CRC16))
    digits = F.hex(text.cast("binary"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<int>"))
    return F.aggregate(octets, F.lit(0), lambda crc, o: F.shiftleft(crc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(o))))


def hash_tag(key: Column) -> Column:
    """What of a key places it: the text in its first braces if there is any, else all of it."""
    tag = F.regexp_extract(key, r"\A[^{]*\{([^}]+)\}", 1)
    return F.when(F.length(tag) > 0, tag).otherwise(key)


def slot(key: Column) -> Column:
    return crc16(hash_tag(key)).bitwiseAND(SLOTS - 1)


def shard(key: Column, shards: int) -> Column:
    """``shards`` is a power of two."""
    return slot(key).bitwiseAND(shards - 1)


def shard_of(key: str, shards: int) -> int:
    """The same for one key on the driver."""
    data = key.encode()
    opened = data.find(b"{")
    closed = data.find(b"}", opened + 1) if opened >= 0 else -1
    if closed > opened + 1:
        data = data[opened + 1 : closed]
    crc = 0
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ byte]
    return crc & (SLOTS - 1) & (shards - 1)


def reversed_bits(x: Column, width: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10).cast("long")


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a glob of ``*``, ``?``, ``[a-z]``, ``[^...]`` and ``\\x``; an unclosed class runs to the end."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < n:
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            spans = []
            while i < n and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < n:
                    i += 1
                    spans.append((pattern[i], pattern[i]))
                elif i + 2 < n and pattern[i + 1] == "-":
                    spans.append(tuple(sorted((pattern[i], pattern[i + 2]))))
                    i += 2
                else:
                    spans.append((pattern[i], pattern[i]))
                i += 1
            i += 1
            if spans:
                out.append(f"[{'^' if negated else ''}{''.join(f'\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}' for a, b in spans)}]")
            else:  # an empty class matches nothing, its negation anything
                out.append("." if negated else "(?!)")
        else:
            out.append(re.escape(c))
    return rf"(?s)\A{''.join(out)}\z"


def glob(column: Column, pattern: str) -> Column:
    """Whether the column matches; a plain prefix becomes ``startswith``, which scans can push down."""
    if pattern == "*":
        return F.lit(True)
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return column.startswith(pattern[:-1])
    if not re.search(r"[*?\[\\]", pattern):
        return column == pattern
    return column.rlike(glob_regex(pattern))


#: Units of memory sizes.
UNITS = {"": 1, "b": 1, "k": 1000, "kb": 1024, "m": 1000**2, "mb": 1024**2, "g": 1000**3, "gb": 1024**3}


def memory_size(text: str) -> int | None:
    """Bytes of a size like ``100mb``; None if it is not one or leaves 64 bits."""
    found = re.fullmatch(r"([0-9]+)([a-z]*)", text.lower())
    if not found or found[2] not in UNITS:
        return None
    size = int(found[1]) * UNITS[found[2]]
    return size if size < 2**64 else None
