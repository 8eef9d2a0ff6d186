"""Key values: parsing, byte form, total order."""

from __future__ import annotations

import struct
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KeyValueError
from ..types import INTEGERS, Family, Field

DECIMAL_SCALE_MAX, DECIMAL_BITS = 28, 96


def parse_key(field: Field, text: str) -> int | float | Decimal:
    """A key from text, by the key field's type."""
    try:
        if field.family in (*INTEGERS, Family.STRING_INDEX):
            value = int(text)
            lo, hi = field.limits()
            if not lo <= value <= hi or not text.strip() == text:
                raise ValueError
            return value
        if field.is_decimal:
            return Decimal(text)
        if field.family == Family.FLOAT:
            return float(text)
    except (ValueError, InvalidOperation):
        pass
    raise KeyValueError(f"{text!r} is not a {8 * field.length}-bit {field.family.name} key")


def encode_decimal(value: Decimal) -> bytes:
    """Three little-endian words of magnitude, then flags: scale in bits 16-23, sign in bit 31."""
    sign, digits, exponent = value.as_tuple()
    scale = max(0, -exponent)
    magnitude = int("".join(map(str, digits)) or "0") * 10 ** max(0, exponent)
    if scale > DECIMAL_SCALE_MAX or magnitude >> DECIMAL_BITS:
        raise KeyValueError(f"{value} does not fit a decimal field")
    return magnitude.to_bytes(12, "little") + struct.pack("<I", scale << 16 | sign << 31)


def decode_decimal(raw: bytes) -> Decimal:
    flags = struct.unpack("<I", raw[12:16])[0]
    scale = flags >> 16 & 0xFF
    if flags & 0x7F00FFFF or scale > DECIMAL_SCALE_MAX:
        raise KeyValueError("invalid decimal flags")
    return Decimal((flags >> 31, tuple(map(int, str(int.from_bytes(raw[:12], "little")))), -scale))


def encode_key(field: Field, value) -> bytes:
    if field.is_decimal:
        return encode_decimal(Decimal(value))
    if field.family == Family.FLOAT:
        return struct.pack("<f" if field.length == 4 else "<d", value)
    return int(value).to_bytes(field.length, "little", signed=field.family == Family.SIGNED)


def decode_key(field: Field, raw: bytes):
    if field.is_decimal:
        return decode_decimal(raw)
    if field.family == Family.FLOAT:
        return struct.unpack("<f" if field.length == 4 else "<d", raw[: field.length])[0]
    return int.from_bytes(raw[: field.length], "little", signed=field.family == Family.SIGNED)


def float_order(value: float, length: int = 8) -> int:
    """The place of a float in IEEE total order, as a signed integer."""
    bits = struct.unpack("<i" if length == 4 else "<q", struct.pack("<f" if length == 4 else "<d", value))[0]
    return bits if bits >= 0 else bits ^ ((1 << (8 * length - 1)) - 1)


def order_column(field: Field, column: Column | None = None) -> Column:
    """What a key is compared by: itself, or for floats (value, whether it is not the negative zero).

    Spark's own order puts NaN above all and takes the two zeros as equal; the second part
    tells them apart. NaNs are all one, above infinity.
    """
    c = F.col(f"`{field.name}`") if column is None else column
    if field.family != Family.FLOAT or field.is_decimal:
        return c
    return F.struct(c.cast("double").alias("value"), (c.cast("string") != "-0.0").alias("above"))


def key_of_order(field: Field, ordered):
    """The key that has an order value."""
    if field.family != Family.FLOAT or field.is_decimal:
        return ordered
    bits = ordered if ordered >= 0 else ordered ^ ((1 << (8 * field.length - 1)) - 1)
    return struct.unpack("<f" if field.length == 4 else "<d", struct.pack("<i" if field.length == 4 else "<q", bits))[0]


def order_lit(field: Field, ordered) -> Column:
    """A literal that order_column compares with, from a value of order_value."""
    if field.family != Family.FLOAT or field.is_decimal:
        return F.lit(ordered)
    value = key_of_order(field, ordered)
    return F.struct(F.lit(value).cast("double").alias("value"), F.lit(ordered >= 0 or value != 0).alias("above"))


def order_value(field: Field, value):
    """The literal that order_column's values are compared with."""
    if field.family == Family.FLOAT and not field.is_decimal:
        return float_order(value, field.length)
    return value


def fixed_string(value: str, length: int) -> bytes:
    """UTF-8 padded with spaces to length bytes; longer values are refused."""
    raw = value.encode()
    if len(raw) > length:
        raise KeyValueError(f"{value!r} is longer than {length} bytes")
    return raw.ljust(length, b" ")


def read_fixed_string(raw: bytes) -> str:
    """Strict UTF-8 without trailing spaces."""
    return raw.decode().rstrip(" ")


def display_string(raw: bytes) -> str:
    """Lossy UTF-8 without trailing NULs, then without trailing white space."""
    return raw.decode("utf-8", "replace").rstrip("\0").rstrip()
