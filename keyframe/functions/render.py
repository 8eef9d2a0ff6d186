"""Exact text renderings of frames as Column expressions: raw, table, md, csv, jsonl, hex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import FrameDataset
from ..errors import SchemaError
from ..types import INTEGERS, Family, Field

FORMATS = ("raw", "table", "md", "csv", "jsonl", "hex")
#: Decimal digits of an integer by width, rendered width of floats and of timestamps.
INTEGER_DIGITS, FLOAT_WIDTH = {1: 3, 2: 5, 4: 10, 8: 20}, {4: 16, 8: 24, 16: 34}
TIME_WIDTH = {"unix-seconds": 20, "unix-milliseconds": 24, "unix-microseconds": 27, "unix-nanoseconds": 30}
TIME_DIGITS = {"unix-seconds": 0, "unix-milliseconds": 3, "unix-microseconds": 6, "unix-nanoseconds": 9}


def is_null(f: Field, c: Column) -> Column:
    """The display rule: a signed fixed-point or percent field at its type's least value."""
    if f.family == Family.SIGNED and f.semantic.kind in ("fixed", "percent"):
        return c == F.lit(f.limits()[0])
    return F.lit(False)


def _without_exponent(text: Column) -> Column:
    """`-1.25E-7` as `-0.000000125`: the shortest digits, moved by their exponent, however large."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([^E]*)", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    n = F.length(digits)
    split = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))
    large = F.when(n > power + 1, split).otherwise(F.rpad(digits, power + 1, F.lit("0")))
    return F.concat(sign, F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(large))


def plain(f: Field, c: Column) -> Column:
    """Integers and strings as they are; floats without exponent or a trailing `.0`."""
    if f.family == Family.FLOAT and not f.is_decimal:
        text = c.cast("string")
        exact = F.when(text.contains("E"), _without_exponent(text)).otherwise(F.regexp_replace(text, r"\.0$", ""))
        return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(exact)
    return c.cast("string")


def grouped(c: Column) -> Column:
    return F.format_number(c, 0)


def fixed_point(c: Column, points: int, percent: bool = False) -> Column:
    """value / 10^points with grouped integer digits and exactly `points` decimals."""
    if points:
        unit = F.lit(10**points)
        whole, rest = F.abs(F.call_function("div", c, unit)), F.abs((c % unit).cast("long"))
        text = F.concat(F.when(c < 0, "-").otherwise(""), grouped(whole), F.lit("."), F.lpad(rest.cast("string"), points, "0"))
    else:
        text = grouped(c)
    return F.concat(text, F.lit("%")) if percent else text


def timestamp(c: Column, kind: str) -> Column:
    """`YYYY-MM-DDThh:mm:ss[.fff]Z` in UTC with 0, 3, 6 or 9 decimals; instants before 1970 are floored."""
    digits = TIME_DIGITS[kind]
    unit = F.lit(10**digits)
    c = c.cast("long")
    part = F.pmod(c, unit)
    seconds = F.floor((c - part) / unit) if digits == 0 else ((c - part).cast("decimal(20,0)") / unit).cast("long")
    none = F.lit(0)
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(none, none, none, seconds.cast("decimal(18,6)"))  # no zone takes part
    text = F.translate(at.cast("string"), " ", "T")
    return F.concat(text, F.lit("."), F.lpad(part.cast("string"), digits, "0"), F.lit("Z")) if digits else F.concat(text, F.lit("Z"))


def display(f: Field, c: Column) -> Column:
    """Null rule, then the semantic; NULL where the rule says so."""
    s = f.semantic
    if s.kind in ("fixed", "percent"):
        return F.when(~is_null(f, c), fixed_point(c, s.points, s.kind == "percent"))
    if s.kind.startswith("unix-"):
        return timestamp(c, s.kind)
    return plain(f, c)


def width(f: Field, strings: tuple[str, ...]) -> int:
    """Columns that the widest value of a field takes, its name at least."""
    s = f.semantic
    if s.kind in TIME_WIDTH:
        w = TIME_WIDTH[s.kind]
    elif s.kind in ("fixed", "percent"):
        whole = max(1, INTEGER_DIGITS[f.length] - s.points)
        w = whole + (whole - 1) // 3 + (1 + s.points if s.points else 0) + (s.kind == "percent") + (f.family == Family.SIGNED)
    elif f.family in INTEGERS:
        w = INTEGER_DIGITS[f.length] + (f.family == Family.SIGNED)
    elif f.family == Family.FLOAT:
        w = FLOAT_WIDTH[f.length]
    elif f.family == Family.UTF8:
        w = f.length
    else:
        w = max(map(len, strings), default=1)
    return max(w, len(f.name))


def _numeric(f: Field) -> bool:
    return f.family not in (Family.UTF8, Family.STRING_INDEX)


def _csv_cell(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _json_string(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    for i in (*range(8), 11, *range(14, 32)):
        out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _json_value(f: Field, c: Column) -> Column:
    if not _numeric(f):
        return _json_string(c)
    text = plain(f, c)
    if f.family == Family.FLOAT:
        text = F.when(text.isin("NaN", "inf", "-inf"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    return F.when(is_null(f, c), "null").otherwise(text)


def _float_bits(f: Field, c: Column) -> Column:
    """Lower-case hexadecimal of an IEEE number's bytes, lowest first; by arithmetic, since Spark has no cast to bits."""
    bits, mantissa, least = (64, 52, -1022) if f.length == 8 else (32, 23, -126)
    v = F.abs(c.cast("double"))
    e = F.greatest(F.floor(F.log2(v)).cast("int"), F.lit(least))
    e = F.when(v < F.pow(F.lit(2.0), e), e - 1).when(v >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)  # log2 may round past a power
    e = F.greatest(e, F.lit(least))
    scaled = v / F.pow(F.lit(2.0), e)  # exact: 1 to 2, or below 1 for the smallest numbers
    normal = scaled >= 1
    exponent = F.when(normal, e - least + 1).otherwise(0).cast("long")
    part = ((scaled - F.when(normal, 1.0).otherwise(0.0)) * float(1 << mantissa)).cast("long")
    special = ((1 << (bits - 1 - mantissa)) - 1) << mantissa
    body = F.when(F.isnan(c), F.lit(special | 1 << (mantissa - 1))).when(v == float("inf"), F.lit(special)).when(v == 0, F.lit(0).cast("long")).otherwise(F.shiftleft(exponent, mantissa) + part)
    big = F.lpad(F.hex(body.cast("long")), bits // 4, "0")
    top = F.conv(F.substring(big, 1, 1), 16, 10).cast("int")
    big = F.when(c.cast("string").startswith("-"), F.concat(F.hex((top + 8).cast("long")), F.substring(big, 2, 64))).otherwise(big)
    return F.lower(F.concat(*[F.substring(big, 2 * (f.length - i) - 1, 2) for i in range(f.length)]))


def _little_endian(f: Field, c: Column) -> Column:
    """Lower-case hexadecimal of a field's bytes."""
    n = f.length
    if f.family == Family.UTF8:
        raw = F.hex(c.cast("binary"))
        return F.lower(F.rpad(raw, 2 * n, "20"))
    if f.is_decimal:
        raise SchemaError("hex of a decimal needs its stored scale")
    if f.family == Family.FLOAT:
        return _float_bits(f, c)
    if n == 8 and f.family != Family.SIGNED:
        whole = c.cast("decimal(20,0)")
        top = F.floor(whole / F.lit(1 << 32)).cast("long")
        low = (whole - top.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)")).cast("long")
        big = F.concat(F.lpad(F.hex(top), 8, "0"), F.lpad(F.hex(low), 8, "0"))
    else:
        big = F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * n, 2 * n)
    return F.lower(F.concat(*[F.substring(big, 2 * (n - i) - 1, 2) for i in range(n)]))


def line(d: FrameDataset, fmt: str, codes: dict[str, str] | None = None) -> Column:
    """One frame as text. String-index fields hold their strings; for hex, codes names the columns of their positions."""
    s = d.schema
    cols = [(f, F.col(f"`{f.name}`")) for f in s.fields]
    if fmt == "raw":
        return F.concat_ws(" ", *[plain(f, c) for f, c in cols])
    if fmt == "csv":
        return F.concat_ws(",", *[_csv_cell(F.when(~is_null(f, c), plain(f, c))) for f, c in cols])
    if fmt == "jsonl":
        body = [F.concat(F.lit(f'"{f.name}":'), _json_value(f, c)) for f, c in cols]
        return F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))
    if fmt == "hex":
        return F.concat(*[_little_endian(f, F.col(f"`{codes[f.name]}`") if codes and f.name in codes else c) for f, c in cols])
    shown = [(f, F.coalesce(display(f, c), F.lit("NULL"))) for f, c in cols]
    if fmt == "md":
        return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c, F.lit("|"), F.lit("\\|")) for _, c in shown]), F.lit(" |"))
    if fmt == "table":
        pad = [(F.lpad if _numeric(f) else F.rpad)(c, F.greatest(F.lit(width(f, d.strings)), F.char_length(c)), F.lit(" ")) for f, c in shown]
        return F.rtrim(F.concat_ws("  ", *pad))
    raise SchemaError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")


def header(d: FrameDataset, fmt: str) -> list[str]:
    """Lines before the first frame."""
    names = d.schema.names
    if fmt == "csv":
        return [",".join(names)]
    if fmt == "md":
        return ["| " + " | ".join(names) + " |", "| " + " | ".join("---:" if _numeric(f) else "---" for f in d.schema.fields) + " |"]
    if fmt == "table":
        cells = [n.rjust(width(f, d.strings)) if _numeric(f) else n.ljust(width(f, d.strings)) for f, n in zip(d.schema.fields, names, strict=True)]
        return ["  ".join(cells).rstrip()]
    return []


def rendered(d: FrameDataset, fmt: str, codes: dict[str, str] | None = None) -> DataFrame:
    """(_frame_index, line) for every frame."""
    n = d.numbered()
    return n.df.select("_frame_index", line(n, fmt, codes).alias("line"))


def preview_cell(f: Field, c: Column) -> Column:
    """Grouped integers, floats with six decimals, decimals as hexadecimal, strings as they are."""
    if f.family in INTEGERS:
        return grouped(c)
    if f.is_decimal:
        return F.concat(F.lit("0x"), F.lower(F.hex(c.cast("string").cast("binary"))))
    if f.family == Family.FLOAT:
        return F.printf(F.lit("%.6f"), c.cast("double"))
    return c


def clean_utf8(c: Column) -> Column:
    """Bytes to text: bad UTF-8 replaced, trailing NULs and then trailing white space removed."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(c.cast("string")), "\\x00+$", ""), "(?U)\\s+$", "")


def toml(sections: dict[str, dict]) -> str:
    """Sections of typed values."""

    def value(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        text = str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f'"{text}"'

    return "\n".join(f"[{name}]\n" + "".join(f"{k} = {value(v)}\n" for k, v in body.items() if v is not None) for name, body in sections.items())
