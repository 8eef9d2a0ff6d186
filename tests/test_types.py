from decimal import Decimal

import pytest

from keyframe.errors import KeyValueError, SchemaError, SelectorError
from keyframe.functions import keys
from keyframe.plans.selectors import Selector, intervals, merge
from keyframe.types import Field, Schema, Semantic, richest

TICK = Schema.parse("Tick", "Time:i:4,Value:f:8,Str:utf8:4")


def test_schema_facts():
    assert TICK.frame_length == 16 and TICK.offsets() == [0, 4, 12] and TICK.key.name == "Time"
    assert Schema.from_dict(TICK.to_dict()) == TICK


@pytest.mark.parametrize("bad", ["a:i:3", "a:i:4,a:i:4", "a:f:2", "a:utf8:0,b:i:4", "a:f:8:unix-seconds", "a:i:4:fixed-9", ":i:4"])
def test_schema_rules(bad):
    with pytest.raises(SchemaError):
        Schema.parse("T", bad)


def test_key_rules():
    with pytest.raises(SchemaError):
        Schema.parse("T", "s:utf8:4")
    with pytest.raises(SchemaError):
        Schema.parse("T", "a:i:4", 1)
    with pytest.raises(SchemaError):
        Schema.parse("", "a:i:4")


def test_compatibility_ignores_semantics():
    timed = TICK.with_semantics({"Time": "unix-seconds"})
    assert timed != TICK and timed.compatible(TICK) and richest([TICK, timed]) is timed


@pytest.mark.parametrize("text,number", [("none", 0), ("unix-seconds", 1), ("unix-nanoseconds", 4), ("fixed-0", 6), ("fixed-8", 14), ("percent-0", 16), ("percent-8", 24)])
def test_semantic_ids(text, number):
    assert Semantic.parse(text).id == number and str(Semantic.from_id(number)) == text


@pytest.mark.parametrize("number", [5, 15, 25])
def test_reserved_semantics(number):
    with pytest.raises(SchemaError):
        Semantic.from_id(number)


@pytest.mark.parametrize("field,good,bad", [("k:i:1", "-128", "128"), ("k:u:8", str(2**64 - 1), "-1"), ("k:i:8", str(-(2**63)), "1.5"), ("k:f:8", "-0.0", "x"), ("k:f:16", "1.00", "y")])
def test_parse_key(field, good, bad):
    f = Field.parse(field)
    v = keys.parse_key(f, good)
    assert keys.decode_key(f, keys.encode_key(f, v)) == v
    with pytest.raises(KeyValueError):
        keys.parse_key(f, bad)


def test_decimal_bytes():
    raw = keys.encode_decimal(Decimal("-123.45"))
    assert raw == (12345).to_bytes(12, "little") + (2 << 16 | 1 << 31).to_bytes(4, "little")
    assert keys.decode_decimal(raw) == Decimal("-123.45")
    with pytest.raises(KeyValueError):
        keys.encode_decimal(Decimal(2) ** 96)
    with pytest.raises(KeyValueError):
        keys.decode_decimal(bytes(12) + (29 << 16).to_bytes(4, "little"))


def test_float_total_order():
    values = [-float("nan"), float("-inf"), -1.5, -0.0, 0.0, 1.0, float("inf"), float("nan")]
    order = [keys.float_order(v) for v in values]
    assert order[1:] == sorted(order[1:]) and keys.float_order(-0.0) < keys.float_order(0.0)


def test_fixed_strings():
    assert keys.fixed_string("AB", 4) == b"AB  " and keys.read_fixed_string(b"AB  ") == "AB"
    assert keys.display_string(b"AB\t\0\0") == "AB" and keys.display_string(b"A\xff") == "A�"
    with pytest.raises(KeyValueError):
        keys.fixed_string("é" * 3, 4)


def test_selectors():
    f = Field.parse("k:i:4")
    assert Selector.parse(f, "5") == Selector(5, 5) and Selector.parse(f, "..-3") == Selector(None, -3) and Selector.parse(f, "2..") == Selector(2, None)
    for bad in ("..", "3..2", "1...2", "1..2..3", "a"):
        with pytest.raises((SelectorError, KeyValueError)):
            Selector.parse(f, bad)
    got = intervals(f, [Selector.parse(f, t) for t in ("18..", "2", "5..7", "..0", "6")])
    assert got == [(None, 0), (2, 2), (5, 7), (18, None)]
    assert intervals(f, [Selector(5, 2)]) == []


def test_merge_touching_ranges():
    assert merge([(18, 20), (2, 3), (5, 7), (0, 1), (7, 8), (4, 4)]) == [(0, 1), (2, 3), (5, 8), (18, 20)]
