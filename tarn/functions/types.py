"""Catalog type strings and Spark types. Nested types are trees of columns with ids of their own."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import types as T

from ..errors import UnsupportedUnionTypeError

#: Canonical names and their SQL aliases. Fixed values.
NAMES = {
    "boolean": ["bool", "logical"], "int8": ["tinyint"], "int16": ["smallint", "short"], "int32": ["int", "integer", "signed"], "int64": ["bigint", "long"],
    "uint8": ["utinyint"], "uint16": ["usmallint"], "uint32": ["uinteger", "uint"], "uint64": ["ubigint"], "int128": ["hugeint"], "uint128": ["uhugeint"],
    "float32": ["float", "real", "float4", "float16"], "float64": ["double", "float8"], "varchar": ["text", "string", "char", "bpchar"], "blob": ["bytea", "binary", "varbinary"],
    "date": [], "time": ["timetz", "time_tz", "time_ns", "time with time zone"], "timestamp": ["datetime", "timestamp_us", "timestamp_s", "timestamp_ms", "timestamp_ntz"],
    "timestamp_ns": [], "timestamptz": ["timestamp_tz", "timestamp with time zone"], "interval": [], "uuid": [], "json": [], "variant": [], "bit": [], "unknown": [],
    "geometry": [
        "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection", "linestring_z", "point_z", "polygon_z",
        "multipoint_z", "multilinestring_z", "multipolygon_z", "geometrycollection_z", "point_m", "linestring_m", "polygon_m", "multipoint_m", "multilinestring_m",
        "multipolygon_m", "geometrycollection_m", "point_zm", "linestring_zm", "polygon_zm", "multipoint_zm", "multilinestring_zm", "multipolygon_zm", "geometrycollection_zm", "wkb_blob",
    ],
}
ALIASES = {a: name for name, others in NAMES.items() for a in [name, *others]}
SPARK = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "int128": T.DecimalType(38, 0),
    "uint128": T.DecimalType(38, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "varchar": T.StringType(), "blob": T.BinaryType(),
    "date": T.DateType(), "time": T.StringType(), "timestamp": T.TimestampNTZType(), "timestamp_ns": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "interval": T.DayTimeIntervalType(), "uuid": T.StringType(), "json": T.StringType(), "variant": T.StringType(), "bit": T.StringType(), "unknown": T.StringType(), "geometry": T.BinaryType(),
}
FIELD_ID = "parquet.field.id"


@dataclass
class Node:
    """A column or a part of one: ``kind`` is a canonical type, or list, struct, map with ``children``."""

    name: str
    kind: str
    children: list[Node] = field(default_factory=list)
    id: int = 0

    def text(self) -> str:
        if self.kind == "list":
            return f"list({self.children[0].text()})"
        if self.kind == "struct":
            return "struct(" + ", ".join(f'"{c.name}" {c.text()}' for c in self.children) + ")"
        if self.kind == "map":
            return f"map({self.children[0].text()}, {self.children[1].text()})"
        return self.kind

    def spark(self, of: dict[int, str] | None = None) -> T.DataType:
        """With ``of``, leaves have the types given by id."""
        if self.kind == "list":
            return T.ArrayType(self.children[0].spark(of))
        if self.kind == "map":
            return T.MapType(self.children[0].spark(of), self.children[1].spark(of))
        if self.kind == "struct":
            return T.StructType([c.field(of) for c in self.children])
        kind = (of or {}).get(self.id, self.kind)
        if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
            return T.DecimalType(int(m[1]), int(m[2]))
        return SPARK[kind]

    def field(self, of: dict[int, str] | None = None) -> T.StructField:
        return T.StructField(self.name, self.spark(of), True, {FIELD_ID: self.id} if self.id else None)




def parse(name: str, text: str) -> Node:
    """The tree of a type string, such as ``struct(a int, "b c" list(text))`` or ``decimal(10,2)[]``."""
    s, at = text.strip(), 0

    def fail() -> ValueError:
        return ValueError(f"Unknown type: {text}")

    def skip() -> None:
        nonlocal at
        while at < len(s) and s[at].isspace():
            at += 1

    def expect(c: str) -> None:
        nonlocal at
        skip()
        if s[at : at + 1] != c:
            raise fail()
        at += 1

    def word() -> str:
        nonlocal at
        skip()
        if m := re.compile(r'"((?:[^"]|"")*)"|([A-Za-z_]\w*)').match(s, at):
            at = m.end()
            return m[2] or m[1].replace('""', '"')
        raise fail()

    def one(label: str) -> Node:
        nonlocal at
        skip()
        if m := re.compile(r"((?:timestamp|time) with time zone|[A-Za-z_]\w*)", re.I).match(s, at):
            at = m.end()
            kind = m[1].lower()
        else:
            raise fail()
        if kind in ("decimal", "numeric"):
            p, q = 18, 3
            if m := re.compile(r"\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)").match(s, at):
                at, p, q = m.end(), int(m[1]), int(m[2] or 0)
            node = Node(label, f"decimal({p},{q})")
        elif kind in ("struct", "row"):
            expect("(")
            parts = []
            while True:
                parts.append(one(word()))
                skip()
                if s[at : at + 1] != ",":
                    break
                at += 1
            expect(")")
            node = Node(label, "struct", parts)
        elif kind in ("list", "map"):
            expect("(")
            parts = [one("element" if kind == "list" else "key")]
            if kind == "map":
                expect(",")
                parts.append(one("value"))
            expect(")")
            node = Node(label, kind, parts)
        elif kind == "union":
            raise UnsupportedUnionTypeError(f"column '{name}': union types are not supported ({text}); use a struct with a part for each")
        elif kind in ALIASES:
            node = Node(label, ALIASES[kind])
            if m := re.compile(r"\s*\(\s*\d+\s*\)").match(s, at):  # varchar(20)
                at = m.end()
        else:
            raise fail()
        while m := re.compile(r"\s*\[\s*\d*\s*\]").match(s, at):
            at = m.end()
            node.name = "element"
            node = Node(label, "list", [node])
        return node

    node = one(name)
    skip()
    if at != len(s):
        raise fail()
    return node


def from_spark(name: str, t: T.DataType) -> Node:
    if isinstance(t, T.ArrayType):
        return Node(name, "list", [from_spark("element", t.elementType)])
    if isinstance(t, T.MapType):
        return Node(name, "map", [from_spark("key", t.keyType), from_spark("value", t.valueType)])
    if isinstance(t, T.StructType):
        return Node(name, "struct", [from_spark(f.name, f.dataType) for f in t.fields])
    if isinstance(t, T.DecimalType):
        return Node(name, f"decimal({t.precision},{t.scale})")
    simple = {"boolean": "boolean", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "binary": "blob", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "void": "int32"}
    if t.simpleString() in simple:
        return Node(name, simple[t.simpleString()])
    if isinstance(t, T.DayTimeIntervalType):
        return Node(name, "interval")
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return Node(name, "varchar")
    if isinstance(t, T.VariantType):
        raise UnsupportedUnionTypeError(f"column '{name}': values of several types ({t.simpleString()}) have no column type; use a struct with a part for each")
    raise ValueError(f"Unknown type: {t.simpleString()}")


def to_text(value) -> str | None:
    """A statistic or partition value as the catalog writes it."""
    if value is None or isinstance(value, (bool, bytes, list, dict)):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat(" ", "microseconds" if value.microsecond else "seconds") if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None).isoformat(" ") + "+00"
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    return repr(value) if isinstance(value, float) else str(value)


def from_text(text: str | None, kind: str):
    """Back to a value that compares; None if that cannot be."""
    try:
        if text is None:
            return None
        if kind.startswith(("int", "uint")) and kind != "interval":
            return int(text)
        if kind.startswith("float"):
            return float(text)
        if kind.startswith("decimal"):
            return Decimal(text)
        if kind == "date":
            return dt.date.fromisoformat(text[:10])
        if kind in ("timestamp", "timestamptz", "timestamp_ns"):
            return dt.datetime.fromisoformat(text.removesuffix("+00").strip())
        return text if kind == "varchar" else None
    except (ValueError, ArithmeticError):
        return None


def pack_value(value, kind: str):
    """An inlined value as SQLite holds it."""
    if value is None or isinstance(value, (int, str)) and not isinstance(value, bool):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return repr(value) if value != value or value in (float("inf"), float("-inf")) else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, dt.timedelta):
        return value // dt.timedelta(microseconds=1)
    if isinstance(value, (dt.date, dt.time, dt.datetime, Decimal)):
        return to_text(value)
    return json.dumps(_plain(value), default=to_text)


def _plain(value):
    """Rows as lists of their fields, for JSON."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def unpack_value(value, t: T.DataType):
    if value is None:
        return None
    if isinstance(t, T.BooleanType):
        return bool(value)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(value)
    if isinstance(t, T.DecimalType):
        return Decimal(str(value))
    if isinstance(t, T.DateType):
        return dt.date.fromisoformat(str(value)[:10])
    if isinstance(t, T.TimestampNTZType):
        return dt.datetime.fromisoformat(str(value))
    if isinstance(t, T.TimestampType):
        return dt.datetime.fromisoformat(str(value).removesuffix("+00")).replace(tzinfo=dt.timezone.utc)
    if isinstance(t, T.DayTimeIntervalType):
        return dt.timedelta(microseconds=int(value))
    if isinstance(t, T.StructType):
        v = json.loads(value) if isinstance(value, str) else value
        return tuple(unpack_value(x, f.dataType) for x, f in zip(v, t.fields, strict=False))
    if isinstance(t, T.ArrayType):
        return [unpack_value(x, t.elementType) for x in (json.loads(value) if isinstance(value, str) else value)]
    if isinstance(t, T.MapType):
        return {k: unpack_value(x, t.valueType) for k, x in (json.loads(value) if isinstance(value, str) else value).items()}
    return bytes(value) if isinstance(t, T.BinaryType) else str(value)
