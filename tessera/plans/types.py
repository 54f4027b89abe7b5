"""The 20 logical types, nullability, schema building and fingerprints.

Types without a Spark twin keep a wider physical type and their name in the field's metadata
under ``logical``.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

# Name, wire id, ordinal, bytes of a value (0: variable).
TYPES = (
    ("BOOLEAN", 1, 0, 1), ("INT8", 2, 1, 1), ("INT16", 3, 2, 2), ("INT32", 4, 3, 4), ("INT64", 5, 4, 8),
    ("UINT8", 10, 5, 1), ("UINT16", 11, 6, 2), ("UINT32", 12, 7, 4), ("UINT64", 13, 8, 8),
    ("FLOAT32", 18, 9, 4), ("FLOAT64", 19, 10, 8),
    ("TIMESTAMP", 20, 11, 8), ("DATE", 21, 12, 4), ("TIME", 22, 13, 8), ("DURATION", 23, 14, 8),
    ("STRING", 24, 15, 0), ("ENUM", 25, 16, 0), ("UUID", 26, 17, 16), ("BLOB", 27, 18, 0), ("DECIMAL", 28, 19, 0),
)
NAMES = tuple(t[0] for t in TYPES)
IDS = {name: wire for name, wire, _, _ in TYPES}
ORDINALS = {name: n for name, _, n, _ in TYPES}
WIDTHS = {name: width for name, _, _, width in TYPES}
NULLABILITY = {"REQUIRED": 0, "OPTIONAL": 1, "REPEATED": 2}

# Other names that are accepted.
ALIASES = {
    "BOOL": "BOOLEAN", "I8": "INT8", "I16": "INT16", "I32": "INT32", "INT": "INT32", "INTEGER": "INT32", "I64": "INT64", "LONG": "INT64",
    "U8": "UINT8", "U16": "UINT16", "U32": "UINT32", "U64": "UINT64", "F32": "FLOAT32", "FLOAT": "FLOAT32", "F64": "FLOAT64", "DOUBLE": "FLOAT64",
    "TS": "TIMESTAMP", "STR": "STRING", "UTF8": "STRING", "BYTES": "BLOB", "BINARY": "BLOB",
}

PHYSICAL = {
    "BOOLEAN": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(),
    "TIME": T.LongType(), "DURATION": T.DayTimeIntervalType(), "STRING": T.StringType(), "ENUM": T.StringType(),
    "UUID": T.StringType(), "BLOB": T.BinaryType(), "DECIMAL": T.DecimalType(38, 18),
}

#: Values that an unsigned type may take.
UNSIGNED_MOST = {"UINT8": 2**8 - 1, "UINT16": 2**16 - 1, "UINT32": 2**32 - 1, "UINT64": 2**64 - 1}


def type_name(name: str | int) -> str:
    """The canonical name of a type given by name, alias, ordinal or wire id (as ``'#24'``)."""
    if isinstance(name, int):
        if 0 <= name < len(NAMES):
            return NAMES[name]
        raise SchemaError(f"no type has the ordinal {name}")
    key = name.strip().upper()
    if key.startswith("#") and key[1:].isdigit():
        for n, wire in IDS.items():
            if wire == int(key[1:]):
                return n
    key = ALIASES.get(key, key)
    if key not in IDS:
        raise SchemaError(f"unknown type {name!r}")
    return key


def nullability_name(value: str | int) -> str:
    for name, n in NULLABILITY.items():
        if value == n or isinstance(value, str) and value.upper() == name:
            return name
    raise SchemaError(f"unknown nullability {value!r}")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullability: str = "REQUIRED"
    metadata: dict = field(default_factory=dict, hash=False)

    def spark(self) -> T.StructField:
        physical = PHYSICAL[self.type]
        if self.type == "DECIMAL":
            physical = T.DecimalType(38, int(self.metadata.get("scale", 18)))
        if self.nullability == "REPEATED":
            physical = T.ArrayType(physical, containsNull=False)
        meta = {"logical": self.type, "nullability": self.nullability, **{k: str(v) for k, v in self.metadata.items()}}
        return T.StructField(self.name, physical, self.nullability != "REQUIRED", meta)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __len__(self) -> int:
        return len(self.fields)

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def index_of(self, name: str) -> int:
        if name not in self.names():
            raise SchemaError(f"no column is named {name!r}")
        return self.names().index(name)

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def fingerprint_input(self) -> bytes:
        return b"".join(f.name.encode() + bytes([ORDINALS[f.type], NULLABILITY[f.nullability]]) for f in self.fields)

    def schema_id(self) -> int:
        """The first four bytes of SHA-256 over names, types and nullabilities, little-endian."""
        return struct.unpack("<I", hashlib.sha256(self.fingerprint_input()).digest()[:4])[0]

    def to_bytes(self) -> bytes:
        """Version, field count, then name, type id, nullability and metadata of each field."""
        text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
        out = [struct.pack("<HH", 1, len(self.fields))]
        for f in self.fields:
            out += [text(f.name), bytes([IDS[f.type], NULLABILITY[f.nullability]]), struct.pack("<H", len(f.metadata))]
            out += [text(str(k)) + text(str(v)) for k, v in sorted(f.metadata.items())]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Schema:
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise SchemaError("the schema's bytes end too early")
            at += n
            return data[at - n : at]

        def number() -> int:
            return struct.unpack("<H", take(2))[0]

        def text() -> str:
            try:
                return take(number()).decode()
            except UnicodeDecodeError as e:
                raise SchemaError("a name isn't UTF-8") from e

        if number() != 1:
            raise SchemaError("unknown version of the schema's bytes")
        build = SchemaBuilder()
        for _ in range(number()):
            name, kind, null = text(), take(1)[0], take(1)[0]
            meta = {}
            for _ in range(number()):
                key = text()
                meta[key] = text()
            build.add(name, type_name(f"#{kind}"), nullability_name(null), meta)
        if at != len(data):
            raise SchemaError("bytes follow the schema")
        return build.build()


class SchemaBuilder:
    def __init__(self) -> None:
        self._fields: list[Field] = []

    def add(self, name: str, kind: str | int, nullability: str | int = "REQUIRED", metadata: dict | None = None) -> SchemaBuilder:
        if not name:
            raise SchemaError("a field needs a name")
        if any(f.name == name for f in self._fields):
            raise SchemaError(f"the field {name!r} exists already")
        self._fields.append(Field(name, type_name(kind), nullability_name(nullability), dict(metadata or {})))
        return self

    def build(self) -> Schema:
        if not self._fields:
            raise SchemaError("a schema needs a field")
        return Schema(tuple(self._fields))


def from_spark(schema: T.StructType) -> Schema:
    """The logical schema of a DataFrame, by metadata where there is any."""
    plain = {
        T.BooleanType: "BOOLEAN", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.FloatType: "FLOAT32", T.DoubleType: "FLOAT64",
        T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP", T.DateType: "DATE", T.DayTimeIntervalType: "DURATION", T.StringType: "STRING", T.BinaryType: "BLOB", T.DecimalType: "DECIMAL",
    }
    build = SchemaBuilder()
    for f in schema.fields:
        kind, repeated = f.dataType, isinstance(f.dataType, T.ArrayType)
        if repeated:
            kind = kind.elementType
        logical = f.metadata.get("logical") or plain.get(type(kind))
        if logical is None:
            raise SchemaError(f"{f.name}: {kind.simpleString()} has no logical type")
        build.add(f.name, logical, f.metadata.get("nullability") or ("REPEATED" if repeated else "OPTIONAL" if f.nullable else "REQUIRED"))
    return build.build()


def violation(f: Field, column: Column) -> Column:
    """What is wrong with a value of the field, or null."""
    wrong = F.lit(None).cast("string")
    if f.type in UNSIGNED_MOST:
        wrong = F.when((column < 0) | (column.cast("decimal(38,0)") > F.lit(Decimal(UNSIGNED_MOST[f.type]))), F.lit(f"{f.name}: out of range for {f.type}"))
    if f.type == "ENUM" and f.metadata.get("enum_values"):
        wrong = F.when(~column.isin(str(f.metadata["enum_values"]).split(",")), F.lit(f"{f.name}: not a value of the enum"))
    if f.type == "UUID":
        wrong = F.when(~column.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(f"{f.name}: not a UUID"))
    if f.nullability == "REQUIRED":
        wrong = F.when(column.isNull(), F.lit(f"{f.name}: null in a required field")).otherwise(wrong)
    return wrong


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` in the schema's types and order; a row that breaks it fails the job when it is read."""
    missing = [n for n in schema.names() if n not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    out = []
    for f in schema.fields:
        spark = f.spark()
        value = F.col(f.name).cast(spark.dataType)
        wrong = violation(f, F.col(f.name)) if f.nullability != "REPEATED" else F.lit(None).cast("string")
        out.append(F.when(wrong.isNotNull(), F.raise_error(wrong).cast(spark.dataType)).otherwise(value).alias(f.name, metadata=spark.metadata))
    return df.select(*out)


def fingerprints(spark, schemas: dict[str, Schema]) -> DataFrame:
    """``name, schema_sha256, schema_id`` of each schema, hashed in Spark."""
    rows = [(n, bytearray(s.fingerprint_input())) for n, s in schemas.items()]
    df = spark.createDataFrame(rows, "name string, raw binary")
    sha = F.sha2("raw", 256)
    first = F.concat(*[F.substring(sha, i, 2) for i in (7, 5, 3, 1)])
    return df.select("name", sha.alias("schema_sha256"), F.conv(first, 16, 10).cast("long").alias("schema_id"))
