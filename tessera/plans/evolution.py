"""Schema evolution: type compatibility, migration plans, and applying them to rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from .types import NAMES, Field, Schema

# What each type widens to and narrows to.
WIDENING = {
    "INT8": "INT16 INT32 INT64 FLOAT32 FLOAT64", "INT16": "INT32 INT64 FLOAT32 FLOAT64", "INT32": "INT64 FLOAT64",
    "UINT8": "UINT16 UINT32 UINT64 FLOAT32 FLOAT64", "UINT16": "UINT32 UINT64 FLOAT32 FLOAT64", "UINT32": "UINT64 FLOAT64",
    "FLOAT32": "FLOAT64", "UUID": "STRING", "STRING": "BLOB", "TIMESTAMP": "STRING", "DATE": "STRING", "TIME": "STRING",
}
NARROWING = {
    "INT16": "INT8", "INT32": "INT8 INT16", "INT64": "INT8 INT16 INT32", "UINT8": "INT8", "UINT16": "INT8 INT16 UINT8",
    "UINT32": "INT8 INT16 INT32 UINT8 UINT16", "UINT64": "INT8 INT16 INT32 INT64 UINT8 UINT16 UINT32",
    "FLOAT64": "FLOAT32 INT8 INT16 INT32 INT64 UINT8 UINT16 UINT32 UINT64", "FLOAT32": "INT8 INT16 INT32 UINT8 UINT16 UINT32",
    "STRING": "UUID TIMESTAMP DATE TIME", "BLOB": "STRING",
}


def compatibility(old: str, new: str) -> str:
    """IDENTICAL, WIDENING, NARROWING or INCOMPATIBLE."""
    if old == new:
        return "IDENTICAL"
    if new in WIDENING.get(old, "").split():
        return "WIDENING"
    return "NARROWING" if new in NARROWING.get(old, "").split() else "INCOMPATIBLE"


def is_safe(level: str) -> bool:
    return level in ("IDENTICAL", "WIDENING")


def compatibility_matrix(spark: SparkSession) -> DataFrame:
    rows = [(a, b, c := compatibility(a, b), is_safe(c), c != "INCOMPATIBLE") for a in NAMES for b in NAMES]
    return spark.createDataFrame(rows, "from_type string, to_type string, level string, safe boolean, possible boolean")


def validate_rename(old: Field, new: Field) -> None:
    if old.type != new.type or old.nullability != new.nullability:
        raise SchemaError(f"{old.name} can't become {new.name}: type and nullability must stay")


def validate_type_change(old: str, new: str, allow_breaking: bool = False) -> str:
    level = compatibility(old, new)
    if level == "INCOMPATIBLE" or level == "NARROWING" and not allow_breaking:
        raise SchemaError(f"{old} can't become {new}: {level.lower()}")
    return level


@dataclass(frozen=True)
class Mapping:
    old: Field
    new: Field
    level: str


@dataclass
class Migration:
    mappings: list[Mapping] = field(default_factory=list)
    added: list[Field] = field(default_factory=list)
    removed: list[Field] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)

    @property
    def is_breaking(self) -> bool:
        required = any(f.nullability == "REQUIRED" for f in [*self.added, *self.removed])
        return required or any(m.level == "INCOMPATIBLE" for m in self.mappings)

    def as_rows(self) -> list[tuple]:
        rows = [("map", m.old.name, m.new.name, m.old.type, m.new.type, m.level) for m in self.mappings]
        rows += [("add", None, f.name, None, f.type, f.nullability) for f in self.added]
        return rows + [("remove", f.name, None, f.type, None, f.nullability) for f in self.removed]

    def as_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.as_rows(), "action string, old_name string, new_name string, old_type string, new_type string, detail string")


def plan_migration(old: Schema, new: Schema, renames: dict[str, str] | None = None) -> Migration:
    """How rows of ``old`` become rows of ``new``; fields match by name or by ``renames`` (old to new)."""
    out = Migration(renames=dict(renames or {}))
    back = {b: a for a, b in out.renames.items()}
    used = set()
    for f in new.fields:
        before = old.by_name(back.get(f.name, f.name))
        if before is None:
            out.added.append(f)
            continue
        if f.name in back:
            validate_rename(before, f)
        used.add(before.name)
        out.mappings.append(Mapping(before, f, compatibility(before.type, f.type)))
    out.removed = [f for f in old.fields if f.name not in used]
    return out


def forward_compatible(plan: Migration) -> bool:
    """Whether old readers can use new rows: no incompatible type and no required field gone."""
    return not any(m.level == "INCOMPATIBLE" for m in plan.mappings) and not any(f.nullability == "REQUIRED" for f in plan.removed)


def backward_compatible(plan: Migration) -> bool:
    """Whether new readers can use old rows: no incompatible type and no required field added."""
    return not any(m.level == "INCOMPATIBLE" for m in plan.mappings) and not any(f.nullability == "REQUIRED" for f in plan.added)


def apply_migration(df: DataFrame, plan: Migration, new: Schema, allow_breaking: bool = False) -> DataFrame:
    """Rows in the new schema: widening casts, narrowing ones that give null where a value doesn't fit, nulls for added fields."""
    if plan.is_breaking and not allow_breaking:
        raise SchemaError("the migration is breaking")
    by_new = {m.new.name: m for m in plan.mappings}
    out = []
    for f in new.fields:
        kind = f.spark().dataType
        m = by_new.get(f.name)
        if m is None:
            out.append(F.lit(None).cast(kind).alias(f.name))
        elif m.level == "INCOMPATIBLE":
            raise SchemaError(f"{m.old.name}: {m.old.type} can't become {f.type}")
        else:
            source = F.col(m.old.name)
            out.append((source.try_cast(kind) if m.level == "NARROWING" else source.cast(kind)).alias(f.name))
    return df.select(*out)


#: The named conversions and whether they keep every value.
CONVERSIONS = (
    ("int32_to_int64", "INT32", "INT64", True), ("int64_to_int32", "INT64", "INT32", False), ("float32_to_float64", "FLOAT32", "FLOAT64", True),
    ("string_to_uuid", "STRING", "UUID", False), ("uuid_to_string", "UUID", "STRING", True),
    ("string_to_blob", "STRING", "BLOB", True), ("blob_to_string", "BLOB", "STRING", False),
)


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONVERSIONS), "name string, from_type string, to_type string, safe boolean")
