"""Bit and byte kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def popcount(v: Column) -> Column:
    return F.bit_count(v)


def min_bits(v: Column) -> Column:
    """Bits that a non-negative value needs; 1 for 0."""
    return F.greatest(F.lit(1), F.length(F.bin(v)))


def leading_zeros(v: Column, width: int = 64) -> Column:
    return F.when(v == 0, width).otherwise(F.lit(width) - F.length(F.bin(v)))


def trailing_zeros(v: Column, width: int = 64) -> Column:
    return F.when(v == 0, width).otherwise(F.locate("1", F.reverse(F.bin(v))) - 1)


def bitscan_forward(v: Column) -> Column:
    """Index of the lowest set bit; null for 0."""
    return F.when(v != 0, trailing_zeros(v))


def bitscan_reverse(v: Column) -> Column:
    """Index of the highest set bit; null for 0."""
    return F.when(v != 0, F.length(F.bin(v)) - 1)


def reverse_byte(v: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), 8, "0")), 2, 10).cast("int")


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def next_power_of_two(v: Column) -> Column:
    """The smallest power of two that is not less; 1 for 0 and 1."""
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L").cast("long") * F.pow(F.lit(2), F.length(F.bin(v - 1))).cast("long"))


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3 (as the bits of a long)."""
    return F.shiftleft(v.cast("long"), 1).bitwiseXOR(F.shiftright(v.cast("long"), 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))


def varint_length(v: Column) -> Column:
    """Bytes of a LEB128 varint of a value's 64 bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v.cast("long"))) / 7)).cast("int")


def varint(v: Column) -> Column:
    """LEB128 bytes of a value's 64 bits: seven bits each, the lowest first, the top bit set but on the last."""
    n = varint_length(v)
    byte = lambda i: F.shiftrightunsigned(v.cast("long"), (i * 7).cast("int") if isinstance(i, Column) else i * 7).bitwiseAND(F.lit(127).cast("long"))
    parts = [F.when(F.lit(i) < n, F.lpad(F.hex(byte(i) + F.when(F.lit(i) < n - 1, 128).otherwise(0)), 2, "0")) for i in range(10)]
    return F.unhex(F.concat_ws("", *parts))


def unvarint(b: Column) -> Column:
    """The value of a whole varint, or null if it is empty, cut off, too long, or followed by more."""
    n = F.octet_length(b)
    part = lambda i: F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("long")
    total = F.lit(0).cast("long")
    for i in range(10):
        total = total.bitwiseOR(F.when(F.lit(i) < n, F.shiftleft(part(i).bitwiseAND(F.lit(127).cast("long")), 7 * i)).otherwise(F.lit(0).cast("long")))
    goes_on = F.lit(False)
    for i in range(9):
        goes_on = goes_on | ((F.lit(i) < n - 1) & (part(i) < 128))
    last = F.conv(F.hex(F.substring(b, -1, 1)), 16, 10).cast("long")
    bad = (n == 0) | (n > 10) | goes_on | (last >= 128) | ((n == 10) & (last > 1))
    return F.when(~bad, total)


def little_endian(v: Column, width: int) -> Column:
    """The low ``width`` bytes of a long, lowest first."""
    text = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(width)]))


def from_little_endian(b: Column) -> Column:
    """An unsigned number of at most eight bytes, lowest first, as decimal(20, 0)."""
    text = F.hex(b)
    return F.conv(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("decimal(20,0)")


def pack_flags(flags: Column) -> Column:
    """An array of booleans as bytes, the lowest bit first."""
    n = F.size(flags)
    bit = lambda b, i: F.coalesce(F.get(flags, b * 8 + i), F.lit(False)).cast("int") * (1 << i)

    def one(b: Column) -> Column:
        value = bit(b, 0)
        for i in range(1, 8):
            value = value + bit(b, i)
        return F.lpad(F.hex(value), 2, "0")

    whole = F.transform(F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1), one)
    return F.when(n == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(whole, "")))


def unpack_flags(b: Column, count: Column) -> Column:
    """``count`` booleans from bytes, the lowest bit first; missing bytes are false."""
    byte = lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(b, (F.floor(i / 8) + 1).cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))
    bits = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.pmod(F.floor(byte(i) / F.pow(F.lit(2), F.pmod(i, F.lit(8)))), F.lit(2)) == 1)
    return F.when(count <= 0, F.array().cast("array<boolean>")).otherwise(bits)


def pack_bits(values: Column, width: int) -> Column:
    """Non-negative numbers in ``width`` bits each, the highest first, filled up to whole bytes."""
    if not 1 <= width <= 63:
        raise ValueError("a width from 1 to 63")
    bits = F.array_join(F.transform(values, lambda v: F.lpad(F.bin(v), width, "0")), "")
    n = F.length(bits)
    full = F.rpad(bits, (F.ceil(n / 8) * 8).cast("int"), F.lit("0"))
    whole = F.transform(F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(full, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(F.size(values) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(whole, "")))


def unpack_bits(b: Column, width: int, count: Column) -> Column:
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.lpad(F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 2), 8, "0")), "")
    out = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(bits, i * width + 1, F.lit(width)), 2, 10).cast("long"))
    return F.when(count <= 0, F.array().cast("array<bigint>")).otherwise(out)


def count_byte(text: Column, one: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def xor_bytes(a: Column, b: Column) -> Column:
    """Byte by byte, as long as the shorter one."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    value = lambda x, i: F.conv(F.hex(F.substring(x, i, F.lit(1))), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(value(a, i).bitwiseXOR(value(b, i))), 2, "0"))
    return F.when(n == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(parts, "")))


def delta_encode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Differences to the value before (the first: the value), wrapping as 32-bit numbers do."""
    w = Window.partitionBy(*keys).orderBy(pos)
    d = F.col(value).cast("long") - F.coalesce(F.lag(value).over(w).cast("long"), F.lit(0).cast("long"))
    return df.select(*keys, pos, _wrap32(d).alias("delta"))


def delta_decode(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*keys, pos, _wrap32(F.sum(F.col("delta").cast("long")).over(w)).alias(value))


def _wrap32(v: Column) -> Column:
    return (F.pmod(v + 2**31, F.lit(2**32)) - 2**31).cast("int")


def human_size(size: Column) -> Column:
    """B as it is, KB to TB with one decimal, in steps of 1024."""
    out = F.format_string("%d B", size.cast("long"))
    for n, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**n, F.format_string(f"%.1f {unit}", size / F.lit(float(1024**n)))).otherwise(out)
    return out
