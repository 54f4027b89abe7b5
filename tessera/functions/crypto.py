"""Keys and AES-256-GCM of columns.

Passwords are stretched with scrypt (Argon2 has no implementation among the dependencies), then
expanded with HKDF-SHA256; each column gets its own key from the master key and its name.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES, SALT_BYTES, NONCE_BYTES, TAG_BYTES = 32, 32, 12, 16
# What HKDF derives keys for.
PASSWORD_INFO, COLUMN_INFO, CHECK_INFO = b"key-from-password", b"column-key:", b"key-check"
#: Flag bit: a salt follows the flags.
HAS_SALT = 1


def generate_key() -> bytes:
    return secrets.token_bytes(KEY_BYTES)


def generate_salt() -> bytes:
    return secrets.token_bytes(SALT_BYTES)


def hkdf(secret: bytes, info: bytes, length: int = KEY_BYTES, salt: bytes = b"") -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    if length > 255 * 32:
        raise ValueError("too long for HKDF")
    prk = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(-(-length // 32)):
        block = hmac.new(prk, block + info + bytes([i + 1]), hashlib.sha256).digest()
        out += block
    return out[:length]


def column_key(master: bytes, column: str) -> bytes:
    return hkdf(master, COLUMN_INFO + column.encode())


def password_key(password: str, salt: bytes) -> bytes:
    if len(salt) != SALT_BYTES:
        raise ValueError("the salt must have 32 bytes")
    return hkdf(hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32), PASSWORD_INFO)


@dataclass(frozen=True)
class Encryption:
    key: bytes = field(repr=False)
    salt: bytes | None = None

    def __post_init__(self) -> None:
        if len(self.key) != KEY_BYTES:
            raise ValueError("the key must have 32 bytes")
        if self.salt is not None and len(self.salt) != SALT_BYTES:
            raise ValueError("the salt must have 32 bytes")

    def encrypt(self, data: Column) -> Column:
        """Flags, salt if any, nonce, ciphertext and tag; the nonce is random."""
        head = bytes([HAS_SALT]) + self.salt if self.salt else bytes([0])
        return F.concat(F.lit(head), F.aes_encrypt(data.cast("binary"), F.lit(self.key), F.lit("GCM")))

    def decrypt(self, data: Column) -> Column:
        """The plain bytes; null where flags, salt, length, key or tag are wrong."""
        start = 2 + (SALT_BYTES if self.salt else 0)
        right = F.substring(data, 1, 1) == F.lit(bytes([HAS_SALT if self.salt else 0]))
        if self.salt:
            right = right & (F.substring(data, 2, SALT_BYTES) == F.lit(self.salt))
        long_enough = F.octet_length(data) >= start - 1 + NONCE_BYTES + TAG_BYTES
        body = F.substring(data, start, 2**31 - 1 - start)
        return F.when(right & long_enough, F.try_aes_decrypt(body, F.lit(self.key), F.lit("GCM")))


@dataclass
class ColumnEncryption:
    """The columns that are stored encrypted, each with its own key."""

    master: bytes = field(repr=False)
    columns: tuple[str, ...] = ()

    def is_encrypted(self, column: str) -> bool:
        return column in self.columns

    def key_check(self) -> str:
        """Tells master keys apart without giving them away."""
        return hkdf(self.master, CHECK_INFO).hex()

    def encrypt(self, df: DataFrame) -> DataFrame:
        """Values are encrypted as text, timestamps as microseconds, so that no time zone matters."""

        def plain(c: str) -> Column:
            return (F.unix_micros(c) if df.schema[c].dataType.typeName() == "timestamp" else F.col(c)).cast("string")

        return df.select(*[Encryption(column_key(self.master, c)).encrypt(plain(c)).alias(c, metadata={"encrypted": "aes-256-gcm"}) if self.is_encrypted(c) else F.col(c) for c in df.columns])

    def decrypt(self, df: DataFrame, types: dict[str, str]) -> DataFrame:
        """Back to the ``types`` the columns had; null where a value isn't genuine."""

        def back(c: str) -> Column:
            text = Encryption(column_key(self.master, c)).decrypt(F.col(c)).cast("string")
            return F.timestamp_micros(text.cast("long")) if types[c] == "timestamp" else text.cast(types[c])

        return df.select(*[back(c).alias(c) if self.is_encrypted(c) else F.col(c) for c in df.columns])
