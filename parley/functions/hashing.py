"""Hash expressions: ids, split assignment, SimHash, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(key: Column, salt: str) -> Column:
    """A key's place in [0, 1): the top 64 bits of SHA-256 over salt|key."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def unit32(key: Column, salt: str) -> Column:
    """As unit(), of 32 bits: exact in any engine's doubles."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def assign_split(key: Column, salt: str, train: float = 0.70, validation: float = 0.85) -> Column:
    at = unit(key, salt)
    return F.when(at < train, "train").when(at < validation, "validation").otherwise("test")


def stable_id(dataset: str, record: Column) -> Column:
    return F.concat(F.lit(f"{dataset}:"), F.substring(F.sha2(F.concat(F.lit(f"{dataset}|"), record), 256), 1, 20))


def hash64(feature: Column) -> Column:
    """The top 64 bits of SHA-256 as a signed long."""
    return F.conv(F.substring(F.sha2(feature, 256), 1, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(value: Column, index: int, bits: int = 8) -> Column:
    return F.shiftrightunsigned(value, index * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def hmac_sha256(message: Column, secret: str) -> Column:
    """RFC 2104 out of sha2 and unhex."""
    import hashlib

    key = secret.encode()
    if not key:
        raise ValueError("a signature needs a secret")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), first), 256)
