"""Keyed pseudonyms without a UDF: HMAC-SHA256 from two nested SHA-256 with pads made once on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
LEAST_SALT = 16
# Kinds and the prefixes of their pseudonyms.
PREFIXES = {"host": "node-", "user": "user-", "account": "acct-", "cluster": "cluster-", "addr": "addr-"}


def pads(salt: bytes) -> tuple[str, str]:
    """Inner and outer pad in hex."""
    if len(salt) < LEAST_SALT:
        raise ValueError(f"a salt has {LEAST_SALT} bytes at least")
    key = (hashlib.sha256(salt).digest() if len(salt) > BLOCK else salt).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(salt: bytes, message: Column) -> Column:
    """Hex digest; message is binary."""
    inner, outer = pads(salt)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256))), 256)


def pseudonym(salt: bytes, kind: str | Column, value: Column) -> Column:
    """Prefix and eight digits; empty stays empty."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), kind)
    digest = hmac_sha256(salt, F.concat(F.encode(kind, "utf-8"), F.unhex(F.lit("00")), F.encode(value, "utf-8")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100000000
    return F.when(value == "", "").otherwise(F.concat(prefix, F.lpad(number.cast("string"), 8, "0")))


def salt_id(salt: bytes, tag: bytes = b"salt-id\0") -> str:
    """A salt's fingerprint, under a site's tag; never the salt."""
    return "sha256:" + hashlib.sha256(tag + salt).digest()[:4].hex()
