"""Column encryption and keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(c: Column, key: bytes) -> Column:
    """base64 of a 12-byte nonce, the AES-256-GCM ciphertext and its tag."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM")))


def decrypt(c: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")


def keyed_hash(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, composed of two digests over padded keys, which are literals."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ p for x in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)


def key(path: str, length: int = 32) -> bytes:
    """The key in a file of base64, made there (for the owner's eyes only) if there is none."""
    import base64
    import os

    if not os.path.exists(path):
        at = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(at, "wb") as f:
            f.write(base64.b64encode(os.urandom(length)))
    with open(path, "rb") as f:
        found = base64.b64decode(f.read().strip(), validate=True)
    if len(found) != length:
        raise ValueError(f"the key in {path} has {len(found)} bytes, not {length}")
    return found
