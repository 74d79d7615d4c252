"""Content addresses and keyed digests, on built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import to_base32

#: Fixed values of content identifiers: version 1, dag-cbor, SHA-256 of 32 bytes.
CID_HEAD = "01711220"


def sha256(data: Column) -> Column:
    """``sha256:`` and 64 hexadecimal digits."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def _cbor_head(major: int, length: Column) -> Column:
    """Hexadecimal head of a CBOR string of a given length."""
    def wide(mark: int, digits: int) -> Column:
        return F.concat(F.lit(f"{major + mark:02X}"), F.lpad(F.hex(length), digits, "0"))

    return F.when(length < 24, F.lpad(F.hex(length + major), 2, "0")).when(length < 256, wide(24, 2)).when(length < 65536, wide(25, 4)).otherwise(wide(26, 8))


def envelope(data: Column, kind: str, profile: str, prefix: str) -> Column:
    """Content in its CBOR envelope of type, content and canonicalisation, as bytes.

    ``prefix`` is the vocabulary prefix that the envelope's last two keys carry.
    """
    def text(s: str) -> str:
        raw = s.encode()
        assert len(raw) < 24 or len(raw) < 256
        return (f"{0x60 + len(raw):02X}" if len(raw) < 24 else f"78{len(raw):02X}") + raw.hex().upper()

    head = F.lit("A3" + text("@type") + text(kind) + text(f"{prefix}:content"))
    size = _cbor_head(0x40, F.octet_length(data).cast("long"))
    return F.concat(F.unhex(F.concat(head, size)), data.cast("binary"), F.unhex(F.lit(text(f"{prefix}:canonicalization") + text(profile))))


def cid(data: Column, kind: str, profile: str, prefix: str) -> Column:
    """The CIDv1 of content in its ``envelope``."""
    return F.concat(F.lit("b"), to_base32(F.unhex(F.concat(F.lit(CID_HEAD), F.sha2(envelope(data, kind, profile, prefix), 256)))))


def algorithm_of(address: Column) -> Column:
    """Which algorithm an address names: ``sha256``, ``cidv1``, or null where none is known."""
    return F.when(address.rlike(r"^sha256:"), "sha256").when(address.rlike(r"^b[^:]*$"), "cidv1")


def verify(address: Column, data: Column, kind: str = "Content", profile: str = "JCS", prefix: str = "vk") -> Column:
    """Whether data has the address, by the algorithm that it names; null for an unknown one."""
    by = algorithm_of(address)
    return F.when(by == "sha256", address == sha256(data)).when(by == "cidv1", address == cid(data, kind, profile, prefix))


def salted(salt: Column, statement: Column) -> Column:
    """SHA-256 of salt and statement, one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(salt, statement.cast("binary")), 256))


def hmac_sha256(key: bytes, data: Column) -> Column:
    """HMAC-SHA-256 under a key that the driver knows, as hexadecimal text."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), data.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def ordered_root(position: Column, digest: Column) -> Column:
    """An aggregate: SHA-256 over the digests of a group, end to end in order of their positions."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("i"), F.hex(digest).alias("h"))))
    return F.sha2(F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), "")), 256)
