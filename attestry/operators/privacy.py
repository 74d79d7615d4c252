"""Privacy modes, disclosure and attestations, as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import hashing

#: The modes, and the levels of those that are ordered.
MODES = ("public", "proof-of-possession", "encrypted", "selective-disclosure", "anonymous", "attestation")
LEVELS = {"proof-of-possession": 4, "selective-disclosure": 3, "encrypted": 2, "public": 1}


def mode_of(stated: Column) -> Column:
    """The stated mode; ``public`` where none is."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.lit("public"))


def known_mode(mode: Column) -> Column:
    return mode.isin(*MODES)


def level(mode: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[mode]


def transition_valid(from_mode: Column, to_mode: Column) -> Column:
    """Privacy may fall or stay, not rise; modes without a level are outside the order."""
    return (from_mode == to_mode) | F.coalesce(level(from_mode) >= level(to_mode), F.lit(True))


def addressing_consistent(current: Column, previous: Column) -> Column:
    """Both say the same, or one says nothing."""
    return F.coalesce(F.nullif(current, F.lit("")) == F.nullif(previous, F.lit("")), F.lit(True))


def delta_reason(mode: Column, delta_format: Column, operations: Column, applies_to: Column, index_format: str) -> Column:
    """Why a mode forbids a delta, or null."""
    sealed = (
        F.when(delta_format != "application/octet-stream", "encrypted deltas are opaque bytes")
        .when(operations != -1, "encrypted deltas hide their operations")
        .when(F.coalesce(applies_to, F.lit("")) != "", "encrypted deltas hide what they apply to")
    )
    return F.when(mode == "encrypted", sealed).when((mode == "selective-disclosure") & (delta_format != index_format), "disclosure deltas are index deltas")


def logical_hash(mode: Column, content_hash: Column, plaintext_hash: Column, visibility: Column) -> Column:
    """``struct<hash, error, warning>``: what the plaintext's address is, by mode."""
    sealed = (mode == "encrypted") | ((mode == "anonymous") & (F.coalesce(visibility, F.lit("")) == "encrypted"))
    error = F.when(mode == "attestation", "an attestation has no plaintext").when(sealed & (F.coalesce(plaintext_hash, F.lit("")) == ""), "plaintext hash missing")
    value = F.when(error.isNull(), F.when(sealed, plaintext_hash).otherwise(content_hash))
    return F.struct(value.alias("hash"), error.alias("error"), F.when(~known_mode(mode), "unknown mode").alias("warning"))


def anonymous_reason(identity: Column, method: Column) -> Column:
    """An ephemeral authority must not refer to a lasting key."""
    return F.when((identity == "ephemeral") & F.contains(method, F.lit("/key/")), "an ephemeral authority refers to a key document")


def statement_index(docs: DataFrame, id_col: str, text_col: str, salt: Column) -> DataFrame:
    """doc_id, idx, statement, hash: the salted digest of every non-empty line, in order of the text.

    Lines are neither trimmed nor made unique here.
    """
    parts = F.filter(F.split(F.col(text_col), "\n"), lambda s: s != "")
    told = docs.select(F.col(id_col).alias("doc_id"), salt.alias("salt"), F.posexplode(parts).alias("idx", "statement"))
    return told.select("doc_id", "idx", "statement", hashing.salted(F.col("salt"), F.col("statement")).alias("hash"))


def index_root(index: DataFrame) -> DataFrame:
    """doc_id, root, statements: the digest over all digests of a document, in order."""
    return index.groupBy("doc_id").agg(hashing.ordered_root(F.col("idx"), F.col("hash")).alias("root"), F.count("*").alias("statements"))


def statement_valid(statement: Column, salt: Column, expected: Column) -> Column:
    return hashing.salted(salt, statement) == expected


def tags(index: DataFrame, key: bytes, salt: Column | None = None) -> DataFrame:
    """The index with an HMAC tag for each statement, under a key that the driver knows."""
    data = F.col("statement").cast("binary") if salt is None else F.concat(salt, F.col("statement").cast("binary"))
    return index.withColumn("tag", hashing.hmac_sha256(key, data))


def disclosed(index: DataFrame, mandatory: Column, recipient: Column | None = None) -> DataFrame:
    """The index rows that a recipient may see; a null list of a recipient is all of them."""
    own = F.lit(True) if recipient is None else recipient.isNull() | F.array_contains(recipient, F.col("idx"))
    return index.where(F.array_contains(mandatory, F.col("idx")) | own)


def guesses(index: DataFrame, candidates: DataFrame, salt: Column) -> DataFrame:
    """Which candidate statements stand behind salted digests: an equi-join on the digest."""
    return index.join(candidates.select(F.col("statement").alias("candidate"), hashing.salted(salt, F.col("statement")).alias("hash")), "hash")


def trust(attested: Column, revoked: Column, subject_valid: Column) -> Column:
    """``full``, ``partial`` or ``unverifiable``."""
    subject, gone = F.coalesce(subject_valid, F.lit(False)), F.coalesce(revoked, F.lit(False))
    return F.when(~attested | (gone & ~subject), "unverifiable").when(subject & ~gone, "full").otherwise("partial")


def attestation_stale(valid_until: Column, now: Column) -> Column:
    """Compared as text, as the timestamps stand."""
    return F.coalesce(now > F.nullif(valid_until, F.lit("")), F.lit(False))


def attestation_reason(fields: Column, kind: Column, mode: Column, parts: Column, wanted: str) -> Column:
    """The first structural fault of an attestation: its field names, type, mode and block's parts."""
    out = F.when(F.array_contains(fields, "content"), "content present").when(~kind.eqNullSafe(F.lit(wanted)), "type")
    for name in ("@context", "@id", "@type", "version", "branch", "timing", "privacy", "attestation"):
        out = out.when(~F.array_contains(fields, name), f"missing {name}")
    out = out.when(~mode.eqNullSafe(F.lit("attestation")), "mode")
    for name in ("subject", "claim", "evidence"):
        out = out.when(~F.array_contains(F.coalesce(parts, F.array().cast("array<string>")), name), f"missing {name}")
    return out


def linkable(manifests: DataFrame) -> DataFrame:
    """Authorities that sign more than one manifest, and so link them."""
    return manifests.groupBy("authority").agg(F.count("*").alias("manifests")).where("manifests > 1")
