"""Making what is published: key documents, sealed content and its recipients, and manifests of each mode.

Contents and recipients are tables; a content with many recipients is a join and an aggregation, so
neither travels through the driver. Secrets come from the caller, or fresh from ``fresh_bytes``.
"""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from attestry.functions import crypto, hashing, text
from attestry.operators import hardening, manifests
from attestry.operators.manifests import PREFIX, SCHEME
from attestry.operators.resolve import CONTENT_LABEL, HMAC_LABEL

#: What manifests name as their algorithms.
CIPHER, AGREEMENT, PROOF_SUITE, TAG_BITS = "AES-256-GCM", "X25519-HKDF-SHA256", "vk-hmac-sd-2026", 128


@F.arrow_udf(BinaryType())
def _fresh(sizes: pa.Array) -> pa.Array:
    return pa.array([secrets.token_bytes(n) for n in sizes.to_pylist()], pa.binary())


def fresh_bytes(size: int) -> Column:
    """Unpredictable bytes, new for each row and each run: store them before they are used twice."""
    return _fresh.asNondeterministic()(F.lit(size))


def ephemeral(rows: DataFrame, seed: Column | None = None) -> DataFrame:
    """The rows with ``seed``, ``public_key``, ``authority`` and ``key_id`` of an authority of their own.

    Without ``seed`` it is fresh, and no two authorities can be linked.
    """
    told = rows.withColumn("seed", fresh_bytes(32) if seed is None else seed)
    return told.withColumn("public_key", crypto.public_key(F.col("seed"))).withColumns({"authority": text.derive_authority(F.col("public_key")), "key_id": F.lit("ephemeral-key")})


def key_document(authority: Column, version: Column, active: Column, policies: Column, rotated: Column | None = None, revoked: Column | None = None, kind: str = "single", prefix: str = PREFIX, scheme: str = SCHEME) -> Column:
    """The JSON text of an unsigned key document; lists that are not given, or null, are empty."""
    none = F.array().cast("array<string>")

    def listed(c: Column | None) -> Column:
        return F.to_json(none if c is None else c)

    head = F.to_json(
        F.struct(
            F.array(F.lit(f"urn:{prefix}:context")).alias("@context"), F.concat(F.lit(f"{scheme}://"), authority, F.lit("/key/main")).alias("@id"), F.lit(f"{prefix}:KeyDocument").alias("@type"),
            version.cast("string").alias(f"{prefix}:version"), authority.alias(f"{prefix}:authority"), F.lit(kind).alias(f"{prefix}:authorityType"),
        )
    )
    lists = [F.concat(F.lit(f',"{prefix}:{n}":'), F.coalesce(listed(c), F.lit("[]"))) for n, c in (("activeKeys", active), ("rotatedKeys", rotated), ("revokedKeys", revoked))]
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *lists, F.lit(f',"{prefix}:policies":'), F.to_json(policies), F.lit("}"))


def _shares(contents: DataFrame, recipients: DataFrame, key: str, label: str, name: str, more: list[str]) -> DataFrame:
    """id, recipients: for each content the list of recipients with its key wrapped, in order of their names."""
    told = contents.select("id", "nonce", "sender", F.col(key).alias("shared")).join(recipients, "id")
    wrapped = crypto.wrap(F.col("shared"), F.col("sender"), F.col("public_key"), F.col("nonce"), label, F.col("recipient"))
    share = F.struct(F.col("recipient").alias("id"), F.lower(F.hex(wrapped)).alias(name), *more)
    return told.groupBy("id").agg(F.array_sort(F.collect_list(share)).alias("recipients"))


def _checked(told: DataFrame, what: str) -> DataFrame:
    missing = F.raise_error(F.concat(F.lit(f"{what} without a recipient: "), F.col("id").cast("string")))
    return told.withColumn("recipients", F.coalesce("recipients", missing.cast(told.schema["recipients"].dataType)))


def encrypt(contents: DataFrame, recipients: DataFrame, label: str = CONTENT_LABEL, quantum: int | None = None) -> DataFrame:
    """id, ciphertext, ciphertext_hash, plaintext_hash, plaintext_size, iv, ephemeral_public_key, recipients, padding_quantum.

    ``contents`` has id, plain (bytes), key (32 bytes), nonce (12 bytes) and sender, the secret half of a
    key pair made for this content; ``recipients`` has id, recipient and public_key (for key agreement), a row for each
    reader of a content. A content without a recipient raises. With ``quantum`` the content is padded to a multiple of it
    before it is sealed, and the size that is told is that of the padded bytes.
    """
    base = F.lit((9).to_bytes(32, "little"))
    shares = _shares(contents, recipients, "key", label, "encryptedKey", [])
    inner = F.col("plain") if quantum is None else hardening.pad(F.col("plain"), quantum)
    told = contents.join(shares, "id", "left").withColumn("inner", inner).withColumn("ciphertext", crypto.seal(F.col("key"), F.col("nonce"), F.col("inner")))
    return _checked(told, "content").select(
        "id", "ciphertext", hashing.sha256(F.col("ciphertext")).alias("ciphertext_hash"), hashing.sha256(F.col("plain")).alias("plaintext_hash"), F.octet_length("inner").cast("long").alias("plaintext_size"),
        F.lower(F.hex("nonce")).alias("iv"), F.lower(F.hex(crypto.shared_secret(F.col("sender"), base))).alias("ephemeral_public_key"), "recipients", F.lit(quantum).cast("int").alias("padding_quantum"),
    )


def share_index_key(contents: DataFrame, recipients: DataFrame, label: str = HMAC_LABEL) -> DataFrame:
    """id, iv, ephemeral_public_key, recipients: the key of a statement index for those who may check its tags.

    ``contents`` has id, hmac_key, nonce and sender as in ``encrypt``; ``recipients`` also has ``statements``, the
    numbers that each may see, where null is all of them.
    """
    base = F.lit((9).to_bytes(32, "little"))
    shown = F.coalesce(F.to_json("statements"), F.lit("all")).alias("disclosedStatements")
    told = contents.join(_shares(contents, recipients, "hmac_key", label, "encryptedHmacKey", [shown]), "id", "left")
    return _checked(told, "index").select("id", F.lower(F.hex("nonce")).alias("iv"), F.lower(F.hex(crypto.shared_secret(F.col("sender"), base))).alias("ephemeral_public_key"), "recipients")


def encrypted_record(plain_format: Column) -> Column:
    """The privacy record of a row of ``encrypt``."""
    told = F.struct(
        F.lit(CIPHER).alias("algorithm"), F.lit(AGREEMENT).alias("keyAgreement"), F.col("iv"), F.lit(TAG_BITS).alias("tagLength"), F.col("plaintext_hash").alias("plaintextHash"),
        plain_format.alias("plaintextFormat"), F.col("plaintext_size").alias("plaintextSize"), F.col("ephemeral_public_key").alias("ephemeralPublicKey"), F.col("recipients"), F.col("padding_quantum").alias("paddingQuantum"),
    )
    return F.struct(F.lit("encrypted").alias("mode"), told.alias("parameters"))


def build_encrypted(uri: Column, version: Column, created: Column, plain_format: Column, chain: Column | None = None, branch: Column | None = None, prefix: str = PREFIX) -> Column:
    """The unsigned manifest of a row of ``encrypt``: its content is the ciphertext, as plain bytes."""
    content = manifests.content_record(F.col("ciphertext"), "application/octet-stream", "JCS", prefix=prefix)
    return manifests.build(uri, version, F.lit("main") if branch is None else branch, created, content, chain, privacy=encrypted_record(plain_format), prefix=prefix)


def build_disclosure(uri: Column, version: Column, created: Column, content: Column, statements: Column, salt: Column, root: Column, mandatory: Column, profile: str = "URDNA2015", branch: Column | None = None, bucket: int | None = None, prefix: str = PREFIX) -> Column:
    """The unsigned manifest of a disclosure blob, with the key shares of a row of ``share_index_key``.

    Only the graph profile can be disclosed statement by statement; any other raises. Availability is partial.
    ``bucket`` says that the statements were padded to a multiple of it (``hardening.pad_statements``).
    """
    if profile != "URDNA2015":
        raise ValueError(f"selective disclosure needs the graph profile, not {profile}")
    record = manifests.content_record(content, "application/json", profile, prefix=prefix).withField("availability", F.lit("partial"))
    shares = F.struct(F.col("ephemeral_public_key").alias("ephemeralPublicKey"), F.col("iv"), F.lit(AGREEMENT).alias("keyAgreement"), F.col("recipients"))
    told = F.struct(F.lit(PROOF_SUITE).alias("disclosureProofSuite"), statements.alias("statementCount"), F.lit(bucket).cast("int").alias("statementCountBucket"), text.to_base64url(salt).alias("indexSalt"), root.alias("indexRoot"), mandatory.alias("mandatoryStatements"), shares.alias("hmacKeyRecipients"))
    privacy = F.struct(F.lit("selective-disclosure").alias("mode"), told.alias("parameters"))
    return manifests.build(uri, version, F.lit("main") if branch is None else branch, created, record, privacy=privacy, prefix=prefix)


def build_attestation(authority: Column, name: Column, version: Column, created: Column, subject: Column, claim: Column, evidence: Column, chain: Column | None = None, branch: Column | None = None, prefix: str = PREFIX, scheme: str = SCHEME) -> Column:
    """The unsigned attestation manifest: a claim about a subject, and no content."""
    uri = F.concat(F.lit(f"{scheme}://"), authority, F.lit("/attestation/"), name)
    block = F.struct(subject.alias("subject"), claim.alias("claim"), evidence.alias("evidence"))
    return manifests.build(uri, version, F.lit("main") if branch is None else branch, created, None, chain, privacy=F.struct(F.lit("attestation").alias("mode")), attestation=block, kind="AttestationManifest", prefix=prefix)


#: What an opaque delta holds once it is open.
DELTA = "struct<appliesTo:string,operations:string>"


def seal_delta(applies_to: Column, operations: Column, key: Column, nonce: Column) -> Column:
    """The bytes of an opaque delta: what it applies to and its operations (a JSON array), sealed."""
    inner = F.concat(F.lit('{"appliesTo":'), F.concat(F.lit('"'), applies_to, F.lit('"')), F.lit(',"operations":'), operations, F.lit("}"))
    return crypto.seal(key, nonce, inner)


def open_delta(sealed: Column, share: Column, secret: Column, ephemeral_public: Column, nonce: Column, recipient: Column, label: str = CONTENT_LABEL) -> Column:
    """``struct<applies_to, operations, error>`` of an opaque delta, for a recipient with a share of its key.

    ``share`` is the wrapped key, null for who is no recipient. The error says why there is nothing to read.
    """
    plain = crypto.unseal(crypto.unwrap(share, secret, ephemeral_public, nonce, label, recipient), nonce, sealed)
    inner = F.from_json(plain.cast("string"), DELTA)
    error = F.when(share.isNull(), "not a recipient").when(plain.isNull(), "decryption failed").when(F.coalesce(inner["appliesTo"], F.lit("")) == "", "appliesTo missing")
    kept = error.isNull()
    return F.struct(F.when(kept, inner["appliesTo"]).alias("applies_to"), F.when(kept, inner["operations"]).alias("operations"), error.alias("error"))
