"""Manifests as JSON text: building, signing, reading and checking whole tables of them.

Names of fields carry a vocabulary prefix, which is a parameter of every function, as is the scheme of
addresses. Manifests are signed over their canonical JSON, or over a canonical text that the caller
gives for the profile ``URDNA2015``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import crypto, hashing, jsondoc, text

PREFIX, SCHEME = "vk", "vk"
#: The parts of a manifest's records, in order.
PARTS = {
    "timing": "struct<created:string,expires:string>",
    "content": "struct<hash:string,addressing:string,format:string,size:bigint,canonicalization:string,availability:string>",
    "chain": "struct<previous:string,previousBranch:string,genesisHash:string,depth:bigint>",
    "delta": "struct<hash:string,format:string,appliesTo:string,operations:bigint>",
    "semantics": "struct<entailmentMode:string,baseRegime:string,vocabularies:array<string>>",
    "privacy": "struct<mode:string,parameters:string,transitionFrom:string,transitionReason:string>",
    "signature": "struct<type:string,canonicalization:string,created:string,verificationMethod:string,proofPurpose:string,proofValue:string>",
    "attestation": "struct<subject:struct<authority:string,manifestHash:string,contentHash:string,manifestVersion:string>,claim:struct<property:string,value:string,scope:string,attestedAt:string,validUntil:string>,evidence:string>",
}


def read(blobs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """manifest_hash, doc, id, type, version, version_n, branch and the records: blobs that are manifests.

    A blob is one if it is a JSON object with a signature and a version. Parameters of privacy and the
    value of a claim stay JSON text.
    """
    fields = ", ".join([f"`{prefix}:{n}` {kind}" for n, kind in PARTS.items()] + [f"`{prefix}:version` string", f"`{prefix}:branch` string", "`@id` string", "`@type` string"])
    told = blobs.select(F.col("hash").alias("manifest_hash"), F.col("bytes").cast("string").alias("doc"))
    told = told.withColumn("m", F.from_json("doc", fields))
    told = told.where(F.col(f"m.`{prefix}:signature`").isNotNull() & F.col(f"m.`{prefix}:version`").isNotNull())
    version = F.col(f"m.`{prefix}:version`")
    return told.select(
        "manifest_hash", "doc", F.col("m.`@id`").alias("id"), F.col("m.`@type`").alias("type"), version.alias("version"), text.version_number(version).alias("version_n"),
        F.col(f"m.`{prefix}:branch`").alias("branch"), *[F.col(f"m.`{prefix}:{n}`").alias(n) for n in PARTS],
    )


def build(uri: Column, version: Column, branch: Column, created: Column, content: Column, chain: Column | None = None, delta: Column | None = None, semantics: Column | None = None, privacy: Column | None = None, attestation: Column | None = None, kind: str = "ResolutionManifest", prefix: str = PREFIX) -> Column:
    """The JSON text of an unsigned manifest; records that are not given, or null, are left out."""
    parts = {"chain": chain, "delta": delta, "semantics": semantics, "privacy": privacy, "attestation": attestation}
    given = [c.alias(f"{prefix}:{n}") for n, c in parts.items() if c is not None]
    own = [content.alias(f"{prefix}:content")] if content is not None else []
    return F.to_json(
        F.struct(
            F.array(F.lit(f"urn:{prefix}:context")).alias("@context"), uri.alias("@id"), F.lit(f"{prefix}:{kind}").alias("@type"), version.cast("string").alias(f"{prefix}:version"),
            branch.alias(f"{prefix}:branch"), F.struct(created.alias("created")).alias(f"{prefix}:timing"), *own, *given,
        )
    )


def content_record(data: Column, media: str = "application/ld+json", profile: str = "JCS", addressing: str = "raw-sha256", prefix: str = PREFIX) -> Column:
    address = hashing.sha256(data) if addressing == "raw-sha256" else hashing.cid(data.cast("binary"), f"{prefix}:CanonicalContent", profile, prefix)
    return F.struct(address.alias("hash"), F.lit(addressing).alias("addressing"), F.lit(media).alias("format"), F.octet_length(data).cast("long").alias("size"), F.lit(profile).alias("canonicalization"))


def delta_record(ops: Column, applies_to: Column, media: str = "application/json-patch+json") -> Column:
    """The record of a patch, whose ops are a JSON array."""
    return F.struct(hashing.sha256(jsondoc.canonical_json(ops)).alias("hash"), F.lit(media).alias("format"), applies_to.alias("appliesTo"), F.json_array_length(ops).cast("long").alias("operations"))


def anonymous_record(identity: Column, visibility: Column, disclosable: Column) -> Column:
    told = F.struct(identity.alias("authorityType"), visibility.alias("contentVisibility"), disclosable.alias("identityDisclosable"))
    return F.struct(F.lit("anonymous").alias("mode"), told.alias("parameters"))


def address(doc: Column) -> Column:
    """The address of a manifest, signature included."""
    return hashing.sha256(jsondoc.canonical_json(doc))


def unsigned(doc: Column, prefix: str = PREFIX) -> Column:
    """The canonical text without the signature."""
    return jsondoc.apply_patch(doc, F.lit(f'[{{"op":"remove","path":"/{prefix}:signature"}}]'))


def sign(doc: Column, seed: Column, key_id: Column, created: Column, profile: str = "JCS", canonical: Column | None = None, purpose: str = "assertionMethod", prefix: str = PREFIX, scheme: str = SCHEME) -> Column:
    """The canonical JSON text with its signature. Profile and content must agree, else the job stops."""
    if profile != "JCS" and canonical is None:
        raise ValueError(f"profile {profile} needs the canonical text")
    plain = jsondoc.canonical_json(doc)
    stated = F.get_json_object(doc, f"$['{prefix}:content'].canonicalization")
    fits = F.coalesce(stated == profile, F.lit(True))
    authority = text.authority_of(F.get_json_object(doc, "$['@id']"), scheme)
    proof = F.concat(F.lit("z"), text.to_base58(crypto.sign(plain if canonical is None else canonical, seed)))
    block = F.struct(
        F.lit("Ed25519Signature2020").alias("type"), F.lit(profile).alias("canonicalization"), created.alias("created"), F.concat(F.lit(f"{scheme}://"), authority, F.lit("/key/main#"), key_id).alias("verificationMethod"),
        F.lit(purpose).alias("proofPurpose"), proof.alias("proofValue"),
    )
    whole = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(f',"{prefix}:signature":'), F.to_json(block), F.lit("}"))
    return F.when(fits, jsondoc.canonical_json(whole)).otherwise(F.raise_error(F.lit("signature profile and content profile differ")).cast("string"))


def signature_valid(doc: Column, signature: Column, public_key: Column, content_profile: Column | None = None, canonical: Column | None = None, prefix: str = PREFIX) -> Column:
    """Whether a signature record of a document holds. The profile must be that of the content.

    Rows of another profile than JCS need ``canonical``; without it they do not verify. The curve is
    only worked on for rows that pass the comparisons.
    """
    profile = signature["canonicalization"]
    fits = profile.isin("JCS", "URDNA2015") if content_profile is None else profile.isin("JCS", "URDNA2015") & (profile == content_profile)
    message = F.when(fits & (profile == "JCS"), unsigned(F.when(fits, doc), prefix)).when(fits, canonical if canonical is not None else F.lit(None).cast("string"))
    return crypto.verify_signature(message, text.multibase(F.when(message.isNotNull(), signature["proofValue"])), public_key)


def rotation_valid(rotated: Column, new_key: Column) -> Column:
    """Whether both keys signed a rotation: a struct with id, rotated_to, rotated_at, reason, public_key, proof.

    ``proof`` is an array of purpose and proofValue, one for each of the two purposes.
    """
    claim = F.to_json(F.struct(rotated["rotated_to"].alias("newKeyId"), rotated["id"].alias("oldKeyId"), rotated["reason"].alias("reason"), rotated["rotated_at"].alias("rotatedAt")))
    claim = jsondoc.canonical_json(claim)

    def signed(purpose: str) -> Column:
        found = F.filter(rotated["proof"], lambda p: p["purpose"] == purpose)
        return text.multibase(F.try_element_at(found, F.lit(1))["proofValue"])

    both = F.size(rotated["proof"]) == 2
    old = crypto.verify_signature(claim, signed("old-key-authorizes-rotation"), rotated["public_key"])
    new = crypto.verify_signature(claim, signed("new-key-confirms-rotation"), new_key)
    return F.coalesce(both & old & new, F.lit(False))
