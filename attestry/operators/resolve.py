"""Resolving whole tables of requests: address to verified content, with a typed verdict for each.

Every step adds a column that is null where the step holds; the first that is not is the error. The
manifests that requests name or reach are judged once, each against the manifest before it, and a request's
chain is the walk over these verdicts, so that requests that share a chain share the work. What no request
reaches is only read for its links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import crypto, hashing, jsondoc, temporal, text
from attestry.operators import chains, hardening, keys, manifests, privacy
from attestry.operators.manifests import PREFIX, SCHEME
from attestry.plans.durable import cut

#: Error codes in the order of the steps, and labels of wrapped keys.
CODES = ("PARSE_ERROR", "AUTHORITY_NOT_FOUND", "MANIFEST_NOT_FOUND", "STORAGE_CORRUPTION", "MANIFEST_MALFORMED", "IDENTITY_MISMATCH", "SIGNATURE_VERIFICATION_FAILED", "KEY_REVOKED", "KEY_EXPIRED", "KEY_UNKNOWN", "CHAIN_VERIFICATION_FAILED", "CONTENT_NOT_FOUND")
CONTENT_LABEL, HMAC_LABEL = "cek-v1.1", "hmac-v1.1"
MODE_KEYS = {"revoked": "KEY_REVOKED", "rotated-expired": "KEY_EXPIRED", "unknown": "KEY_UNKNOWN"}


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def signed(made: DataFrame, key_table: DataFrame | None = None, at: Column | None = None, canonical: DataFrame | None = None, prefix: str = PREFIX, scheme: str = SCHEME) -> DataFrame:
    """The manifests of ``manifests.read`` with ``signature_ok`` and ``key``, a struct of valid, status, warning.

    Without ``key_table`` the key is the one that the authority in the manifest's address names. With
    it (``keys.flatten``), the key that the signature names is judged at ``at`` first, and only
    signatures of usable keys are worked on. ``canonical`` has manifest_hash and canonical, for
    manifests of the graph profile.
    """
    if canonical is not None:
        made = made.join(canonical.select("manifest_hash", "canonical"), "manifest_hash", "left")
    text_of = F.col("canonical") if canonical is not None else None
    authority = text.authority_of(F.col("id"), scheme)
    profile = F.when(F.col("content").isNotNull(), F.col("content.canonicalization")).otherwise(F.col("signature.canonicalization"))
    if key_table is None or at is None:
        ok = manifests.signature_valid(F.col("doc"), F.col("signature"), text.public_key_of(authority), profile, text_of, prefix)
        none = F.struct(F.lit(True).alias("valid"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("warning"))
        return made.withColumn("signature_ok", ok).withColumn("key", none)
    asked = made.withColumns({"authority": authority, "method": F.col("signature.verificationMethod"), "created": temporal.parse_stamp(F.col("timing.created"))})
    told = keys.statuses(asked, key_table, at)
    named = told.withColumn("key_id", text.key_fragment(F.col("method"))).join(key_table.select("authority", "key_id", "public_key"), ["authority", "key_id"], "left")
    usable = F.when(F.col("key.valid"), F.col("public_key"))
    ok = manifests.signature_valid(F.col("doc"), F.col("signature"), usable, profile, text_of, prefix)
    return named.withColumn("signature_ok", ok).drop("authority", "key_id", "method", "created", "public_key")


def delta_verdicts(made: DataFrame, blobs: DataFrame) -> DataFrame:
    """manifest_hash, delta_verdict: ``valid``, ``warning``, ``invalid``, or null where nothing can be checked.

    A patch is applied to the content of the manifest before and must give the present content's
    address. Graph patches work on the lines of the content: for each line the last op on it counts.
    """
    have = blobs.select(F.col("hash").alias("h"), F.col("bytes").cast("string").alias("body"))
    cur = made.where("delta is not null and chain is not null").select("manifest_hash", "delta", "chain.previous", F.col("content.hash").alias("now"), F.col("content.canonicalization").alias("profile"))
    told = cur.join(made.select(F.col("manifest_hash").alias("previous"), F.col("content.hash").alias("was")), "previous", "left")
    for name, key in (("before", "was"), ("ops", "delta.hash"), ("present", "now")):
        told = told.join(have.withColumnsRenamed({"h": f"{name}__h", "body": name}), F.col(key) == F.col(f"{name}__h"), "left").drop(f"{name}__h")
    stated = (F.col("delta.appliesTo") == F.col("was")) & (hashing.sha256(jsondoc.canonical_json(F.col("ops"))) == F.col("delta.hash")) & chains.coupling_reason(F.col("profile"), F.col("delta.format")).isNull()
    patched = jsondoc.apply_patch(F.when(F.col("profile") == "JCS", F.col("before")), F.col("ops"))
    lines = F.array_distinct(F.filter(F.transform(F.split("before", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#"))))
    ops = F.from_json("ops", "array<struct<op:string,subject:string,predicate:string,object:string>>")

    def line(o: Column) -> Column:
        return F.concat_ws(" ", o["subject"], o["predicate"], o["object"], F.lit("."))

    graph = F.aggregate(ops, lines, lambda told, o: F.when(o["op"] == "add", F.array_union(told, F.array(line(o)))).otherwise(F.array_remove(told, line(o))))
    graph = F.concat(F.array_join(F.array_sort(graph), "\n"), F.lit("\n"))
    gives = hashing.sha256(F.when(F.col("profile") == "JCS", patched).otherwise(graph)) == F.col("now")
    applied = F.col("before").isNotNull() & F.col("ops").isNotNull()
    fallback = hashing.sha256(F.col("present")) == F.col("now")
    return told.select("manifest_hash", chains.delta_verdict(applied, F.coalesce(stated & gives, F.lit(False)), fallback).alias("delta_verdict"))


def _privacy_reason() -> Column:
    """Why a link breaks the rules of privacy modes or of addressing, or null: aliases cur and prev."""
    was, now = privacy.mode_of(F.col("prev.privacy.mode")), privacy.mode_of(F.col("cur.privacy.mode"))
    return F.when(~privacy.transition_valid(was, now), F.concat(F.lit("privacy mode rises: "), was, F.lit(" to "), now)).when(
        ~privacy.addressing_consistent(F.col("cur.content.addressing"), F.col("prev.content.addressing")), "addressing changes"
    )


def mode_changes(heads: DataFrame, judged: DataFrame) -> DataFrame:
    """head, version, from_mode, to_mode: where the privacy mode changes on the way from each head."""
    known = judged.select("manifest_hash", "version_n", privacy.mode_of(F.col("privacy.mode")).alias("mode"), F.col("chain.previous").alias("previous"))
    both = known.join(known.select(F.col("manifest_hash").alias("previous"), F.col("mode").alias("from_mode")), "previous", "left")
    both = cut(both.withColumn("changes", F.col("from_mode") != F.col("mode")))
    return chains.passed(heads, both, "changes").join(both, "manifest_hash").select("head", F.col("version_n").alias("version"), "from_mode", F.col("mode").alias("to_mode"))


def chain_reports(heads: DataFrame, judged: DataFrame, blobs: DataFrame, private: bool = False) -> DataFrame:
    """head, chain_ok, depth, reason, warnings, for heads (manifest_hash) among judged manifests.

    ``judged`` comes from ``signed``. On the way from the head, a manifest fails by its signature or
    key, then by its link, then by its delta; the failure nearest to the head is the reason. With ``private``
    the links also follow the rules of privacy modes and addressing, deltas are left alone since content
    may be sealed, and a link that an attestation is part of gives a warning. Each kind of warning is told
    once, the nearest to the head first.
    """
    rules = first_error(chains.link_reason(), _privacy_reason()) if private else None
    links = chains.link_verdicts(judged.withColumn("chain", _chain(F.col("chain"))), rules)
    deltas = delta_verdicts(judged.where("false") if private else judged, blobs)
    attested = F.when(privacy.mode_of(F.col("privacy.mode")) == "attestation", "no plaintext to compare: attestation") if private else F.lit(None).cast("string")
    own = judged.select("manifest_hash", "signature_ok", F.col("key.valid").alias("key_ok"), F.col("key.warning").alias("key_warning"), F.when(F.col("chain").isNotNull(), attested).alias("mode_warning"))
    told = own.join(links, "manifest_hash", "left").join(deltas, "manifest_hash", "left")
    failure = first_error(
        F.when(~F.col("key_ok"), "key"), F.when(~F.col("signature_ok"), "signature"), F.col("reason"), F.when(F.col("delta_verdict") == "invalid", "delta and content"),
    )
    warned = F.filter(F.array(F.col("key_warning"), F.col("mode_warning"), F.when(F.col("delta_verdict") == "warning", "delta failed, content holds")), lambda w: w.isNotNull())
    told = cut(told.select("manifest_hash", "previous", failure.alias("failure"), warned.alias("marks")))
    way = heads.select("manifest_hash").distinct().join(chains.fold(told), "manifest_hash")
    return way.select(F.col("manifest_hash").alias("head"), F.col("first").isNull().alias("chain_ok"), "depth", F.col("first.failure").alias("reason"), F.col("marks.mark").alias("warnings"))


def _chain(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["previous"].alias("previous"), c["previousBranch"].alias("previous_branch"), c["genesisHash"].alias("genesis_hash"), c["depth"].alias("depth")))


def reachable(requests: DataFrame, blobs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """hash, bytes: the blobs that the requests (manifest_hash) name, those on the way to their genesis, and those that attestations among them are about.

    Only addresses travel: manifests are read for their links, no signature is looked at.
    """
    links = manifests.read(blobs, prefix).select("manifest_hash", F.col("chain.previous").alias("previous"), F.col("attestation.subject.manifestHash").alias("subject"))
    links = cut(links.where("previous is not null or subject is not null"))
    asked = requests.select("manifest_hash").where("manifest_hash is not null").distinct()
    way = chains.reach(asked, links.select("manifest_hash", "previous"))
    about = links.where("subject is not null").join(way, "manifest_hash", "left_semi").select(F.col("subject").alias("manifest_hash"))
    wanted = cut(way.unionByName(about).distinct())
    return blobs.join(wanted, F.col("hash") == F.col("manifest_hash"), "left_semi")


def _judged(requests: DataFrame, blobs: DataFrame, key_table: DataFrame | None, at: Column | None, canonical: DataFrame | None, prefix: str, scheme: str) -> DataFrame:
    """The manifests that the requests need, each verified once: the store's size does not count."""
    sound = reachable(requests, blobs, prefix).where(hashing.sha256(F.col("bytes")) == F.col("hash"))
    return cut(signed(manifests.read(sound, prefix), key_table, at, canonical, prefix, scheme))


def _asked(requests: DataFrame, blobs: DataFrame, judged: DataFrame, scheme: str) -> DataFrame:
    """The requests with the manifest that they name and what is known of it."""
    have = blobs.select(F.col("hash").alias("manifest_hash"), F.col("bytes").alias("raw"))
    told = requests.join(have, "manifest_hash", "left").join(judged, "manifest_hash", "left")
    return told.withColumns({"parsed": text.parse_uri(F.col("uri"), scheme), "derived": text.derive_authority(F.col("public_key"))})


def resolve(requests: DataFrame, blobs: DataFrame, key_documents: DataFrame | None = None, at: Column | None = None, canonical: DataFrame | None = None, prefix: str = PREFIX, scheme: str = SCHEME) -> DataFrame:
    """uri, manifest_hash, ok, error_code, message, content, warnings, key_status for each request.

    ``requests`` has uri, manifest_hash and public_key (bytes), ``blobs`` hash and bytes. With
    ``key_documents`` (see ``keys.flatten``) and ``at``, the life of keys decides instead of the key at
    hand. Chains are only looked at where a manifest has one.
    """
    table = keys.flatten(key_documents) if key_documents is not None and at is not None else None
    judged = _judged(requests, blobs, table, at, canonical, prefix, scheme)
    told = _asked(requests, blobs, judged, scheme)
    reports = chain_reports(told.where("chain is not null"), judged, blobs)
    told = told.join(reports, F.col("manifest_hash") == F.col("head"), "left")
    body = blobs.select(F.col("hash").alias("content_hash"), F.col("bytes").alias("body"))
    told = told.join(body, F.col("content.hash") == F.col("content_hash"), "left")
    by_key = F.when(~F.col("key.valid"), F.element_at(F.create_map(*[F.lit(x) for pair in MODE_KEYS.items() for x in pair]), F.col("key.status")))
    code = first_error(
        F.when(F.col("parsed").isNull(), "PARSE_ERROR"),
        F.when(~F.col("derived").eqNullSafe(F.col("parsed.authority")), "AUTHORITY_NOT_FOUND"),
        F.when(F.col("raw").isNull(), "MANIFEST_NOT_FOUND"),
        F.when(hashing.sha256(F.col("raw")) != F.col("manifest_hash"), "STORAGE_CORRUPTION"),
        F.when(F.col("doc").isNull(), "MANIFEST_MALFORMED"),
        F.when(~F.col("id").eqNullSafe(F.col("uri")), "IDENTITY_MISMATCH"),
        by_key,
        F.when(~F.col("signature_ok"), "SIGNATURE_VERIFICATION_FAILED"),
        F.when(F.col("chain").isNotNull() & ~F.coalesce("chain_ok", F.lit(False)), "CHAIN_VERIFICATION_FAILED"),
        F.when(F.col("body").isNull(), "CONTENT_NOT_FOUND"),
        F.when(~F.coalesce(hashing.verify(F.col("content.hash"), F.col("body"), f"{prefix}:CanonicalContent", "JCS", prefix), F.lit(False)), "STORAGE_CORRUPTION"),
    )
    warned = F.coalesce("warnings", F.filter(F.array(F.col("key.warning")), lambda w: w.isNotNull()))
    told = told.withColumn("error_code", code)
    return told.select("uri", "manifest_hash", F.col("error_code").isNull().alias("ok"), "error_code", F.when(F.col("error_code") == "CHAIN_VERIFICATION_FAILED", F.col("reason")).alias("message"), F.when(F.col("error_code").isNull(), F.col("body")).alias("content"), warned.alias("warnings"), F.col("key.status").alias("key_status"))


# --- privacy modes -------------------------------------------------------------------------------

_SHARE = "array<struct<id:string,encryptedKey:string,encryptedHmacKey:string,disclosedStatements:string>>"
_PARAMETERS = f"refreshPolicy string, iv string, ephemeralPublicKey string, plaintextHash string, recipients {_SHARE}, paddingQuantum int, statementCount int, indexSalt string, indexRoot string, mandatoryStatements array<int>, hmacKeyRecipients struct<ephemeralPublicKey:string,iv:string,recipients:{_SHARE}>, authorityType string, contentVisibility string"
_BLOB = "mandatoryNQuads array<string>, statementIndex array<string>, hmacTags array<string>"


def resolve_private(requests: DataFrame, blobs: DataFrame, subjects: DataFrame | None = None, at: Column | None = None, canonical: DataFrame | None = None, labels: tuple[str, str] = (CONTENT_LABEL, HMAC_LABEL), prefix: str = PREFIX, scheme: str = SCHEME) -> DataFrame:
    """uri, manifest_hash, verified, privacy_mode, content_status, identity_type, warnings, disclosed, content, trust.

    ``requests`` has uri, manifest_hash, public_key, and recipient and secret (bytes), null where there
    are none. Anonymous manifests are handled as their visibility says; unknown modes are verified and
    named as unsupported. Possession never touches content. ``subjects`` (authority, public_key) are
    the keys that attestations' subjects are checked with.
    """
    judged = _judged(requests, blobs, None, None, canonical, prefix, scheme)
    told = _asked(requests, blobs, judged, scheme)
    reports = chain_reports(told.where("chain is not null"), judged, blobs, True)
    told = told.join(reports, F.col("manifest_hash") == F.col("head"), "left")
    told = told.withColumn("mode", privacy.mode_of(F.col("privacy.mode"))).withColumn("pp", F.from_json("privacy.parameters", _PARAMETERS))
    shown = F.coalesce("pp.contentVisibility", F.lit("public"))
    told = told.withColumn("way", F.when(F.col("mode") != "anonymous", F.col("mode")).when(shown.isin("encrypted", "selective-disclosure"), shown).when(shown == "private", "proof-of-possession").otherwise("public"))
    body = blobs.select(F.col("hash").alias("content_hash"), F.col("bytes").alias("body"))
    told = told.join(body, (F.col("content.hash") == F.col("content_hash")) & F.col("way").isin("public", "encrypted", "selective-disclosure"), "left")
    found = F.col("doc").isNotNull() & (hashing.sha256(F.col("raw")) == F.col("manifest_hash"))
    base = first_error(
        F.when(~F.coalesce(found, F.lit(False)), "manifest not found or altered"), F.when(~F.col("signature_ok"), "signature verification failed"),
        F.when((F.col("way") != "attestation") & F.col("chain").isNotNull() & ~F.coalesce("chain_ok", F.lit(False)), F.concat(F.lit("chain verification failed: "), F.coalesce("reason", F.lit("")))),
    )
    sound = F.coalesce(hashing.sha256(F.col("body")) == F.col("content.hash"), F.lit(False))
    public = F.when(F.col("way") == "public", first_error(F.when(~F.col("id").eqNullSafe(F.col("uri")), "identity mismatch"), F.when(~F.col("derived").eqNullSafe(F.col("parsed.authority")), "authority not found")))
    held = F.when(F.col("way").isin("public", "encrypted", "selective-disclosure") & ~sound, "content not found or altered")
    told = told.withColumn("failure", first_error(base, public, held))
    told = _opened(told, labels)
    told = _disclosed(told, labels)
    told = _attested(told, judged, subjects, at, prefix, scheme)
    created = temporal.parse_stamp(F.col("timing.created"))
    stale = (F.col("way") == "proof-of-possession") & temporal.custody_stale(created, F.col("pp.refreshPolicy"), created if at is None else at)
    status = (
        F.when(F.col("way") == "public", "verified").when(F.col("way") == "proof-of-possession", "private-custody-asserted").when(F.col("way") == "encrypted", F.col("opened"))
        .when(F.col("way") == "selective-disclosure", "partial-disclosure").when(F.col("way") == "attestation", "attestation-verified").otherwise("unsupported-mode")
    )
    more = F.filter(F.array(F.col("failure"), F.when(stale, "custody assertion is stale"), F.when(~privacy.known_mode(F.col("mode")), "unsupported privacy mode")), lambda w: w.isNotNull())
    none = F.array().cast("array<string>")
    warned = F.concat(more, *[F.coalesce(c, none) for c in (F.col("warnings"), F.col("open_warnings"), F.col("index_warnings"), F.col("claim_warnings"))])
    identity = F.when(F.col("mode") == "anonymous", F.when(F.coalesce("pp.authorityType", F.lit("ephemeral")) == "ephemeral", "anonymous-ephemeral").otherwise("pseudonymous"))
    ok = F.col("failure").isNull()
    return told.select(
        "uri", "manifest_hash", ok.alias("verified"), F.col("mode").alias("privacy_mode"), status.alias("content_status"), identity.alias("identity_type"), warned.alias("warnings"),
        F.when(ok & (F.col("way") == "selective-disclosure"), F.col("sd.mandatoryNQuads")).alias("disclosed"),
        F.when(ok, F.when(F.col("way") == "public", F.col("body")).when(F.col("way") == "encrypted", F.col("plain"))).alias("content"), F.when(F.col("way") == "attestation", F.col("trust")).alias("trust"),
    )


def _share(recipients: Column) -> Column:
    return F.try_element_at(F.filter(recipients, lambda r: r["id"] == F.col("recipient")), F.lit(1))


def _opened(told: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """Adds plain, opened and open_warnings: encrypted content, where the request brings a key."""
    asked = (F.col("way") == "encrypted") & F.col("secret").isNotNull() & F.col("recipient").isNotNull() & F.col("pp").isNotNull() & F.col("failure").isNull()
    nonce, mine = F.unhex("pp.iv"), _share(F.col("pp.recipients"))
    key = crypto.unwrap(F.unhex(mine["encryptedKey"]), F.when(asked, F.col("secret")), F.unhex("pp.ephemeralPublicKey"), nonce, labels[0], F.col("recipient"))
    inner = crypto.unseal(key, nonce, F.when(asked, F.col("body")))
    told = told.withColumn("inner", inner).withColumn("plain", F.when(F.col("pp.paddingQuantum").isNull(), F.col("inner")).otherwise(hardening.unpad(F.col("inner")))).drop("inner")
    wrong = hashing.sha256(F.col("plain")) != F.col("pp.plaintextHash")
    opened = F.when(~F.coalesce(asked, F.lit(False)), "ciphertext-verified").when(F.col("plain").isNull(), "decryption-failed").otherwise("decrypted-verified")
    said = F.array(F.when(asked & F.col("plain").isNull(), "decryption failed"), F.when(wrong, "plaintext hash mismatch after decryption"))
    return told.withColumns({"opened": opened, "open_warnings": F.filter(said, lambda w: w.isNotNull())})


def _disclosed(told: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """Adds sd and index_warnings: mandatory statements against the index, its root, and their tags."""
    mine = F.col("way") == "selective-disclosure"
    told = told.withColumn("sd", F.from_json(F.when(mine, F.col("body").cast("string")), _BLOB)).withColumn("salt", text.from_base64url(F.col("pp.indexSalt")))
    pairs = F.arrays_zip(F.col("pp.mandatoryStatements").alias("i"), F.slice("sd.mandatoryNQuads", F.lit(1), F.size("pp.mandatoryStatements")).alias("s"))

    def judge(x: Column) -> Column:
        expected = F.try_element_at(F.col("sd.statementIndex"), x["i"] + 1)
        name = x["i"].cast("string")
        return F.when(x["s"].isNull(), F.concat(F.lit("mandatory statement missing: "), name)).when(~F.coalesce(text.to_hex(hashing.salted(F.col("salt"), x["s"])) == expected, F.lit(False)), F.concat(F.lit("mandatory statement not in the index: "), name))

    root = F.sha2(F.unhex(F.array_join("sd.statementIndex", "")), 256)
    stated = F.regexp_replace("pp.indexRoot", "^sha256:", "")
    said = F.filter(F.transform(pairs, judge), lambda w: w.isNotNull())
    said = F.concat(said, F.filter(F.array(F.when(root != stated, "index root mismatch")), lambda w: w.isNotNull()))
    told = told.withColumn("index_warnings", F.when(mine, said))
    # the tags of mandatory statements, for recipients that can recover the key
    box = F.col("pp.hmacKeyRecipients")
    share = _share(box["recipients"])
    asked = mine & F.col("secret").isNotNull() & share.isNotNull() & F.col("failure").isNull()
    nonce = F.unhex(box["iv"])
    told = told.withColumn("hmac_key", crypto.unwrap(F.unhex(share["encryptedHmacKey"]), F.when(asked, F.col("secret")), F.unhex(box["ephemeralPublicKey"]), nonce, labels[1], F.col("recipient")))
    told = told.withColumn("hmac_asked", F.coalesce(asked, F.lit(False))).withColumn("own", F.when(share["disclosedStatements"] == "all", F.lit(None)).otherwise(F.from_json(share["disclosedStatements"], "array<int>")))
    each = told.where("hmac_key is not null").select("uri", "manifest_hash", "recipient", "hmac_key", "salt", "own", F.col("sd.hmacTags").alias("tags"), F.explode(pairs).alias("x")).where("own is null or array_contains(own, x.i)")
    tag = text.to_hex(crypto.hmac_of(F.col("hmac_key"), F.concat(F.col("salt"), F.col("x.s").cast("binary"))))
    bad = each.select("uri", "manifest_hash", "recipient", F.col("x.i").alias("i"), (tag == F.try_element_at(F.col("tags"), F.col("x.i") + 1)).alias("fits"))
    bad = bad.where("not coalesce(fits, false)").groupBy("uri", "manifest_hash", "recipient").agg(F.transform(F.array_sort(F.collect_set("i")), lambda i: F.concat(F.lit("tag verification failed: "), i.cast("string"))).alias("bad_tags"))
    told = told.join(bad, ["uri", "manifest_hash", "recipient"], "left")
    none = F.array().cast("array<string>")
    return told.withColumn("index_warnings", F.concat(F.coalesce("index_warnings", none), F.coalesce("bad_tags", none), F.when(F.col("hmac_asked") & F.col("hmac_key").isNull(), F.array(F.lit("HMAC key decryption failed"))).otherwise(none)))


def _attested(told: DataFrame, judged: DataFrame, subjects: DataFrame | None, at: Column | None, prefix: str, scheme: str) -> DataFrame:
    """Adds trust and claim_warnings: attestations against the manifests that they are about.

    With ``subjects`` a manifest's signature must hold under a key that is given for its authority; without,
    under the key that its authority names.
    """
    about = judged.select(F.col("manifest_hash").alias("subject_hash"), F.col("signature_ok").alias("subject_ok"))
    if subjects is not None:
        wanted = told.select(F.col("attestation.subject.manifestHash").alias("manifest_hash")).where("manifest_hash is not null").distinct()
        known = subjects.select(F.col("authority").alias("known"), F.col("public_key").alias("known_key")).distinct()
        asked = judged.join(wanted, "manifest_hash", "left_semi").join(known, text.authority_of(F.col("id"), scheme) == F.col("known"), "left")
        profile = F.when(F.col("content").isNotNull(), F.col("content.canonicalization")).otherwise(F.col("signature.canonicalization"))
        ok = manifests.signature_valid(F.col("doc"), F.col("signature"), F.col("known_key"), profile, F.col("canonical") if "canonical" in judged.columns else None, prefix)
        about = asked.select(F.col("manifest_hash").alias("subject_hash"), ok.alias("ok")).groupBy("subject_hash").agg(F.max("ok").alias("subject_ok"))
    told = told.join(about, F.col("attestation.subject.manifestHash") == F.col("subject_hash"), "left")
    now = F.col("timing.created") if at is None else temporal.format_stamp(at)
    stale = privacy.attestation_stale(F.col("attestation.claim.validUntil"), now)
    mine = F.col("way") == "attestation"
    said = F.filter(F.array(F.when(stale, "attestation expired"), F.when(F.col("subject_hash").isNull(), "subject manifest unavailable").when(~F.col("subject_ok"), "subject signature verification failed")), lambda w: w.isNotNull())
    return told.withColumns({"trust": privacy.trust(F.col("failure").isNull(), F.lit(False), F.col("subject_ok")), "claim_warnings": F.when(mine, said)})
