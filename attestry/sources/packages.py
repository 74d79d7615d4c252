"""Export packages: one JSON row with all entries, written and read set at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import hashing, text
from attestry.operators import manifests
from attestry.operators.manifests import PREFIX

ENTRY = "struct<hash:string,data:string>"
PACKAGE = f"struct<version:int,authority:string,uri:string,publicKey:string,entries:array<{ENTRY}>>"


def is_manifest(doc: Column) -> Column:
    """Whether a JSON text is a manifest: it has a signature and a version. Other bytes are content."""
    tree = F.try_parse_json(doc)
    has = [F.try_variant_get(tree, f"$.{k}", "variant").isNotNull() for k in ("signature", "version")]
    return F.coalesce(has[0] & has[1], F.lit(False))


def export(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """uri, package: one JSON text for each head.

    ``heads`` has uri, authority and public_key; ``entries`` has uri, hash and bytes, a package's worth for
    each uri. Entries are in order of their addresses.
    """
    rows = F.array_sort(F.collect_list(F.struct("hash", text.to_base64url(F.col("bytes")).alias("data"))))
    packed = entries.groupBy("uri").agg(rows.alias("entries"))
    told = heads.join(packed, "uri").select("uri", F.to_json(F.struct(F.lit(1).alias("version"), "authority", "uri", text.to_base64url(F.col("public_key")).alias("publicKey"), "entries")).alias("package"))
    return told


def load(packages: DataFrame, column: str = "package") -> DataFrame:
    """uri, hash, bytes, kind, error: the entries of packages, each checked against its address.

    A package of another version, without its fields or with a key that is not 32 bytes gives one row
    with the error; one entry whose bytes do not have their address makes its whole package fail.
    """
    p = packages.select(F.from_json(F.trim(F.col(column)), PACKAGE).alias("p"), F.monotonically_increasing_id().alias("n")).select("n", "p.*")
    key = text.from_base64url(F.col("publicKey"))
    error = F.when(F.col("version").isNull() | (F.col("version") != 1), "version").when(F.col("authority").isNull() | F.col("uri").isNull() | F.col("entries").isNull(), "missing field").when(~F.coalesce(F.octet_length(key) == 32, F.lit(False)), "public key")
    data = F.transform("entries", lambda e: F.struct(e["hash"].alias("hash"), text.from_base64url(e["data"]).alias("bytes")))
    told = p.select("uri", error.alias("error"), data.alias("entries"))
    wrong = F.exists("entries", lambda e: ~F.coalesce(hashing.verify(e["hash"], e["bytes"]), F.lit(False)))
    told = told.withColumn("error", F.coalesce("error", F.when(wrong, "integrity")))
    rows = told.where("error is null").select("uri", F.explode("entries").alias("e")).select("uri", "e.*", F.when(is_manifest(F.col("e.bytes").cast("string")), "manifest").otherwise("content").alias("kind"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    return rows.unionByName(told.where("error is not null").select("uri", none.cast("string").alias("hash"), none.cast("binary").alias("bytes"), none.cast("string").alias("kind"), "error"))


def scan_files(spark, path: str) -> DataFrame:
    """hash, bytes of files that are named by their address, with ``-`` for ``:``."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "^sha256-", "sha256:")
    return spark.read.format("binaryFile").load(path).select(name.alias("hash"), F.col("content").alias("bytes"))


def file_name(base: str, address: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), F.translate(address, ":", "-"))


def write_files(blobs: DataFrame, path: str) -> int:
    """Writes each blob to a file that is named by its address, as ``scan_files`` reads them; gives their number.

    ``path`` is an address of a store that every executor reaches. Tasks write their rows one by one, each under a
    name of its own first, so that a task that runs twice leaves whole files only.
    """
    named = blobs.select(F.regexp_replace(file_name("", F.col("hash")), "^/", "").alias("name"), "bytes").dropDuplicates(["name"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch["name"].to_pylist(), batch["bytes"].to_pylist()):
                passing = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(passing) as f:
                    f.write(data)
                store.move(passing, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return named.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def published(heads: DataFrame, blobs: DataFrame, scheme_prefix: str = PREFIX) -> DataFrame:
    """uri, hash, bytes: what the package of each head (uri, manifest_hash) holds, by the head's own records.

    That is the manifest and its content, if the store has it (sealed content stays sealed; custody
    has none), and of an attestation the manifest that it is about and that one's content.
    """
    wanted = heads.select("uri", F.col("manifest_hash").alias("hash"))
    have = blobs.select("hash", "bytes")
    first = wanted.join(have, "hash")
    told = first.join(manifests.read(first.select("hash", "bytes").dropDuplicates(["hash"]), scheme_prefix).withColumnRenamed("manifest_hash", "hash"), "hash")
    content = told.select("uri", F.col("content.hash").alias("hash"))
    subject = told.select("uri", F.col("attestation.subject.manifestHash").alias("hash")).where("hash is not null").join(have, "hash")
    about = subject.join(manifests.read(subject.select("hash", "bytes").dropDuplicates(["hash"]), scheme_prefix).withColumnRenamed("manifest_hash", "hash"), "hash").select("uri", F.col("content.hash").alias("hash"))
    rest = content.unionByName(about).where("hash is not null").distinct().join(have, "hash")
    return first.unionByName(rest).unionByName(subject).dropDuplicates(["uri", "hash"]).select("uri", "hash", "bytes")
