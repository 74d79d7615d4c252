"""Hiding sizes and numbers: padded content, opaque recipients among decoys, statement indexes of a few sizes only.

What is random here follows from a key that the publisher keeps, 32 bytes or more for each row: so a task that runs twice gives
the same, and nobody else can tell padding from what it stands beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import crypto

#: The quantum of sizes in bytes, the bucket of statement numbers, decoys for each content.
QUANTUM, BUCKET, DECOYS = 1024, 8, 2
HEADER = 8  # bytes that hold the true length
PADDING = "<urn:padding:"


def pad(plain: Column, quantum: int = QUANTUM) -> Column:
    """The bytes behind their length, filled with zeros to a multiple of ``quantum``; to be sealed."""
    size = F.octet_length(plain)
    fill = F.pmod(-(size + HEADER), F.lit(quantum))
    return F.concat(F.unhex(F.lpad(F.hex(size), 2 * HEADER, "0")), plain.cast("binary"), F.unhex(F.repeat(F.lit("00"), fill)))


def unpad(padded: Column) -> Column:
    """What ``pad`` was given; null for bytes that it cannot have made."""
    size = F.conv(F.hex(F.substring(padded, 1, HEADER)), 16, 10).cast("decimal(20,0)")
    room = F.octet_length(padded) - HEADER
    fits = (room >= 0) & (size <= room)
    body = F.substring(padded, F.lit(HEADER + 1), F.when(fits, size).cast("int"))
    rest = F.substring(padded, F.lit(HEADER + 1) + F.when(fits, size).cast("int"), F.lit(2**31 - 1))
    return F.when(fits & (F.ltrim(F.hex(rest), F.lit("0")) == ""), body)


def padded_size(size: Column, quantum: int = QUANTUM) -> Column:
    """How many bytes ``pad`` makes of so many."""
    return F.ceil((size + HEADER) / quantum) * quantum


def opaque_id(key: Column, *parts: Column) -> Column:
    """A random-looking UUID of version 4 that follows from a key and what it is for."""
    h = F.lower(F.hex(crypto.hmac_of(key, F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)])).cast("binary"))))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def among_decoys(contents: DataFrame, recipients: DataFrame, decoys: int = DECOYS) -> DataFrame:
    """id, recipient, public_key, real: the recipients of ``publish.encrypt`` under opaque names, and decoys beside them.

    ``contents`` has id and hiding_key (bytes that the publisher keeps), ``recipients`` id, recipient and public_key. Every
    content gets ``decoys`` more, whose secret halves nobody has. ``real`` is the recipient's own name, null for
    decoys: the publisher tells readers their opaque names by it, and leaves it out of what is published.
    """
    keys = contents.select("id", "hiding_key")
    real = recipients.select("id", "recipient", "public_key").join(keys, "id")
    told = real.select("id", opaque_id(F.col("hiding_key"), F.lit("reader"), F.col("id"), F.col("recipient")).alias("opaque"), "public_key", F.col("recipient").alias("real"))
    each = keys.select("id", "hiding_key", F.explode(F.array(*map(F.lit, range(decoys)))).alias("n")) if decoys else keys.select("id", "hiding_key", F.lit(0).alias("n")).where("false")
    lost = crypto.hmac_of(F.col("hiding_key"), F.concat(F.lit("secret "), F.col("id").cast("string"), F.lit(" "), F.col("n").cast("string")).cast("binary"))
    base = F.lit((9).to_bytes(32, "little"))
    made = each.select("id", opaque_id(F.col("hiding_key"), F.lit("decoy"), F.col("id"), F.col("n")).alias("opaque"), crypto.shared_secret(lost, base).alias("public_key"), F.lit(None).cast(told.schema["real"].dataType).alias("real"))
    return told.unionByName(made).select("id", F.col("opaque").alias("recipient"), "public_key", "real")


def pad_statements(text: Column, key: Column, bucket: int = BUCKET) -> Column:
    """A canonical text with as many further statements as make their number a multiple of ``bucket``.

    They come last, so the numbers of the others stay. Their values follow from the key and the text, so that no salted digest
    can be guessed. An empty text gets a whole bucket.
    """
    n = F.size(F.filter(F.split(text, "\n"), lambda s: s != ""))
    more = F.when(n == 0, bucket).otherwise(F.pmod(-n, F.lit(bucket)))
    mark = F.sha2(F.concat(key, F.unhex(F.sha2(F.concat(key, text.cast("binary")), 256))), 256)  # built in, so that a lambda may hold it
    lines = F.transform(F.sequence(F.lit(1), more), lambda k: F.concat(F.lit(PADDING), F.sha2(F.concat(mark, F.lit(":"), k.cast("string")), 256), F.lit('> <urn:padding:pad> "" .\n')))
    ended = F.when(F.endswith(text, F.lit("\n")) | (text == ""), text).otherwise(F.concat(text, F.lit("\n")))
    return F.concat(ended, F.when(more > 0, F.array_join(lines, "")).otherwise(""))


def real_statements(index: DataFrame, statement: str = "statement") -> DataFrame:
    """The rows of an index, or of statements disclosed, that are no padding."""
    return index.where(~F.startswith(statement, F.lit(PADDING)))
