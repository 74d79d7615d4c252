"""Base 32 against the standard library's, for all lengths up to two identifiers, and how little it writes down."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import functions as F

from attestry.functions import hashing, text


def test_base32_of_all_lengths(spark):
    rows = [(n, (hashlib.sha512(bytes([n])).digest() * 2)[:n] if n % 7 else bytes(n)) for n in range(73)] + [(-1, None), (100, b"\xff" * 36)]
    told = spark.createDataFrame(rows, "n int, d binary").select("n", "d", text.to_base32(F.col("d")).alias("b")).collect()
    for r in told:
        assert r.b == (None if r.d is None else base64.b32encode(bytes(r.d)).decode().rstrip("=").lower())


def test_the_envelope_does_not_write_content_in_hexadecimal(spark, capsys):
    spark.range(1).select(hashing.envelope(F.col("id").cast("string").cast("binary"), "Content", "JCS", "vk")).explain(True)
    assert "hex(cast(cast(id" not in capsys.readouterr().out
