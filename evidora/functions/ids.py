"""Stable ids from content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column, prefix: str = "") -> Column:
    """Sixteen hex digits of the SHA-256 of the parts joined by '||'."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256), F.lit(16)))


def point_id(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256, written as a UUID."""
    return F.regexp_replace(F.left(F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def chunk_key(source: Column, sequence: Column, display: Column) -> Column:
    """source||sequence, or the MD5 of the text where both are missing."""
    return F.when((F.coalesce(source, F.lit("")) != "") | sequence.isNotNull(), F.concat(F.coalesce(source, F.lit("")), F.lit("||"), F.coalesce(sequence.cast("string"), F.lit("")))).otherwise(F.md5(F.coalesce(display, F.lit(""))))
