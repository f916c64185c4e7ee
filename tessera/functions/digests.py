"""Digests: canonical JSON for byte-exact ids, ordered digests of groups, fingerprints of schemas and metadata."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"


def canonical_json(value) -> str:
    """Compact JSON with sorted keys, in UTF-8 without escapes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of each JSON text; null where it is none."""

    def one(x):
        try:
            return hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def key_digest(*cols: Column) -> Column:
    """SHA-256 of the values joined by a separator; null is empty."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def group_digest(*cols: Column) -> Column:
    """Digest of a group that doesn't depend on row order and needs no list of its rows: their count, and sum and exclusive or of halves of their MD5."""
    row = F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("bigint")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(half(1).cast("decimal(38,0)")).cast("string"), F.bit_xor(half(17)).cast("string")), 256)


def schema_fingerprint(schema: T.StructType) -> str:
    """Digest of names and types, whatever the order of the fields."""
    return hashlib.sha256(canonical_json({f.name: f.dataType.simpleString() for f in schema.fields}).encode()).hexdigest()


def metadata_digest(title: Column, aliases: Column, tags: Column, slug: Column, normal) -> Column:
    """Fingerprint of a page's normalised metadata; lists are distinct and sorted."""
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), normal))), ",")
    return key_digest(slug, normal(title), listed(aliases), listed(tags))
