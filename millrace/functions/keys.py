"""Hashes and set measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def input_hash(capability: Column, payload: Column) -> Column:
    """First 16 hex digits of SHA-256 over the canonical text of capability and payload."""
    return F.substring(F.sha2(F.concat_ws("|", capability, payload), 256), 1, 16)


def lookup_key(capability: Column, payload: Column) -> Column:
    """`capability:hash`, under which a computation is remembered."""
    return F.concat_ws(":", capability, input_hash(capability, payload))


def public_state(state: Column) -> Column:
    """A state map without its private keys, which begin with an underscore."""
    return F.map_filter(state, lambda k, _: ~k.startswith("_"))


def md5_mod(text: Column, n: int) -> Column:
    """The 128-bit MD5 of a text modulo n, digit by digit."""
    digits = F.filter(F.split(F.md5(text.cast("binary")), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda acc, d: ((acc * 16 + F.conv(d, 16, 10).cast("int")) % n).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def equal_digits(a: Column, b: Column) -> Column:
    """Share of the places at which two SHA-256 hex digests have the same digit."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & (x != "")).cast("int"))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / 64


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round-half-even(p * (n - 1)) of a sorted array."""
    place = F.bround(F.lit(p) * (F.size(values) - 1)).cast("int")
    return F.element_at(values, place + 1)


def canonical_json(fields: Column) -> Column:
    """Compact JSON of a struct with nulls kept; fields must come in the order of their names."""
    return F.to_json(fields, {"ignoreNullFields": "false"})
