"""Flags, tenants and confidence: small rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.keys import md5_mod

ACCEPT, FINAL = 0.7, 0.9


def variant(flag: str, tenant: Column, shares: Sequence[tuple[str, int]]) -> Column:
    """The variant of a tenant: MD5 of `flag:tenant` modulo 100 against cumulative shares in percent; null beyond them."""
    m = md5_mod(F.concat(F.lit(flag + ":"), tenant.cast("string")), 100)
    out, upto = F.lit(None).cast("string"), sum(n for _, n in shares)
    for name, n in reversed(shares):
        out = F.when(m < upto, F.lit(name)).otherwise(out)
        upto -= n
    return out


def enabled(flag: Column, listed: Column, override: Column) -> Column:
    """A tenant's own setting where its overrides are listed (false if they lack this flag), else the flag itself."""
    return F.when(F.coalesce(listed, F.lit(False)), F.coalesce(override, F.lit(False))).otherwise(flag)


def has_access(allowed: Column, capability: Column | str, known: Column | None = None) -> Column:
    """Whether a tenant may use a capability: an empty list allows all, an unknown tenant nothing."""
    may = (F.size(allowed) == 0) | F.array_contains(allowed, capability)
    return may if known is None else F.coalesce(known, F.lit(False)) & F.coalesce(may, F.lit(False))


def within_quota(used: Column, quota: Column) -> Column:
    """Whether a tenant is below its quota; an unknown tenant is."""
    return F.coalesce(used < quota, F.lit(True))


def has_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """Whether a capability has one of the tags."""
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))


def heuristic_confidence(present: Sequence[Column], filled: Sequence[Column]) -> Column:
    """Half for the share of expected keys that are there, half for the share of values that say something."""
    share = lambda parts: sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0)) / float(len(parts))
    return 0.5 * share(present) + 0.5 * share(filled)


def estimate_confidence(cached: Column, validated: Column, completeness: Column | None = None) -> Column:
    """0.5, and 0.2 for a cached and 0.15 for a validated result; where key completeness is known, half of each; 1 at most."""
    base = F.lit(0.5) + F.when(cached, 0.2).otherwise(0.0) + F.when(validated, 0.15).otherwise(0.0)
    if completeness is not None:
        base = F.when(completeness.isNotNull(), 0.5 * base + 0.5 * completeness).otherwise(base)
    return F.least(base, F.lit(1.0))


def gate(confidence: Column, accept: float = ACCEPT, final: float = FINAL) -> Column:
    """final, partial (accepted early) or wait."""
    return F.when(confidence >= final, "final").when(confidence >= accept, "partial").otherwise("wait")
