"""Deterministic randomness as column expressions.

Uniforms come from the first 32 bits of an md5 digest of a text built from
integers and strings, so a draw depends only on its key — never on partitioning
or task order — and the same numbers can be computed in any SQL engine that has
``md5``. Normals use the Box–Muller transform of two such uniforms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_uniform(*parts) -> Column:
    """Uniform in (0, 1) from md5 of ``parts`` joined by ':'."""
    digest = F.md5(_text(parts))
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def hash_normal(*parts) -> Column:
    """Standard normal draw keyed by ``parts`` (Box–Muller on two hash uniforms)."""
    u1 = hash_uniform(*parts, "a")
    u2 = hash_uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_order(*parts) -> Column:
    """Reproducible pseudo-random sort key (hex md5 text) keyed by ``parts``."""
    return F.md5(_text(parts))


def sha1_seed(*parts) -> Column:
    """H5: integer seed from the sha1 of the '|'-joined parts (first 8 hex digits)."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_rank_key(*parts) -> Column:
    """Sortable 60-bit integer from the md5 of ``parts``.

    Orders rows exactly like the md5 hex text except among rows whose first 15
    hex digits agree (probability ~n²/2⁶¹); such ties get an arbitrary but
    consistent order. Sorting a long is far cheaper than sorting 32-char text.
    """
    return F.conv(F.substring(F.md5(_text(parts)), 1, 15), 16, 10).cast("long")
