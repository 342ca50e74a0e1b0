"""Seeded, partition-independent randomness.

``rand()`` depends on partitioning, so every random choice here is a hash of
``seed:salt…:id``. The same expressions are stated in DuckDB by the oracle:
``md5(concat_ws(':', seed, salt…, id))`` and
``('0x'||substr(h,1,13))::BIGINT / 4503599627370496::DOUBLE``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def hash_hex(seed, *parts) -> Column:
    """32-hex-digit md5 of ``seed:part1:part2…`` (order key, ties by id)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_part(p) for p in parts]))


def hex_uniform(h: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits)."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def uniform(seed, *parts) -> Column:
    return hex_uniform(hash_hex(seed, *parts))


def hex_bucket(h: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a hex order key: its first ``digits`` digits."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def py_uniform(seed, *parts) -> float:
    """Driver-side twin of ``uniform`` for small model initialisation."""
    import hashlib
    s = ":".join([str(seed)] + [str(p) for p in parts])
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:13], 16) / TWO_POW_52


def seeded_matrix(seed, salt: str, rows: int, cols: int, scale: float = 1.0):
    """``(u(seed, salt, r, c) - 0.5) * scale`` as nested lists (r x c)."""
    return [[(py_uniform(seed, salt, r, c) - 0.5) * scale for c in range(cols)]
            for r in range(rows)]
