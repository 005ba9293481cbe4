"""Deterministic hash keys, fractions and orders: the engine's only source of randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


def keyed_hash(*parts) -> Column:
    """Hex SHA-256 of the parts joined by ``:``; strings are literals."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts)), 256)


def fraction(digest: Column) -> Column:
    """The first 64 bits of a hex digest as a share of 2^64."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def coin(digest: Column) -> Column:
    """Parity of a hex digest as 0 or 1."""
    return (F.conv(F.substring(digest, -1, 1), 16, 10).cast("int") % 2).cast("int")


def bucket(digest: Column, size: int) -> Column:
    """The first 32 bits of a hex digest modulo ``size``."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")


def stable_split(key: Column, seed: int | str, train: float = 0.90, validation: float = 0.05) -> Column:
    """``train``, ``validation`` or ``test`` by the key's hash under a seed."""
    if train <= 0 or validation < 0 or train + validation >= 1:
        raise ValueError("split shares must be positive and leave some for the test part")
    at = fraction(keyed_hash(str(seed), key))
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")


def group_key(fields: dict[str, Column]) -> Column:
    """``name:value`` of the first field that is neither null nor blank; raises where there is none."""
    options = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in fields.items()]
    return F.coalesce(*options, F.raise_error(F.lit("record has no field to group by")))
