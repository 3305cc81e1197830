"""Column expressions used across operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(name: str | Column) -> Column:
    """True where an identifier is neither null nor blank."""
    c = F.col(name) if isinstance(name, str) else name
    return c.isNotNull() & (c != "")


def flag(condition: Column) -> Column:
    """1.0 / 0.0, with an unknown condition counting as false.

    A double literal keeps ``avg`` in double arithmetic; a bare ``1.0`` would be a decimal.
    """
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def days_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros.cast("double") / F.lit(86400e6)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def unpivot_ids(pairs: Mapping[str, str] | Sequence[tuple[str, str]], *, kind: str = "kind", value: str = "value") -> Column:
    """Explodable array of (kind, value) structs, one per id column."""
    items = pairs.items() if isinstance(pairs, Mapping) else pairs
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias(kind), F.col(c).cast("string").alias(value)) for k, c in items])
    )


def listing(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
