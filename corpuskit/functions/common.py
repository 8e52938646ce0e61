from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Spark does not share common subexpressions across CASE branches or inside
    higher-order functions; binding through a one-element ``transform`` makes
    an expensive intermediate (a split text, a joined array) computed once.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def md5_bucket(id_col, seed: str | None = None, modulo: int = 100) -> Column:
    """Deterministic bucket of an id: first 32 bits of md5(id‖seed) mod ``modulo``."""
    key = to_col(id_col).cast("string")
    if seed is not None:
        key = F.concat(key, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % modulo
