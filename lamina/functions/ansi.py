"""32-bit modular arithmetic on BIGINT columns, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 1 << 32


def mul_add_mod32(coef: int, x: Column, add: Column) -> Column:
    """(coef * x + add) mod 2**32 for 0 <= x < 2**32, by 16-bit halves of coef."""
    high, low = coef >> 16, coef & 0xFFFF
    return F.pmod(F.pmod(x * high, F.lit(1 << 16)) * (1 << 16) + x * low + add, F.lit(M32))
