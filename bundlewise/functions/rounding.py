"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlewise.functions.binding import let


def round_exact(x: Column, digits: int) -> Column:
    """Round like C's printf: by the exact value of the double, ties to even.

    `F.round` looks at the shortest decimal text instead and would lift 0.1235 (stored slightly lower) to 0.124.
    The sign of 2 * 10^d * x - (2k + 1) decides; x is split into two halves so that both products are exact.
    """
    scale = float(10**digits)

    def halves(v: Column) -> Column:
        wide = v * 134217729.0
        return wide - (wide - v)

    def rounded(v: Column) -> Column:
        return let(
            F.struct(halves(v).alias("high"), F.floor(v * scale).cast("double").alias("k")),
            lambda s: let(
                (s["high"] * (2 * scale) - (2 * s["k"] + 1)) + (v - s["high"]) * (2 * scale),
                lambda side: s["k"]
                + F.when((side > 0) | ((side == 0) & (F.pmod(s["k"], F.lit(2.0)) == 1)), 1.0).otherwise(0.0),
            ),
        )

    return let(x.cast("double"), lambda d: F.signum(d) * let(F.abs(d), rounded) / scale)
