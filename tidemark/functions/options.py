"""Option gamma and net dealer exposure."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bs_gamma(spot: Column, strike: Column, years: Column, vol: Column, rate: float = 0.04) -> Column:
    """Black-Scholes gamma; 0 unless all inputs are positive numbers and the result is finite."""
    ok = (spot > 0) & (strike > 0) & (years > 0) & (vol > 0) & ~F.isnan(spot) & ~F.isnan(strike) & ~F.isnan(years) & ~F.isnan(vol)
    d1 = F.try_divide(F.ln(F.try_divide(spot, strike)) + (rate + 0.5 * vol * vol) * years, vol * F.sqrt(years))
    gamma = F.when(ok, F.try_divide(F.exp(-0.5 * d1 * d1), spot * vol * F.sqrt(years) * math.sqrt(2 * math.pi)))
    return F.when(~F.isnan(gamma) & (gamma < float("inf")), gamma).otherwise(0.0)


def exposure(right: Column, spot: Column, gamma: Column, interest: Column) -> Column:
    """Dollar gamma per one percent move: calls positive, puts negative."""
    sign = F.when(right == "call", 1.0).otherwise(-1.0)
    return sign * gamma * F.coalesce(interest, F.lit(0.0)) * 100 * spot * spot * 0.01
