"""Arithmetic on doubles whose rounding errors are known."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """Two doubles of half the digits each that add up to ``x``."""
    wide = x * F.lit(134_217_729.0)  # 2 ** 27 + 1
    high = wide - (wide - x)
    return high, x - high


def product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b and what its rounding lost."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return a * b, ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding: the errors of the product and of the sum are added last."""
    p, lost = product(a, b)
    total = p + c
    back = total - p
    exact = total + (((p - (total - back)) + (c - back)) + lost)
    # infinite values, and those whose halves are, have no such errors
    return F.when(F.isnan(exact), total).otherwise(exact)


def two_places(x: Column, width: int = 0) -> Column:
    """``x`` as C's ``%.2f`` writes it: the exact value is rounded, where Java rounds its shortest decimal form."""
    size = F.abs(x)
    p, lost = product(size, F.lit(100.0))
    low = F.floor(p)
    half = p - low == 0.5
    up = F.when(half & (lost != 0), lost > 0).when(half, low % 2 == 1).otherwise(p - low > 0.5)
    cents = low + up.cast("long")
    sign = F.when(x < 0, "-").otherwise("")
    text = F.concat(sign, (cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    if width:
        text = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.when(size < 1e13, text).otherwise(F.format_string("%.2f", x))
