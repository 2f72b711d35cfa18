"""Number conversions with truncation and saturation, as Column expressions.

Spark's ANSI casts raise on overflow and NaN; these clamp first, map NaN to 0 and keep nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I32 = (-2147483648, 2147483647)


def _clamped(x: Column, low: float, high: float) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0.0)).when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def to_i32(x: Column) -> Column:
    """Truncates toward zero and saturates at 32 bits."""
    return _clamped(x, *I32).cast("int")


def to_index(x: Column) -> Column:
    """Truncates toward zero; negative numbers become 0."""
    return _clamped(x, 0, 2.0**62).cast("bigint")


def to_u8(x: Column) -> Column:
    """Truncates toward zero and saturates at 0 and 255."""
    return _clamped(x, 0, 255).cast("int")


def side(d: Column) -> Column:
    """1 for zero and above, else -1."""
    return F.when(d >= 0, 1).otherwise(-1)


def idiv(a: Column, b: int | Column) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("bigint")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def trilinear(c: list[Column], tx: Column, ty: Column, tz: Column) -> Column:
    """Interpolates eight corners, numbered x + 2y + 4z: along x, then y, then z."""
    y0, y1 = lerp(lerp(c[0], c[1], tx), lerp(c[2], c[3], tx), ty), lerp(lerp(c[4], c[5], tx), lerp(c[6], c[7], tx), ty)
    return lerp(y0, y1, tz)
