"""Compositing: folds the samples along a surface's normal into one value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import to_u8

MAX, ALPHA, HEIGHT = "max", "alpha", "alpha height map"


@dataclass(frozen=True)
class Composite:
    """How samples are folded; the alpha window, threshold and opacity in the units of their sliders."""

    mode: str = ALPHA
    in_front: int = 6
    behind: int = 6
    alpha_min: int = 76
    alpha_max: int = 178
    threshold: int = 9500
    opacity: int = 1
    reverse: bool = False

    @property
    def layers(self) -> int:
        return self.in_front + self.behind + 1

    def steps(self, layer: int = 0) -> list[int]:
        """The layers in the order in which a ray meets them."""
        way = -1 if self.reverse else 1
        start, end = layer + way * self.in_front, layer - way * (self.behind + 1)
        return list(range(start, end, 1 if start < end else -1))


def _fold(samples: Column, how: Composite) -> Column:
    """The alpha fold over an array of values in ray order; `done` stops it once alpha reaches the threshold."""
    low, high, cutoff, opacity = how.alpha_min / 255.0, how.alpha_max / 255.0, how.threshold / 10000.0, how.opacity / 100.0
    zero = F.struct(F.lit(0.0).alias("alpha"), F.lit(0.0).alias("value"), F.lit(0.0).alias("depth"), F.lit(False).alias("done"))

    def step(s: Column, a: Column) -> Column:
        value = F.least(F.greatest((a.cast("double") / 255.0 - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        weight = (1.0 - s.alpha) * F.least(value * opacity, F.lit(1.0))
        seen = value != 0.0
        gain = weight * (s.depth if how.mode == HEIGHT else value)
        new = F.struct(F.when(seen, s.alpha + weight).otherwise(s.alpha).alias("alpha"), F.when(seen, s.value + gain).otherwise(s.value).alias("value"), (s.depth + 1.0).alias("depth"), (seen & (s.alpha + weight >= cutoff)).alias("done"))
        return F.when(s.done, s).otherwise(new)

    def result(s: Column) -> Column:
        if how.mode == ALPHA:
            return to_u8(s.value * 255.0)
        return F.when(s.alpha == 0.0, 0).otherwise(to_u8(255.0 - s.value / s.alpha * 255.0 / float(how.layers)))

    return F.aggregate(samples, zero, step, result)


def composite(samples: DataFrame, keys: list[str], order: str, value: str, how: Composite) -> DataFrame:
    """(keys, v): each ray's samples folded.  A ray has `how.layers` samples, so its array is small."""
    if how.mode == MAX:
        return samples.groupBy(*keys).agg(F.max(value).alias("v"))
    ray = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return samples.groupBy(*keys).agg(ray.alias("ray")).select(*keys, _fold(F.col("ray"), how).alias("v"))
