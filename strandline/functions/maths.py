"""Times, boxes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ticks of a project timeline in a second.
TICKS = 254_016_000_000


def ticks_to_seconds(ticks: Column) -> Column:
    """Null for text that is no whole number (MTH1)."""
    return F.expr("1") * ticks.try_cast("bigint") / TICKS


def seconds_to_ticks(seconds: Column) -> Column:
    return F.round(seconds * TICKS).cast("bigint")


def snap(seconds: Column, fps: float) -> Column:
    """To the nearest frame (MTH4)."""
    return F.round(seconds * fps) / fps


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes, the union at least 1 (MTH5)."""
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return w * h / F.greatest(F.lit(1), aw * ah + bw * bh - w * h)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; null if not finite or of no length (MTH20)."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 1e-12) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def is_number(x: Column) -> Column:
    """Finite (MTH25)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def first_rule(rules: list[tuple[Column, object]], default) -> Column:
    """A list of decisions of which the first that holds wins (MTH9, MTH16)."""
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(default)


def pick_with_margin(scores: dict[str, Column], floor: float) -> Column:
    """The label of the highest score and its lead over the second; ``neutral`` below the floor (MTH15)."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(n).alias("label")) for n, s in scores.items()]))
    best, second = -ranked[0]["s"], -ranked[1]["s"]
    return F.struct(F.when(best < floor, "neutral").otherwise(ranked[0]["label"]).alias("label"), (best - second).alias("margin"))


def bit_reversed(i: Column, bits: int) -> Column:
    """Visiting order that halves the remaining distance (MTH24)."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("bigint")
