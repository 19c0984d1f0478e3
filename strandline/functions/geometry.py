"""Boxes, landmarks, palettes and sampled signals as column expressions. A box is an array (x, y, w, h) of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten screening boxes as fractions of width and height (x, y, w, h).
TILES = [
    (0, 0, 1, 1), (0.15, 0.05, 0.7, 0.9), (0, 0.1, 0.6, 0.8), (0.4, 0.1, 0.6, 0.8),
    (0, 0.075, 0.4, 0.55), (0.3, 0.075, 0.4, 0.55), (0.6, 0.075, 0.4, 0.55), (0, 0.375, 0.4, 0.55), (0.3, 0.375, 0.4, 0.55), (0.6, 0.375, 0.4, 0.55),
]
#: Hue bins (0-15) of each colour band.
BANDS = {"red": [0, 15], "orange": [1], "yellow": [2, 3], "green": [4, 5, 6], "blue": [7, 8, 9, 10], "purple": [11, 12], "pink": [13, 14]}


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over union, the union at least 1."""
    n = shared_area(a, b)
    return n / F.greatest(F.lit(1.0), a[2] * a[3] + b[2] * b[3] - n)


def held_within(inner: Column, outer: Column, share: float = 0.8) -> Column:
    """Whether at least ``share`` of the inner box's area lies in the outer one (MTH6); a box without area isn't held."""
    return (inner[2] > 0) & (inner[3] > 0) & (shared_area(inner, outer) / (inner[2] * inner[3]) >= share)


def centre_within(inner: Column, outer: Column) -> Column:
    x, y = inner[0] + inner[2] / 2, inner[1] + inner[3] / 2
    return x.between(outer[0], outer[0] + outer[2]) & y.between(outer[1], outer[1] + outer[3])


def prominence(box: Column, width: float, height: float, speaking: Column) -> Column:
    """Area, less towards the edges, more while speaking (MTH8)."""
    far = F.hypot((box[0] + box[2] / 2) / width - 0.5, (box[1] + box[3] / 2) / height - 0.5)
    area = F.greatest(F.lit(0.0), box[2] * box[3])
    return area * (1 - 0.4 * F.least(F.lit(1.0), far / 0.7072)) * (1 + 4 * F.coalesce(speaking, F.lit(0.0)))


def clipped_box(box: Column, width: float, height: float) -> Column:
    """Clipped to the frame, rounded to whole numbers (ARR12); null without an area left."""
    x, y = F.greatest(F.lit(0.0), box[0]), F.greatest(F.lit(0.0), box[1])
    r, b = F.least(F.lit(width), box[0] + box[2]), F.least(F.lit(height), box[1] + box[3])
    return F.when((r > x) & (b > y), F.array(*[F.floor(v + 0.5).cast("int") for v in (x, y, r - x, b - y)]))


def tiles(width: Column, height: Column) -> Column:
    """The screening boxes of a frame (MTH21)."""
    return F.array(*[F.array(x * width, y * height, w * width, h * height) for x, y, w, h in TILES])


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p[0] - q[0], p[1] - q[1])


def mouth_ratios(left: Column, right: Column, upper: Column, lower: Column, eye_left: Column, eye_right: Column, nose: Column) -> Column:
    """Measures of landmarks (MTH11): aperture and width by the mouth's and the eyes' distance, and how frontal it is."""
    width = F.greatest(distance(left, right), F.lit(1e-6))
    aperture = distance(upper, lower) / width
    frontal = F.greatest(F.lit(0.0), 1 - F.abs(nose[0] - (left[0] + right[0]) / 2) / width * 2)
    roundness = F.greatest(F.lit(0.0), 1 - F.abs(aperture - 0.6))
    return F.struct(aperture.alias("aperture"), (width / F.greatest(distance(eye_left, eye_right), F.lit(1e-6))).alias("width_ratio"), frontal.alias("frontal"), roundness.alias("roundness"))


def pose_confirmed(seen: Column, required: list[int], least: int) -> Column:
    """Whether all required points are among those seen, and at least ``least`` in all (MTH12)."""
    return (F.size(F.array_except(F.array(*[F.lit(i) for i in required]), seen)) == 0) & (F.size(F.array_distinct(seen)) >= least)


def quality(sharp: Column, size: Column, still: Column) -> Column:
    """Measures in 0..1, weighted (MTH13)."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))
    return 0.5 * unit(sharp) + 0.3 * unit(size * 4) + 0.2 * (1 - unit(still))


def resampled(values: Column, n: int) -> Column:
    """An array on ``n`` even positions by linear interpolation (MTH22); null or empty gives null."""
    last = F.size(values) - 1

    def at(i):
        x = i * last / (n - 1)
        low = F.floor(x).cast("int")
        a, b = F.get(values, low).cast("double"), F.get(values, F.least(low + 1, last)).cast("double")
        return a + (b - a) * (x - low)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def audible(values: Column) -> Column:
    """First and last position above max(0.0001, a thousandth of the peak), peak and rms (MTH23); no bounds in silence."""
    peak = F.array_max(F.transform(values, lambda x: F.abs(x.cast("double"))))
    floor = F.greatest(F.lit(1e-4), peak * 0.001)
    loud = F.filter(F.transform(values, lambda x, i: F.when(F.abs(x.cast("double")) > floor, i)), lambda i: i.isNotNull())
    rms = F.sqrt(total(F.transform(values, lambda x: x.cast("double") * x.cast("double"))) / F.size(values))
    return F.struct(F.array_min(loud).alias("first"), F.array_max(loud).alias("last"), peak.alias("peak"), rms.alias("rms"))


def histogram(values: Column, bins: int = 16) -> Column:
    """Shares of the first ``bins`` magnitudes of an array (MTH31)."""
    some = F.transform(F.slice(values, 1, bins), lambda x: F.abs(x.cast("double")))
    return F.transform(some, lambda x: x / total(some))


def bands(hue: Column) -> Column:
    """The colour bands that hold at least 0.12 of the mass (MTH33), in the order of their names."""
    held = [F.when(total(F.array(*[hue[i] for i in at])) >= 0.12, F.lit(name)) for name, at in sorted(BANDS.items())]
    return F.filter(F.array(*held), lambda x: x.isNotNull())


def _ring(i: Column, j: Column) -> Column:
    return F.least(F.abs(i - j), 16 - F.abs(i - j))


def palette_fits(seen: Column, wanted: Column) -> Column:
    """Whether the seen palette has the (up to two) leading hues of the wanted one (MTH32).

    Leading are the largest bin of at least 0.12 and the largest of those at least three bins from it; each must be seen with
    15 % of its mass, its neighbourhood too, at least 0.02 and 0.03.
    """
    ranked = F.array_sort(F.transform(wanted, lambda x, i: F.struct((-x).alias("m"), (-i).alias("k"))))
    strong = F.filter(ranked, lambda s: -s["m"] >= 0.12)
    first = -F.get(strong, F.lit(0))["k"]
    second = -F.get(F.filter(strong, lambda s: _ring(-s["k"], first) >= 3), F.lit(0))["k"]

    def near(h, i):
        return F.get(h, F.pmod(i - 1, F.lit(16))) + F.get(h, i) + F.get(h, F.pmod(i + 1, F.lit(16)))

    def holds(i):
        around = near(seen, i) >= F.greatest(F.lit(0.03), near(wanted, i) * 0.15)
        return i.isNull() | (around & (F.get(seen, i) >= F.greatest(F.lit(0.02), F.get(wanted, i) * 0.15)))

    return holds(first) & holds(second)


def histogram_shared(a: Column, b: Column) -> Column:
    """Intersection of two histograms (CL10)."""
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
