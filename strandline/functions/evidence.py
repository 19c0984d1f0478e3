"""Decisions on measured evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the mouth decision, in the order in which the rules are tried: the label, what the confidence starts from, what
#: is added and by which factor, and the open bounds (measure, above, below).
MOUTH_RULES = [
    ("CLOSED", 0.6, ("closedness", 2.0), [("openness", None, 0.12)]),
    ("CRY", 0.55, ("smile size", 0.4), [("smile", None, -0.25), ("openness", 0.2, None)]),
    ("HAHA", 0.55, ("smile", 0.4), [("smile", 0.35, None), ("openness", 0.18, None), ("width", 0.45, None)]),
    ("O", 0.5, ("roundness", 0.4), [("roundness", 0.55, None), ("openness", 0.22, 0.75), ("width", None, 0.7)]),
    ("E", 0.5, ("width", 0.3), [("width", 0.62, None), ("openness", None, 0.45)]),
    ("A", 0.5, ("openness", 0.4), [("openness", 0.35, None)]),
]
#: The openness below which a mouth is closed, and what no rule holds for.
CLOSED, OTHERWISE = 0.12, ("NEUTRAL", 0.4)


def mouth(openness: Column, width: Column, roundness: Column, smile: Column) -> Column:
    """Shape of a mouth and how sure it is (MTH9): struct(label, confidence); the first rule that holds decides."""
    measure = {"openness": openness, "width": width, "roundness": roundness, "smile": smile, "smile size": F.abs(smile), "closedness": CLOSED - openness}
    out = None
    for label, base, (what, factor), bounds in MOUTH_RULES:
        holds = F.lit(True)
        for name, above, below in bounds:
            holds = holds & (F.lit(True) if above is None else measure[name] > above) & (F.lit(True) if below is None else measure[name] < below)
        value = F.struct(F.lit(label).alias("label"), F.least(F.lit(1.0), base + measure[what] * factor).alias("confidence"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(F.struct(F.lit(OTHERWISE[0]).alias("label"), F.lit(OTHERWISE[1]).alias("confidence")))


def fingerprint_alike(a: Column, b: Column, bits: int = 8, frames: int = 3) -> Column:
    """Whether at least ``frames`` of each side's frames (bigint hashes) have one within ``bits`` on the other (CL7)."""
    near = lambda x, others: F.exists(others, lambda y: F.bit_count(x.bitwiseXOR(y)) <= bits)
    return (F.size(F.filter(a, lambda x: near(x, b))) >= frames) & (F.size(F.filter(b, lambda x: near(x, a))) >= frames)
