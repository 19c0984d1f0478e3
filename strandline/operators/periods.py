"""Continuous periods and gaps of overlapping intervals, without gathering an entity in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.range_scan import Scanner, range_sorted, scan

#: Above this many milliseconds a double no longer holds each whole number.
EXACT_MS = float(2**53)


def whole_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, halves away from zero; null for null, NaN, infinite and out-of-range values."""
    ms = F.round(seconds * 1000)
    return F.when(F.abs(ms) < EXACT_MS, ms.cast("bigint"))


def _scanner(entity: list[str]):
    class Periods(Scanner):
        """State: (entity values, start of the open period, its end so far)."""

        def feed(self, rows):
            n = len(rows)
            s, e = rows["__s"].to_numpy(), rows["__e"].to_numpy().copy()
            new = np.zeros(n, bool)
            for c in entity:
                v = rows[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            held = self.state
            goes_on = held is not None and held[0] == tuple(rows[c].iat[0] for c in entity)
            if goes_on:
                e[0] = max(e[0], held[2])
            else:
                new[0] = True
            high = pd.Series(e).groupby(np.cumsum(new)).cummax().to_numpy()
            before = np.append(held[2] if goes_on else 0, high[:-1])
            at = np.flatnonzero(new | (s > before))
            starts, ends = s[at], np.append(high[at[1:] - 1], high[-1:]) if len(at) else s[:0]
            cols = {c: rows[c].to_numpy()[at] for c in entity}
            if held is not None:
                until = held[2] if not goes_on else int(before[at[0]]) if len(at) else int(high[-1])
                starts, ends = np.append(held[1], starts), np.append(until, ends)
                cols = {c: np.append(np.array([k], dtype=cols[c].dtype), cols[c]) for c, k in zip(entity, held[0], strict=True)}
            self.state = (tuple(cols[c][-1] for c in entity), int(starts[-1]), int(ends[-1]))
            done = len(starts) - 1
            gap = np.flatnonzero(np.logical_and.reduce([cols[c][1:] == cols[c][:-1] for c in entity]))
            return pd.DataFrame(
                {
                    **{c: np.concatenate([v[:done], v[gap]]) for c, v in cols.items()},
                    "kind": ["period"] * done + ["gap"] * len(gap),
                    "start_ms": np.concatenate([starts[:done], ends[gap]]).astype("int64"),
                    "end_ms": np.concatenate([ends[:done], starts[gap + 1]]).astype("int64"),
                }
            )

        def finish(self):
            if self.state is None:
                return None
            key, start, end = self.state
            return pd.DataFrame({**{c: [k] for c, k in zip(entity, key, strict=True)}, "kind": ["period"], "start_ms": [start], "end_ms": [end]})

        @classmethod
        def combine(cls, before, after):
            # rows are sorted: the same entity at the end means that the partition holds no other
            if after[0] != before[0] or after[1] > before[2]:
                return after
            return before[0], before[1], max(before[2], after[2])

    return Periods


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Merges intervals that overlap or touch into periods and lists the open time between successive periods.

    ``start`` and ``end`` are whole numbers (see :func:`whole_ms`). Result: the entity columns, ``kind`` (``period`` or
    ``gap``), ``start_ms``, ``end_ms``; other columns of the input are ignored, whatever their names.

    Defined cases: a null entity column, a null bound or an end not above its start drops the row; repeated and nested
    rows change nothing; an empty table gives an empty result.

    Plan: equal (entity, start) are reduced to their largest end before anything is sorted (map-side first), then one
    range shuffle by (entity, start). A hot entity spreads over partitions; periods that cross them are labelled from
    the carried maximum end.
    """
    types = dict(df.dtypes)
    known = df.select(*[F.col(c) for c in entity], F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e")).dropna()
    longest = known.where("__e > __s").groupBy(*entity, "__s").agg(F.max("__e").alias("__e"))
    ordered = range_sorted(longest, [*entity, "__s"])
    schema = ", ".join(f"`{c}` {types[c]}" for c in entity) + ", kind string, start_ms bigint, end_ms bigint"
    return scan(ordered, _scanner(entity), schema)
