"""Gaps and islands: consecutive rows of a series with the same label and small steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.range_scan import Scanner, range_sorted, scan


def _scanner(gap: int | None):
    class Islands(Scanner):
        """State: series, label, start, end, rows, first id, and whether nothing was closed since the scan began."""

        def feed(self, rows):
            g, l, t, k = (rows[c].to_numpy() for c in ("__g", "__l", "__t", "__k"))
            opens = np.ones(len(g), bool)
            opens[1:] = (g[1:] != g[:-1]) | (l[1:] != l[:-1])
            if gap is not None:
                opens[1:] |= t[1:] - t[:-1] > gap
            held = self.state
            joins = held is not None and held[0] == g[0] and held[1] == l[0] and (gap is None or t[0] - held[3] <= gap)
            at = np.flatnonzero(opens)
            end = np.append(at[1:], len(g)) - 1
            frame = pd.DataFrame({"series": g[at], "label": l[at], "s": t[at], "e": t[end], "n": end - at + 1, "first_id": k[at]})
            if joins:
                frame.loc[0, ["s", "n", "first_id"]] = [held[2], held[4] + frame["n"].iat[0], held[5]]
            elif held is not None:
                frame = pd.concat([pd.DataFrame([held[:6]], columns=frame.columns).astype(frame.dtypes), frame], ignore_index=True)
            last, alone = frame.iloc[-1], len(frame) == 1 and (held is None or held[6])
            self.state = (last["series"], last["label"], int(last["s"]), int(last["e"]), int(last["n"]), last["first_id"], alone)
            return frame.iloc[:-1]

        def finish(self):
            return None if self.state is None else pd.DataFrame([self.state[:6]], columns=["series", "label", "s", "e", "n", "first_id"])

        @classmethod
        def combine(cls, before, after):
            if not after[6] or after[:2] != before[:2] or (gap is not None and after[2] - before[3] > gap):
                return after
            return (*before[:3], after[3], before[4] + after[4], before[5], before[6])

    return Islands


def islands(df: DataFrame, *, series: str, time: str, key: str, label: str, gap: int | None = None) -> DataFrame:
    """Longest stretches of rows of a series with one label (C1), cut where a step exceeds ``gap``.

    ``time`` is a whole number; rows are ordered by (time, key). Result: ``series``, ``label``, ``s`` and ``e`` (first and
    last time), ``n``, ``first_id``. Nulls in series, time, key or label drop the row; an empty table gives an empty result.

    Plan: one range shuffle by (series, time, key); a hot series spreads over partitions.
    """
    rows = df.select(F.col(series).alias("__g"), F.col(label).alias("__l"), F.col(time).cast("bigint").alias("__t"), F.col(key).alias("__k")).dropna()
    kind = dict(rows.dtypes)
    schema = f"series {kind['__g']}, label {kind['__l']}, s bigint, e bigint, n bigint, first_id {kind['__k']}"
    return scan(range_sorted(rows, ["__g", "__t", "__k"]), _scanner(gap), schema)
