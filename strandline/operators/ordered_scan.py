"""Sums, numbers and first-come decisions along one global order, without putting the order into one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.range_scan import PART, range_sorted


def running(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before a row in the order of ``by`` (all ascending; unique).

    Nulls count as 0. Plan: one range sort; the sums of the partitions (one number each) are added up on the driver, a
    pass over each sorted partition does the rest. Use a value of 1 to number rows from 0.
    """
    ordered = range_sorted(df, by)
    kind = "double" if dict(df.dtypes)[value] in ("double", "float") else "bigint"
    sums = {r[0]: r[1] or 0 for r in ordered.groupBy(PART).agg(F.sum(value)).collect()}
    offsets, total = {}, 0
    for part in sorted(sums):
        offsets[part] = total
        total += sums[part]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` {kind}"

    def add(batches):
        so_far = None
        for rows in batches:
            if not len(rows):
                continue
            if so_far is None:
                so_far = offsets[int(rows[PART].iat[0])]
            own = rows[value].fillna(0).to_numpy("float64" if kind == "double" else "int64")
            rows[name] = so_far + np.cumsum(own) - own
            so_far = so_far + own.sum()
            yield rows.drop(columns=[PART])

    return ordered.mapInPandas(add, schema)


def _chain(t: np.ndarray, gap: int) -> np.ndarray:
    """For each row the next one that is kept if it is."""
    return np.searchsorted(t, t + gap, "left")


def separated(df: DataFrame, *, series: str, time: str, key: str, gap: int) -> DataFrame:
    """First come, first kept: rows at least ``gap`` after the last kept one of their series, in the order of (time, key) (SR8).

    Result: series, time, key. Nulls take no part; of equal times the smallest key is kept; an empty table gives an empty
    result.

    Plan: one range sort by (series, time, key). A partition's outcome depends only on the last kept time before it, and
    only through which of the rows within its first ``gap`` is kept first: it is summarised as the steps from there to its own
    last kept time (few, as chains run together). The driver follows the steps, one after another; then each partition is
    passed over again with the time carried in. So no series has to fit into one task.
    """
    rows = df.select(F.col(series).alias("g"), F.col(time).cast("bigint").alias("t"), F.col(key).alias("k")).dropna()
    ordered, kinds = range_sorted(rows, ["g", "t", "k"]), dict(rows.dtypes)

    def parts(batches):
        found = [b for b in batches if len(b)]
        return pd.concat(found, ignore_index=True) if found else None

    def steps(batches):
        if (own := parts(batches)) is None:
            return
        g, t = own["g"].to_numpy(), own["t"].to_numpy()
        last = np.flatnonzero(g != g[-1])
        tail = t[last[-1] + 1 :] if len(last) else t
        nxt, ends = _chain(tail, gap), np.empty(len(tail), "int64")
        for i in range(len(tail) - 1, -1, -1):
            ends[i] = ends[nxt[i]] if nxt[i] < len(tail) else tail[i]
        # what may be kept first: rows within the first gap, and the first row behind it
        n = len(tail) if not len(last) else 1
        reach = min(n, int(np.searchsorted(tail, tail[0] + gap, "left")) + 1)
        at = np.flatnonzero(np.append(ends[1:reach] != ends[: reach - 1], True))
        yield pd.DataFrame({"part": [int(own[PART].iat[0])], "first": [g[0]], "last": [g[-1]], "upto": [tail[:reach][at].tolist()], "ends": [ends[:reach][at].tolist()]})

    kind, carried, state = kinds["g"], {}, None
    for r in sorted(ordered.mapInPandas(steps, f"part int, first {kind}, last {kind}, upto array<bigint>, ends array<bigint>").collect()):
        carried[r["part"]] = state
        if state is None or r["last"] != state[0] or r["first"] != r["last"]:
            state = (r["last"], r["ends"][0])
        elif (i := int(np.searchsorted(r["upto"], state[1] + gap, "left"))) < len(r["ends"]):
            state = (r["last"], r["ends"][i])

    def keep(batches):
        if (own := parts(batches)) is None:
            return
        held = carried[int(own[PART].iat[0])]
        g, t, kept = own["g"].to_numpy(), own["t"].to_numpy(), []
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(g)), strict=True):
            i, inner = 0, t[a:b]
            if held is not None and held[0] == g[a]:
                i = int(np.searchsorted(inner, held[1] + gap, "left"))
            while i < len(inner):
                kept.append(a + i)
                i = int(np.searchsorted(inner, inner[i] + gap, "left"))
        out = own.iloc[kept]
        yield pd.DataFrame({series: out["g"], time: out["t"], key: out["k"]})

    return ordered.mapInPandas(keep, f"`{series}` {kind}, `{time}` bigint, `{key}` {kinds['k']}")
