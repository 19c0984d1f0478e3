"""Operators whose result depends on the order of decisions: suppression, grouping, allocation.

Suppression reads a frame's boxes in order and holds what it keeps. Each of the others works on one bounded problem instance
at a time (a block of vectors, one plan's demands); instances run side by side in ``applyInPandas``. An instance above ``most``
rows is an error, not a cut.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bounded(rows: pd.DataFrame, most: int, what: str) -> None:
    if len(rows) > most:
        raise ValueError(f"{what}: an instance of {len(rows)} rows, {most} are the most; divide it by a finer group")


def suppress(df: DataFrame, *, group: str, key: str, limit: float = 0.6, block_rows: int = 512) -> DataFrame:
    """Greedy suppression (CL9): boxes (x, y, w, h, score) of a group, best score first; one that overlaps a kept one by
    ``limit`` or more goes. Result: group, key of the kept. Ties go by key; nulls of group or key are values of their own.

    Plan: one shuffle by group and a sort that may spill; a group is read in its order, batch by batch, and only the boxes
    kept so far are held, so a group may have any number of rows.
    """

    def alike(a: np.ndarray, o: np.ndarray) -> np.ndarray:
        w = np.minimum(a[:, None, 0] + a[:, None, 2], o[:, 0] + o[:, 2]) - np.maximum(a[:, None, 0], o[:, 0])
        h = np.minimum(a[:, None, 1] + a[:, None, 3], o[:, 1] + o[:, 3]) - np.maximum(a[:, None, 1], o[:, 1])
        n = np.maximum(w, 0) * np.maximum(h, 0)
        return n / np.maximum(1, a[:, None, 2] * a[:, None, 3] + o[:, 2] * o[:, 3] - n) >= limit

    def keep(batches):
        held, size, last = np.zeros((64, 4)), 0, None
        for rows in batches:
            if not len(rows):
                continue
            own, b, kept = rows[group], rows[["x", "y", "w", "h"]].to_numpy("float64"), []
            before = pd.concat([pd.Series([last], dtype=object), own.iloc[:-1].astype(object)], ignore_index=True)
            own = own.astype(object).reset_index(drop=True)
            new, last = ((own != before) & ~(own.isna() & before.isna())).to_numpy(), own.iloc[-1]
            # a block lies within one group
            cuts = np.union1d(np.flatnonzero(new), np.arange(block_rows, len(b), block_rows))
            for at in np.split(np.arange(len(b)), cuts[cuts > 0]):
                if new[at[0]]:
                    size = 0
                for start in range(0, size, 4096):
                    at = at[~alike(b[at], held[start : min(start + 4096, size)]).any(1)]
                among, on = alike(b[at], b[at]), np.ones(len(at), bool)
                for i in range(len(at)):
                    if on[i]:
                        on[i + 1 :] &= ~among[i, i + 1 :]
                at = at[on]
                while size + len(at) > len(held):
                    held = np.concatenate([held, np.zeros_like(held)])
                held[size : size + len(at)] = b[at]
                size += len(at)
                kept.append(at)
            yield rows.iloc[np.concatenate(kept)][[group, key]]

    types = dict(df.dtypes)
    score = F.when(~F.isnan(F.col("score").cast("double")), F.col("score"))
    ranked = df.repartition(group).sortWithinPartitions(F.col(group), score.desc_nulls_last(), F.col(key).asc_nulls_last())
    return ranked.select(group, key, "x", "y", "w", "h").mapInPandas(keep, f"{group} {types[group]}, {key} {types[key]}")


def complete_link(df: DataFrame, *, block: str, key: str, vector: str, limit: float, apart: str | None = None, most: int = 5_000) -> DataFrame:
    """Complete-link groups of a block by cosine distance (C8): the two nearest groups merge while their farthest members
    are within ``limit``; rows with the same value of ``apart`` never meet. Result: block, key, group_id (smallest key)."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "complete_link")
        rows = rows.sort_values(key).reset_index(drop=True)
        v = np.array(rows[vector].tolist(), "float64").reshape(len(rows), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        d = np.round(1 - v @ v.T, 9)
        if apart:
            a = rows[apart].to_numpy()
            d[(a[:, None] == a[None, :])] = np.inf
        np.fill_diagonal(d, np.inf)
        live, label = set(range(len(d))), np.arange(len(d))
        heap = [(d[i, j], i, j) for i, j in zip(*np.nonzero(np.triu(d <= limit, 1)), strict=True)]
        heapq.heapify(heap)
        while heap:
            x, i, j = heapq.heappop(heap)
            if i not in live or j not in live or d[i, j] != x:
                continue
            live.discard(j)
            d[i] = d[:, i] = np.maximum(d[i], d[j])
            d[i, i] = np.inf
            label[label == j] = i
            for k in live:
                if k != i and d[i, k] <= limit:
                    heapq.heappush(heap, (d[i, k], min(i, k), max(i, k)))
        return pd.DataFrame({block: rows[block], key: rows[key], "group_id": rows[key].to_numpy()[label]})

    types = dict(df.dtypes)
    return df.groupBy(block).applyInPandas(merge, f"{block} {types[block]}, {key} {types[key]}, group_id {types[key]}")


def leaders(df: DataFrame, *, block: str, key: str, vector: str, limit: float, most: int = 50_000) -> DataFrame:
    """First come, first group (CL3, CL6): a row joins the group of the nearest leader if all its members are within
    ``limit`` (root mean square), else it leads a new one. Rows come by key. Result: block, key, leader."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "leaders")
        rows = rows.sort_values(key).reset_index(drop=True)
        v = np.array(rows[vector].tolist(), "float64").reshape(len(rows), -1)
        groups: list[list[int]] = []
        for i in range(len(v)):
            heads = np.array([np.sqrt(np.mean((v[g[0]] - v[i]) ** 2)) for g in groups])
            for g in np.argsort(heads, kind="stable"):
                if heads[g] > limit:
                    groups.append([i])
                    break
                if (np.sqrt(np.mean((v[groups[g]] - v[i]) ** 2, axis=1)) <= limit).all():
                    groups[g].append(i)
                    break
            else:
                groups.append([i])
        lead = np.empty(len(v), "int64")
        for g in groups:
            lead[g] = g[0]
        return pd.DataFrame({block: rows[block], key: rows[key], "leader": rows[key].to_numpy()[lead]})

    types = dict(df.dtypes)
    return df.groupBy(block).applyInPandas(assign, f"{block} {types[block]}, {key} {types[key]}, leader {types[key]}")


def _free(taken: list[tuple[int, int]], s: int, e: int, gap: int) -> bool:
    i = bisect_left(taken, (s, e))
    return (i == len(taken) or e + gap <= taken[i][0]) and (i == 0 or taken[i - 1][1] + gap <= s)


def choose(needs: list[tuple[int, int]], options: list[tuple[int, int, int, float]], gap: int, nodes: int = 20_000, depth: int = 400) -> tuple[dict[int, int], str]:
    """Assigns demands (id, length) to candidates (id, start, end, score): {demand: candidate}, and how.

    Greedy first, longest demand first, best score first, a candidate's opening used (AS2, SR1). If some demand gets none,
    a bounded search with the fewest options first looks for a full assignment (AS3); without one the greedy result stays.
    Chosen intervals keep ``gap`` between them (C11). How: ``greedy`` (all served), ``searched`` (all served by the search),
    ``none`` (no assignment serves all), ``unknown`` (the search ended after ``nodes`` steps, or more than ``depth`` demands
    made it too deep).
    """
    ranked = sorted(options, key=lambda o: (-o[3], o[1], o[0]))
    taken: list[tuple[int, int]] = []
    greedy: dict[int, int] = {}
    for need, length in sorted(needs, key=lambda n: (-n[1], n[0])):
        for c, s, e, _ in ranked:
            if e - s >= length and _free(taken, s, s + length, gap):
                greedy[need] = c
                insort(taken, (s, s + length))
                break
    if len(greedy) == len(needs):
        return greedy, "greedy"
    if len(needs) > depth:
        return greedy, "unknown"
    count = 0

    @lru_cache(maxsize=100_000)
    def search(left: frozenset, used: tuple) -> tuple | None:
        nonlocal count
        count += 1
        if not left:
            return ()
        if count > nodes:
            return None
        fits = {n: [o for o in ranked if o[2] - o[1] >= n[1] and _free(list(used), o[1], o[1] + n[1], gap)] for n in left}
        need = min(left, key=lambda n: (len(fits[n]), -n[1], n[0]))
        for c, s, _, _ in fits[need]:
            if (rest := search(left - {need}, tuple(sorted((*used, (s, s + need[1])))))) is not None:
                return ((need[0], c), *rest)
        return None

    full = search(frozenset(needs), ())
    if full is not None:
        return dict(full), "searched"
    return greedy, "unknown" if count > nodes else "none"


def allocate(demands: DataFrame, candidates: DataFrame, *, plan: str, gap: int, most: int = 100_000) -> DataFrame:
    """One assignment per plan: ``demands`` (plan, id, length), ``candidates`` (plan, id, s, e, score).

    Result: plan, demand, candidate (null where none fits), how (see :func:`choose`). Plans are independent and run side by side.
    """
    types = dict(demands.dtypes)

    def solve(d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        _bounded(d, most, "allocate")
        _bounded(c, most, "allocate")
        got, how = choose(list(zip(d["id"].tolist(), d["length"].tolist(), strict=True)), list(zip(*(c[x].tolist() for x in ("id", "s", "e", "score")), strict=True)), gap)
        return pd.DataFrame({plan: d[plan], "demand": d["id"], "candidate": pd.array([got.get(x) for x in d["id"]], "Int64"), "how": how})

    return demands.groupBy(plan).cogroup(candidates.groupBy(plan)).applyInPandas(solve, f"{plan} {types[plan]}, demand bigint, candidate bigint, how string")


def separated(df: DataFrame, *, group: str, key: str, gap: int, most: int = 1_000_000) -> DataFrame:
    """Best first, intervals (s, e, score) of a group that keep ``gap`` from all kept before them (SR7). Result: group, key.
    Equal scores go by start, then key."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "separated")
        rows = rows.sort_values(["score", "s", key], ascending=[False, True, True])
        taken: list[tuple[int, int]] = []
        kept = []
        for i, (s, e) in enumerate(zip(rows["s"].tolist(), rows["e"].tolist(), strict=True)):
            if _free(taken, s, e, gap):
                insort(taken, (s, e))
                kept.append(i)
        return rows.iloc[kept][[group, key]]

    types = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(keep, f"{group} {types[group]}, {key} {types[key]}")


def gallery(df: DataFrame, *, group: str, key: str, vector: str, novelty: float, size: int, most: int = 100_000) -> DataFrame:
    """By key, up to ``size`` rows of a group whose cosine distance to all kept ones exceeds ``novelty`` (SR10)."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "gallery")
        rows = rows.sort_values(key)
        v = np.array(rows[vector].tolist(), "float64").reshape(len(rows), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(v)):
            if len(kept) < size and (1 - v[kept] @ v[i] > novelty).all():
                kept.append(i)
        return rows.iloc[kept][[group, key]]

    types = dict(df.dtypes)
    return df.groupBy(group).applyInPandas(keep, f"{group} {types[group]}, {key} {types[key]}")


def first_wins(df: DataFrame, alike: DataFrame, *, key: str, most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` by key, less those that are alike an earlier accepted one (CL8): ``alike`` has (a, b), a < b.

    A rejected row doesn't block later ones, so this is a fold; only the linked rows, block by block of ``block``, are
    folded, rows without a link pass.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "first_wins")
        gone: set = set()
        for b, group in rows.sort_values(["b", "a"]).groupby("b", sort=True):
            if any(a not in gone for a in group["a"]):
                gone.add(b)
        return pd.DataFrame({key: list(gone)})

    types = dict(df.dtypes)
    rejected = alike.groupBy("block").applyInPandas(fold, f"{key} {types[key]}")
    return df.join(rejected, key, "left_anti")
