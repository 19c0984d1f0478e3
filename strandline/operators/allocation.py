"""Assignments: greedy with a ranking that depends on what is chosen, one-to-one matching, acceptance in order."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordered import _bounded, _free
from strandline.storage import cut_lineage


def can_fit(free: list[tuple[int, int]], needs: list[int]) -> bool:
    """Whether the lengths may fit into the free spans (SI11): best fit, longest first. False proves nothing fits this way."""
    room = sorted(e - s for s, e in free)
    for need in sorted(needs, reverse=True):
        i = bisect_left(room, need)
        if i == len(room):
            return False
        left = room.pop(i) - need
        insort(room, left)
    return True


def pick_in_order(needs, options, gap: int, most_alike: int) -> dict:
    """{demand: (candidate, tier)}; longest demand first.

    ``needs`` are (id, length), ``options`` (id, start, end, kind, tier). The next candidate is the one of the lowest tier whose
    kind was used least so far, the earliest of these (C7); its opening is used, ``gap`` away from all others (C11), and
    a kind serves ``most_alike`` demands at most, 0 for any number (C12).
    """
    taken: list[tuple[int, int]] = []
    used: dict = {}
    out = {}
    for need, length in sorted(needs, key=lambda n: (-n[1], n[0])):
        fits = [o for o in options if o[2] - o[1] >= length and _free(taken, o[1], o[1] + length, gap) and (not most_alike or used.get(o[3], 0) < most_alike)]
        if fits:
            best = min(fits, key=lambda o: (o[4], used.get(o[3], 0), o[1], o[0]))
            out[need] = (best[0], best[4])
            used[best[3]] = used.get(best[3], 0) + 1
            insort(taken, (best[1], best[1] + length))
    return out


def allocate_ranked(demands: DataFrame, candidates: DataFrame, *, plan: str, gap: int, most_alike: int, levels: tuple[int, ...] = (99,), most: int = 100_000) -> DataFrame:
    """One assignment per plan: ``demands`` (plan, id, length), ``candidates`` (plan, id, s, e, kind, tier) (AS1, AS2, C7, C12).

    The levels are tried in order, each with the candidates up to its tier, until all demands are served; else the level
    that served most counts, the earliest of those (AS1). Result: plan, demand, candidate (null where none fits), tier,
    level. A plan is one bounded instance: above ``most`` rows it is an error, not a cut. Plans run side by side.
    """
    types = dict(demands.dtypes)

    def solve(d: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        _bounded(d, most, "allocate_ranked")
        _bounded(c, most, "allocate_ranked")
        needs = list(zip(d["id"].tolist(), d["length"].tolist(), strict=True))
        options = list(zip(*(c[x].tolist() for x in ("id", "s", "e", "kind", "tier")), strict=True))
        best, at = {}, levels[0]
        for level in levels:
            got = pick_in_order(needs, [o for o in options if o[4] <= level], gap, most_alike)
            if level == levels[0] or len(got) > len(best):
                best, at = got, level
            if len(best) == len(needs):
                break
        pick = lambda i: pd.array([best[x][i] if x in best else None for x in d["id"]], "Int64")
        return pd.DataFrame({plan: d[plan], "demand": d["id"], "candidate": pick(0), "tier": pick(1), "level": at})

    schema = f"{plan} {types[plan]}, demand bigint, candidate bigint, tier bigint, level bigint"
    return demands.groupBy(plan).cogroup(candidates.groupBy(plan)).applyInPandas(solve, schema)


def matched(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one matching (AS5): ``pairs`` (a, b, score); the highest score first, each side once; ties by a, then b.

    Plan: the greedy result is that of rounds in which every pair is taken that is the best of both its sides; each round
    is two aggregations and two anti-joins, so no group has to fit into one task. Nulls take no part.
    """
    left, out = cut_lineage(pairs.select("a", "b", "score").dropna().groupBy("a", "b").agg(F.max("score").alias("score"))), None
    order = F.struct((-F.col("score")).alias("far"), "a", "b")
    while True:
        by_a, by_b = (left.groupBy(x).agg(F.min(order).alias("m")).select("m.a", "m.b", (-F.col("m.far")).alias("score")) for x in ("a", "b"))
        both = cut_lineage(by_a.join(by_b.select("a", "b"), ["a", "b"]))
        if not both.limit(1).count():
            return both if out is None else out
        out = both if out is None else out.unionByName(both)
        left = cut_lineage(left.join(both.select("a"), "a", "left_anti").join(both.select("b"), "b", "left_anti"))


def accepted_in_order(df: DataFrame, *, plan: str, slot: str, key: str, gap: int, most: int = 1_000_000) -> DataFrame:
    """Rows (plan, slot, key, place, s, e, valid) in the order of place and key, each checked against the accepted before it (VL1, VL2).

    Result: plan, key, issue, rank. ``issue`` is null for an accepted row, else the first of ``invalid`` (its own rules fail),
    ``slot`` (its slot is served already) and ``near`` (closer than ``gap`` to an accepted one); ``rank`` numbers the accepted.
    A rejected row blocks nothing. A plan is one bounded instance; above ``most`` rows it is an error.
    """
    types = dict(df.dtypes)

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        _bounded(rows, most, "accepted_in_order")
        rows = rows.sort_values(["place", key], kind="stable")
        taken: list[tuple[int, int]] = []
        served, issue, rank = set(), [], []
        for ok, where, s, e in zip(rows["valid"].tolist(), rows[slot].tolist(), rows["s"].tolist(), rows["e"].tolist(), strict=True):
            why = "invalid" if not ok else "slot" if where in served else None if _free(taken, s, e, gap) else "near"
            if why is None:
                served.add(where)
                insort(taken, (s, e))
            issue.append(why)
            rank.append(len(taken) if why is None else None)
        return pd.DataFrame({plan: rows[plan], key: rows[key], "issue": issue, "rank": pd.array(rank, "Int64")})

    return df.groupBy(plan).applyInPandas(check, f"{plan} {types[plan]}, {key} {types[key]}, issue string, rank bigint")


def by_priority(choices: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """For each key the best row of the first relation that has one (AS6-AS8): the columns and ``source`` (0, 1, ...)."""
    both = None
    for i, c in enumerate(choices):
        c = c.withColumn("source", F.lit(i))
        both = c if both is None else both.unionByName(c)
    return both.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy("source", *order))).where("__p = 1").drop("__p")


def relaxed(df: DataFrame, *, key: str, tiers: list[dict[str, Column]]) -> DataFrame:
    """Completion by tiers (AS10, C17): each tier names the rules it gives up, and a row is in the first tier whose remaining rules
    it keeps. Per key the rows of the lowest tier, with ``flags``: the rules it really breaks, in order."""
    rules = {n: c for t in tiers for n, c in t.items()}
    gone: list[str] = []
    level = None
    for i, t in enumerate([{}, *tiers]):
        gone += list(t)
        kept = [c for n, c in rules.items() if n not in gone]
        ok = F.lit(True)
        for c in kept:
            ok = ok & F.coalesce(c, F.lit(False))
        level = F.when(ok, i) if level is None else level.when(ok, i)
    flags = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    own = df.withColumn("tier", level).withColumn("flags", flags)
    best = own.groupBy(key).agg(F.min("tier").alias("tier"))
    return own.join(best, [key, "tier"])


def not_recent(options: Column, recent: int = 2) -> Column:
    """Folds an array of option lists into choices (WN22): the first option that isn't among the last ``recent`` choices, the first of
    all where none is left."""

    def step(done, these):
        last = F.slice(done, -F.least(F.size(done), F.lit(recent)), F.lit(recent))
        fresh = F.filter(these, lambda x: ~F.array_contains(last, x))
        return F.concat(done, F.array(F.coalesce(F.get(fresh, F.lit(0)), F.get(these, F.lit(0)))))

    def start(done, these):
        return F.when(F.size(done) == 0, F.array(F.get(these, F.lit(0)))).otherwise(step(done, these))

    return F.aggregate(options, F.array().cast("array<string>"), start)
