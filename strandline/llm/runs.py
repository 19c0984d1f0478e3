"""Problem 3: runs of identical or nearly identical consecutive events become one event."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import folded, letters
from strandline.operators.range_scan import Scanner, range_sorted, scan

#: Spellings a worker remembers at most.
REMEMBERED = 500_000


def edits(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel (Myers)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for c in b:
        eq = at.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(across | plus) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | ~(across | up) & full, up & across
    return score


def _bags(names: Sequence[str], place: dict[str, int]) -> np.ndarray:
    """How often each letter stands in each name; letters that no entry has share a last place."""
    out = np.zeros((len(names), len(place) + 1), "int16")
    for i, s in enumerate(names):
        for c in s:
            out[i, place.get(c, len(place))] += 1
    return out


def _signs(text: str) -> str:
    """Everything of a folded text but white space: tells entries apart whose letters are the same."""
    return "".join(folded(text).split())


class Vocabulary:
    """Gives each spelling the entry it names: at most ``max_edits`` letter edits away, the nearest one.

    Where several are equally near by their letters, that which is nearest in all its signs (digits, punctuation) is named,
    then the first in the order of the alphabet, so that no spelling near to an entry is lost. An entry without letters
    is named by its own signs only.
    """

    def __init__(self, entries: Sequence[str], max_edits: int = 2):
        self.entries = sorted({e for e in entries if e and _signs(e)})
        self.folded, self.signs = [letters(e) for e in self.entries], [_signs(e) for e in self.entries]
        self.place = {c: i for i, c in enumerate(sorted(set("".join(self.folded))))}
        self.max_edits, self.bags, self.known = max_edits, _bags(self.folded, self.place), {}
        self.bare = {s: j for j, s in reversed(list(enumerate(self.signs))) if not self.folded[j]}

    def codes(self, spellings: Sequence[str]) -> np.ndarray:
        """The entry's number of each spelling, -1 where it names none."""
        new = [s for s in dict.fromkeys(spellings) if s not in self.known]
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = list(dict.fromkeys(spellings))
            own = [letters(s) for s in new]
            # an edit changes the letter counts by two at most
            near = np.abs(_bags(own, self.place)[:, None, :] - self.bags[None]).sum(2) <= 2 * self.max_edits
            for i, (s, f) in enumerate(zip(new, own, strict=True)):
                got = [(edits(f, self.folded[j]), j) for j in np.flatnonzero(near[i]).tolist() if f and self.folded[j]]
                least = min((d for d, _ in got), default=self.max_edits + 1)
                if least > self.max_edits:
                    self.known[s] = self.bare.get(_signs(s), -1)
                    continue
                tied = [j for d, j in got if d == least]
                self.known[s] = tied[0] if len(tied) == 1 else min((edits(_signs(s), self.signs[j]), j) for j in tied)[1]
        return np.array([self.known[s] for s in spellings], "int64")


def agglomerate(labels: list[str], counts: list[int], joinable: np.ndarray, similarity: Callable[[str, str], float], least: float) -> np.ndarray:
    """Merges neighbouring runs, always the most similar pair first, until none is similar enough.

    ``joinable[i]`` says whether run i and run i + 1 may touch at all (same entity, small gap). A merged run goes by the
    label that holds most of it. A heap holds the pairs, a linked list the neighbours. Returns, per run, whether a run
    of the result begins there.
    """
    n = len(labels)
    begins = np.ones(n, bool)
    label, count = list(labels), list(counts)
    after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    alive = joinable.tolist()

    def push(i: int) -> None:
        if 0 <= i and after[i] < n and alive[after[i] - 1] and (s := similarity(label[i], label[after[i]])) >= least:
            heapq.heappush(heap, (-s, i, after[i], stamp[i], stamp[after[i]]))

    heap: list = []
    for i in np.flatnonzero(joinable[: n - 1]).tolist():
        push(i)
    while heap:
        _, i, j, si, sj = heapq.heappop(heap)
        if stamp[i] != si or stamp[j] != sj or after[i] != j:
            continue
        begins[j] = False
        if count[j] > count[i]:
            label[i] = label[j]
        count[i] += count[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        stamp[i] += 1
        stamp[j] = -1
        push(i)
        push(before[i])
    return begins


def _scanner(entity: str, time: str, key: str, label: str, entries: Sequence[str], max_edits: int, max_gap: float):
    vocabulary, closeness = Vocabulary(entries, max_edits), {}

    def similarity(a: str, b: str) -> float:
        """1 for the same spelling, less by the share of differing letters; 0 between entries."""
        if a == b:
            return 1.0
        if (a, b) not in closeness:
            if len(closeness) > REMEMBERED:
                closeness.clear()
            x, y = vocabulary.codes([a, b])
            fa, fb = letters(a), letters(b)
            closeness[a, b] = max(1 - edits(fa, fb) / max(len(fa), len(fb), 1), 0.05) if x == y >= 0 else 0.0
        return closeness[a, b]

    class Runs(Scanner):
        """State: entity, label, code, first id and time, last id and time, count, and whether it began with the scan."""

        def feed(self, rows):
            codes, seen = pd.factorize(rows[label])
            code = vocabulary.codes(list(seen))[codes] if len(seen) else np.array([], "int64")
            keep = code >= 0
            e, t, k = (rows[c].to_numpy()[keep] for c in (entity, time, key))
            text, code = codes[keep], code[keep]
            if len(k):
                again = np.append(self.state is not None and k[0] == self.state[5], k[1:] == k[:-1])
                e, t, k, text, code = (x[~again] for x in (e, t, k, text, code))
            if not len(k):
                return None
            fresh = self.state is None
            # identical neighbours are the most similar of all: they are joined first, at once
            touch = (e[1:] == e[:-1]) & (t[1:] - t[:-1] <= max_gap)
            first = np.flatnonzero(np.append(True, ~(touch & (text[1:] == text[:-1]))))
            last = np.append(first[1:], len(k)) - 1
            names = [seen[i] for i in text[first]]
            runs = [e[first], code[first], k[first], t[first], k[last], t[last], last - first + 1]
            if not fresh:
                held = self.state
                names.insert(0, held[1])
                runs = [np.append(np.array([v], dtype=r.dtype), r) for v, r in zip((held[0], held[2], held[3], held[4], held[5], held[6], held[7]), runs, strict=True)]
            e, code, fid, ft, lid, lt, n = runs
            may = (e[1:] == e[:-1]) & (ft[1:] - lt[:-1] <= max_gap) & (code[1:] == code[:-1])
            at = np.flatnonzero(agglomerate(names, n.tolist(), np.append(may, False), similarity, 0.05))
            end = np.append(at[1:], len(e)) - 1
            total = np.add.reduceat(n, at)
            out = pd.DataFrame(
                {
                    "entity": e[at[:-1]], "category": [vocabulary.entries[c] for c in code[at[:-1]]], "first_id": fid[at[:-1]], "last_id": lid[end[:-1]],
                    "first_time": ft[at[:-1]], "last_time": lt[end[:-1]], "n": total[:-1],
                }
            )
            i, whole = at[-1], len(at) == 1 and (fresh or self.state[8])
            self.state = (e[i], names[i], code[i], fid[i], ft[i], lid[-1], lt[-1], int(total[-1]), whole)
            return out

        def finish(self):
            if (s := self.state) is None:
                return None
            return pd.DataFrame({"entity": [s[0]], "category": [vocabulary.entries[s[2]]], "first_id": [s[3]], "last_id": [s[5]], "first_time": [s[4]], "last_time": [s[6]], "n": [s[7]]})

        @classmethod
        def combine(cls, before, after):
            if after is None or before is None:
                return after or before
            if not after[8] or after[0] != before[0] or after[2] != before[2] or after[4] - before[6] > max_gap:
                return after
            return (*before[:5], after[5], after[6], before[7] + after[7], before[8])

    return Runs


def collapse_runs(df: DataFrame, *, entity: str, time: str, key: str, label: str, entries: Sequence[str], max_edits: int = 2, max_gap: float = 1.5) -> DataFrame:
    """Collapses each run of consecutive events with the same or nearly the same label into one event.

    Two labels are nearly the same if both name the same entry of ``entries`` (see :class:`Vocabulary`); this relation is
    transitive, so runs may be merged block by block and the blocks' edges joined afterwards. Events whose label names no
    entry are passed over. ``entries`` is a fixed list of names, held by every task.

    Result: ``entity``, ``category`` (the entry), ``first_id``, ``last_id``, ``first_time``, ``last_time``, ``n`` (events)
    and ``duration_sec``; a single event is a run of one.

    Defined cases: a null entity, id or label and a null or not finite time take no part; the same id twice counts once;
    equal times go by id; an empty table gives an empty result; extra columns are not read.

    Plan: one range shuffle by (entity, time, id), so that a hot entity spreads over partitions; each partition merges its
    own runs with a heap over a linked list and holds back only the run open at its end.
    """
    t = F.col(time).cast("double")
    rows = df.select(F.col(entity).alias("__e"), t.alias("__t"), F.col(key).alias("__k"), F.col(label).alias("__l"))
    rows = rows.where(~F.isnan("__t") & (F.abs("__t") < float("inf"))).dropna()
    kinds = dict(rows.dtypes)
    schema = f"entity {kinds['__e']}, category string, first_id {kinds['__k']}, last_id {kinds['__k']}, first_time double, last_time double, n bigint"
    found = scan(range_sorted(rows, ["__e", "__t", "__k"]), _scanner("__e", "__t", "__k", "__l", entries, max_edits, max_gap), schema)
    return found.withColumn("duration_sec", F.col("last_time") - F.col("first_time"))
