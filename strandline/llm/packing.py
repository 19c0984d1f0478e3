"""Problem 6: items of varying length into containers of fixed capacity."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import TOKENIZER, tokenizer
from strandline.storage import cut_lineage

#: Distinct lengths, and so rows of the histogram and containers' patterns, are bounded by the capacity.
MAX_CAPACITY = 1_000_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Shortest-pack-first: (number of containers, ((length, how many), ...)) for all items of a histogram of lengths.

    Lengths are placed longest first, each into the packs with the most room; whole groups of equal packs are filled at
    once, so the work depends on the number of distinct lengths, not of items. Of a group with room for several items of
    one length each pack takes one before any takes another.
    """
    groups: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(room: int, pattern: tuple, packs: int) -> None:
        if room not in groups or not groups[room]:
            heapq.heappush(rooms, -room)
        groups[room][pattern] += packs

    def add(pattern: tuple, length: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + 1))
        return (*pattern, (length, 1))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            while rooms and not groups[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                # a new pack has the most room until it has none for this length: it takes as many as it holds
                each = min(left, capacity // length)
                put(capacity - each * length, ((length, each),), left // each)
                left %= each
                continue
            room = -rooms[0]
            pattern, packs = min(groups[room].items())
            take = min(packs, left)
            del groups[room][pattern]
            if packs > take:
                groups[room][pattern] = packs - take
            if not groups[room]:
                heapq.heappop(rooms)
            put(room - length, add(pattern, length), take)
            left -= take
    return [(n, p) for room in sorted(groups) for p, n in sorted(groups[room].items()) if n]


def _slots(packs: list[tuple[int, tuple]]) -> list[tuple]:
    """Per pattern and length: which ranks of that length go to which containers, and where they begin in them."""
    given: Counter = Counter()
    base, rows = 0, []
    for n, pattern in packs:
        offset = 0
        for length, times in pattern:
            rows.append((length, given[length], given[length] + n * times, base, times, offset))
            given[length] += n * times
            offset += length * times
        base += n
    return rows


def _by_length(slots: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = defaultdict(list)
    for length, *rest in slots:
        out[length].append(tuple(rest))
    return out


def pack_documents(docs: DataFrame, *, doc_id: str, text: str, capacity: int = 2048, path: str = TOKENIZER) -> DataFrame:
    """Puts all texts into containers of ``capacity`` tokens; only a text above the capacity is divided.

    Result: ``doc_id``, ``piece`` (0, 1, ...), ``start_token`` (in the text), ``n_tokens``, ``container_id``,
    ``container_offset``. A text above the capacity gives full pieces and a rest.

    Defined cases: a null id or text is no item; an empty text has no token and stands in container 0 at offset 0;
    repeated rows are items of their own; an empty table gives an empty result; other columns are not read.

    Plan: texts are tokenized once, where they are read; from then on only (id, piece, length) move. The histogram has at
    most ``capacity`` rows. The rank of an item among those of its length is the number of such items in earlier
    partitions plus its place in its own: counts per (length, partition) are summed up, so a length that a third of all
    items share is ranked in parallel. The patterns (at most the distinct lengths times the capacity, in practice a few for
    each length) are broadcast as sorted arrays, and an item finds its own by binary search on its rank.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be in 1..{MAX_CAPACITY}")
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()

    def measure(batches):
        count = tokenizer(path).count
        for rows in batches:
            n = np.array([count(t) for t in rows["t"]], "int64")
            pieces = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            yield pd.DataFrame({"d": rows["d"].to_numpy()[at], "piece": piece, "start_token": start, "n_tokens": np.minimum(capacity, n[at] - start)})

    given = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).dropna()
    items = given.mapInPandas(measure, f"d {kind}, piece bigint, start_token bigint, n_tokens bigint")
    items = cut_lineage(items.withColumn("part", F.spark_partition_id()))
    counts = cut_lineage(items.where("n_tokens > 0").groupBy("n_tokens", "part").agg(F.count("*").alias("n")))
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(pack_histogram(histogram, capacity))

    earlier = F.sum("n").over(_order("n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("n_tokens", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = (
        items.where("n_tokens > 0")
        .withColumn("own", F.row_number().over(_order(["n_tokens", "part"], "d", "piece")) - 1)
        .join(before, ["n_tokens", "part"])
        .withColumn("rank", F.col("before") + F.col("own"))
    )
    # patterns of containers, by the first rank of a length that they take: a few for each length, found by binary search
    table = spark.sparkContext.broadcast({length: np.array(sorted(rows), "int64") for length, rows in _by_length(slots).items()})

    def place(batches):
        for rows in batches:
            n, rank = rows["n_tokens"].to_numpy(), rows["rank"].to_numpy()
            box, offset = np.zeros(len(n), "int64"), np.zeros(len(n), "int64")
            order = np.argsort(n, kind="stable")
            cuts = np.flatnonzero(np.append(True, n[order][1:] != n[order][:-1])) if len(n) else np.zeros(0, "int64")
            for at in np.split(order, cuts[1:]) if len(n) else []:
                own = table.value[int(n[at[0]])]
                first, _, base, times, start = own[np.searchsorted(own[:, 0], rank[at], "right") - 1].T
                k = rank[at] - first
                box[at], offset[at] = base + k // times, start + k % times * n[at[0]]
            yield pd.DataFrame({"d": rows["d"], "piece": rows["piece"], "start_token": rows["start_token"], "n_tokens": n, "container_id": box, "container_offset": offset})

    out = ranked.select("d", "piece", "start_token", "n_tokens", "rank").mapInPandas(place, f"d {kind}, piece bigint, start_token bigint, n_tokens bigint, container_id bigint, container_offset bigint")
    empty = items.where("n_tokens = 0").select("d", "piece", "start_token", "n_tokens", F.lit(0).cast("bigint").alias("container_id"), F.lit(0).cast("bigint").alias("container_offset"))
    return out.unionByName(empty).withColumnRenamed("d", doc_id)


def _order(by, *then):
    return Window.partitionBy(by).orderBy(*then)
