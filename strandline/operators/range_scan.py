"""Ordered scans over globally range-sorted data.

A window function over a key puts all rows of that key into one task. The scans here don't: rows are range-partitioned
by key *and* order, so that a hot key spreads over as many partitions as its rows need. Each partition is scanned once
to give a summary of fixed size, the summaries are combined from left to right (one per partition, so their number is
bounded by the number of partitions), and a second scan starts from the state carried in.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import cut_sorted

PART = "__part"


class Scanner:
    """One pass over sorted rows. ``state`` must be picklable and of bounded size."""

    def __init__(self, state=None):
        self.state = state

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Takes the next sorted rows, returns what is complete by now."""
        raise NotImplementedError

    def finish(self) -> pd.DataFrame | None:
        """What is still open after the last row of all."""
        return None

    @classmethod
    def combine(cls, before, after):
        """The state after a partition, from the state before it and the partition's own state scanned from nothing."""
        raise NotImplementedError


def range_sorted(df: DataFrame, by: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """Range-partitioned by ``by``, sorted by ``by`` and ``then``, cut from its lineage, numbered in ``__part``."""
    ordered = df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by, *then)
    return cut_sorted(ordered.withColumn(PART, F.spark_partition_id()))


def scan(ordered: DataFrame, scanner: Callable[..., Scanner], schema: str) -> DataFrame:
    """Runs ``scanner`` over the output of :func:`range_sorted` as if it were one long sorted list.

    Only one summary per partition reaches the driver. An empty input gives an empty result.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, s = None, scanner()
        for rows in batches:
            if len(rows):
                part = int(rows[PART].iat[0])
                s.feed(rows)
        if part is not None:
            yield pd.DataFrame({"part": [part], "state": [pickle.dumps(s.state)]})

    found = ordered.mapInPandas(summarise, "part int, state binary").collect()
    own = {r["part"]: pickle.loads(bytes(r["state"])) for r in found}
    carried, state = {}, None
    for part in sorted(own):
        carried[part] = state
        state = own[part] if state is None else scanner.combine(state, own[part])
    last = max(own, default=None)

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, s = None, None
        for rows in batches:
            if not len(rows):
                continue
            if s is None:
                part = int(rows[PART].iat[0])
                s = scanner(carried[part])
            if (out := s.feed(rows)) is not None and len(out):
                yield out
        if s is not None and part == last and (out := s.finish()) is not None and len(out):
            yield out

    return ordered.mapInPandas(rescan, schema)
