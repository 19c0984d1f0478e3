"""Models and other processes behind a boundary: rows go in batches to something that is loaded once per worker (UD1-UD12)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: One per worker process and name: a model is kept from task to task (UD11).
_LOADED: dict[str, Callable] = {}


def _model(name: str, load: Callable[[], Callable], fallback: Callable[[], Callable] | None):
    if name not in _LOADED:
        try:
            _LOADED[name] = load()
        except Exception:
            if fallback is None:
                raise
            _LOADED[name] = fallback()
    return _LOADED[name]


def _answers(model: Callable, rows: pd.DataFrame, start: int, end: int, columns: list[str], check: Callable[[pd.DataFrame], bool] | None) -> Iterable[tuple[int, int, pd.DataFrame | None, str | None]]:
    """Parts of ``rows`` with their answer, or with None and why a single row has none. What fails is halved and tried again (UD5, UD10)."""
    why = None
    try:
        out = model(rows.iloc[start:end])
        if len(out) != end - start or any(c not in out for c in columns):
            why = "answer of another shape"
        elif check is not None and not check(out):
            why = "answer that isn't valid"
    except MemoryError:
        why = "no room"
    except ValueError as e:
        why = str(e)
    if why is None:
        yield start, end, out, None
    elif end - start == 1:
        yield start, end, None, why
    else:
        half = start + (end - start) // 2
        yield from _answers(model, rows, start, half, columns, check)
        yield from _answers(model, rows, half, end, columns, check)


def _joined(parts: list[tuple[int, int, pd.DataFrame | None, str | None]], column: str, n: int):
    """A column of all parts; null where a row has no answer."""
    if all(out is not None for *_, out, _ in parts):
        return np.concatenate([out[column].to_numpy() for *_, out, _ in parts])
    values = np.full(n, None, object)
    for start, end, out, _ in parts:
        if out is not None:
            values[start:end] = out[column].to_numpy()
    return values


def observed(
    df: DataFrame, *, key: str, inputs: list[str], name: str, load: Callable[[], Callable], schema: str, batch: int = 64, fallback: Callable[[], Callable] | None = None, check: Callable | None = None
) -> DataFrame:
    """What a model says of each row: ``key``, the columns of ``schema``, and ``problem`` (null where it answered).

    ``load`` gives a function from a frame of ``inputs`` to a frame of the columns of ``schema``, row by row; it is called once
    per worker, ``fallback`` where it fails. A batch that fails (no memory, wrong shape, not valid by ``check``, ValueError)
    is halved until single rows fail; these come out with nulls and the reason, so no row is lost and none stops the job.

    Plan: the key and the inputs are dealt out evenly over tasks, as a model's work isn't seen in the size of its table, and
    reach Python in Arrow batches.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]
    kind = dict(df.dtypes)[key]

    def run(batches):
        model = _model(name, load, fallback)
        for rows in batches:
            given, n = rows[inputs], len(rows)
            parts = [x for i in range(0, n, batch) for x in _answers(model, given, i, min(i + batch, n), columns, check)]
            if parts:
                problem = np.full(n, None, object)
                for start, end, _, why in parts:
                    problem[start:end] = why
                frame = pd.concat([rows[[key]].reset_index(drop=True), *[pd.Series(_joined(parts, c, n)) for c in columns], pd.Series(problem)], axis=1)
                frame.columns = [key, *columns, "problem"]
                yield frame

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.select(key, *[c for c in inputs if c != key]).repartition(tasks).mapInPandas(run, f"{key} {kind}, {schema}, problem string")


def observed_within(df: DataFrame, chosen: DataFrame, *, on: list[str], **how) -> DataFrame:
    """Only the rows that a choice needs go to the model (UD12)."""
    return observed(df.join(chosen.select(*on).distinct(), on, "left_semi"), **how)
