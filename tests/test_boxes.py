import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import maths as M
from strandline.operators.boxes import _held, overlapping, sole_owner


@pytest.mark.parametrize(("seed", "span", "copies"), [(0, 6, 1), (1, 30, 1), (2, 12, 3), (3, 200, 2)])
def test_sole_owner(spark, seed, span, copies):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 2, None]), r.randrange(400 // copies), r.randrange(span), r.randrange(span), r.choice([0, 1, 2, 5, span, None]), r.randrange(1, span)) for _ in range(400)]
    if copies == 1:
        rows = [(g, i, *x) for i, (g, _, *x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, x bigint, y bigint, w int, h int")
    found = {}
    for g, k, x, y, w, h in rows:
        for g2, k2, x2, y2, w2, h2 in rows:
            if g is not None and g == g2 and k != k2 and w is not None and w2 is not None and x >= x2 and y >= y2 and x + w <= x2 + w2 and y + h <= y2 + h2:
                found.setdefault((g, k), []).append(k2)
    want = sorted((k, v[0]) for (_, k), v in found.items() if len(v) == 1)
    for piece in (16_384, 50):
        assert sorted(tuple(x) for x in sole_owner(df, group="g", key="k", piece_rows=piece).collect()) == want
    assert sole_owner(df.limit(0), group="g", key="k").collect() == []


def test_most_boxes_are_left_out_early():
    # nested boxes: each is held by all before it
    n = 200_000
    boxes = np.column_stack([np.arange(n), np.arange(n), 2 * n - np.arange(n), 2 * n - np.arange(n)]).astype("float64")
    kept, held = _held(boxes, np.ones(n), 2)
    assert sorted(kept) == [0, 1, 2] and sorted(held) == [0, 1, 2]


@pytest.mark.parametrize(("seed", "span", "copies"), [(0, 6, 1), (1, 30, 1), (2, 4, 3)])
def test_overlapping(spark, seed, span, copies):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 2, None]), i // copies, r.randrange(span), r.randrange(span), r.choice([1, 2, 5, span, None]), r.randrange(1, span)) for i in range(300)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, x bigint, y bigint, w int, h int")
    a, b = df, df.toDF("g", "k2", "x2", "y2", "w2", "h2")
    # all pairs of a group, as rows
    pairs = a.join(b, "g").where("k < k2").withColumn("iou", M.iou(*map(F.col, ("x", "y", "w", "h", "x2", "y2", "w2", "h2")))).where("iou >= 0.45")
    want = sorted((p.k, p.k2, p.iou) for p in pairs.collect())
    for block in (512, 7):
        assert sorted(tuple(x) for x in overlapping(df, group="g", key="k", measure=M.iou, least=0.45, block_rows=block).collect()) == want
    assert want and overlapping(df.limit(0), group="g", key="k", measure=M.iou, least=0.45).collect() == []


def test_equal_boxes_are_compared_once(spark):
    df = spark.range(3000).selectExpr("0 as g", "id as k", "(id % 3) * 1000 as x", "0 as y", "10 as w", "10 as h")
    seen = spark.sparkContext.accumulator(0)
    compared = F.udf(lambda same: seen.add(1) or (1.0 if same else 0.0), "double")
    found = overlapping(df, group="g", key="k", measure=lambda x, y, w, h, x2, y2, w2, h2: compared(x == x2), least=0.45)
    assert found.count() == 3 * 1000 * 999 // 2 and seen.value <= 12
