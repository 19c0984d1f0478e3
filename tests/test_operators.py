import itertools
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import evidence as E
from strandline.functions import maths as M
from strandline.functions import text as X
from strandline.operators import graph
from strandline.operators import interval_algebra as A
from strandline.operators import ordered as O
from strandline.operators import relational as R
from strandline.operators.islands import islands
from strandline.operators.series import as_of, boundary_safety
from strandline.sources import files


@pytest.mark.parametrize(("seed", "gap"), [(0, 3), (1, None), (2, 1)])
def test_islands_across_partitions(spark, seed, gap):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(500):
        t += r.choice([0, 1, 2, 4])
        rows.append((r.choice([1, 1, 1, 2, None]), t, i, "ab"[(i // 9) % 2] if r.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "g bigint, t bigint, k bigint, l string").withColumn("series", F.lit(0))
    got = sorted(tuple(x) for x in islands(df, series="g", time="t", key="k", label="l", gap=gap).collect())
    want = []
    for g, t, k, l in sorted(x for x in rows if None not in x):
        w = want[-1] if want else None
        if w and w[0] == g and w[1] == l and (gap is None or t - w[3] <= gap):
            w[3], w[4] = t, w[4] + 1
        else:
            want.append([g, l, t, t, 1, k])
    assert got == sorted(tuple(w) for w in want)
    assert islands(df.limit(0), series="g", time="t", key="k", label="l").collect() == []


@pytest.mark.parametrize("pad", [0, 7])
def test_overlap_join(spark, pad):
    r = random.Random(pad)
    make = lambda n: [(i, r.choice([1, 1, 2]), s, s + r.choice([-1, 0, 1, 5, 60])) for i in range(n) for s in [r.randrange(300)]]
    a, b = make(120), make(90)
    da, db = (spark.createDataFrame(x, "id bigint, k bigint, s bigint, e bigint") for x in (a, b))
    want = {(i, j) for (i, k, s, e), (j, k2, s2, e2) in itertools.product(a, b) if k == k2 and e + pad > s - pad and e2 > s2 and s - pad < e2 and s2 < e + pad}
    got = [(x.id, x.other) for x in A.overlap_join(da, db, "k", width=20, pad=pad).collect()]
    assert set(got) == want and len(got) == len(want)
    left = {x.id for x in A.without_overlap(da, db, "k", width=20, pad=pad).collect()}
    assert left == {x[0] for x in a} - {i for i, _ in want}


def test_interval_difference(spark):
    iv = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 8, 9), (2, 0, 10)], "k bigint, s bigint, e bigint")
    ranges = spark.createDataFrame([(1, 0, 12), (2, 2, 9), (3, 5, 6)], "k bigint, lo bigint, hi bigint")
    assert {tuple(x) for x in A.difference(iv, ranges, "k").collect()} == {(1, 0, 2), (1, 6, 8), (1, 9, 12), (3, 5, 6)}


def test_as_of(spark):
    l = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (2, 5, 2)], "series bigint, us bigint, key bigint")
    r = spark.createDataFrame([(1, 8, 7), (1, 12, 8), (1, 12, 9), (1, 20, 6)], "series bigint, us bigint, key bigint")
    find = lambda d, t=None: {x.key: x.found_key for x in as_of(l, r, direction=d, tolerance=t).collect()}
    assert find("backward") == {0: 7, 1: 6, 2: None}
    assert find("forward") == {0: 8, 1: 6, 2: None}
    assert find("nearest") == {0: 7, 1: 6, 2: None}
    assert find("nearest", 1) == {0: None, 1: 6, 2: None}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.expand_ranges(F.lit("1, 3-5"))) == [1, 3, 4, 5]
    assert [one(X.expand_ranges(F.lit(t))) for t in ("3,1", "2,2", "a", "", "5-3")] == [None] * 5
    assert one(X.file_stem(F.lit("C:\\a\\b.c.wav"))) == "b.c" and one(X.file_stem(F.lit("/x/y"))) == "y"
    assert one(X.collapse_repeats(F.lit("aaabb!!"))) == "ab!"
    assert one(X.is_junk(F.lit("ahahahah" * 4))) is True and one(X.is_junk(F.lit("ah"))) is False


def test_maths_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(M.ticks_to_seconds(F.lit("254016000000"))) == 1.0 and one(M.ticks_to_seconds(F.lit("x"))) is None
    assert one(M.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(M.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(M.is_number(F.lit(float("nan")))) is False
    assert [one(M.bit_reversed(F.lit(i), 3)) for i in range(8)] == [0, 4, 2, 6, 1, 5, 3, 7]


def test_relational(spark):
    pairs = spark.createDataFrame([("w", "i", "r1"), ("w", "i", "r2"), ("w", "j", "r1"), ("v", "j", "r1")], "word string, item string, reading string")
    need = spark.createDataFrame([("w", "r1"), ("w", "r2"), ("v", "r1")], "word string, reading string")
    assert {tuple(x) for x in R.divide(pairs, need, keep=["word", "item"], by="reading").collect()} == {("w", "i"), ("v", "j")}
    a = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k bigint, v bigint")
    b = spark.createDataFrame([(1, None), (2, 6), (4, 1)], "k bigint, v bigint")
    assert {tuple(x) for x in R.differences(a, b, "k", ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    got = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "k bigint, v double").groupBy("k").agg(R.strict_sum(F.col("v")).alias("s"))
    assert {tuple(x) for x in got.collect()} == {(1, None), (2, 2.0)}


def test_complete_link_against_plain_python(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((40, 4))
    rows = [(1, i, [float(x) for x in v[i]], i % 7) for i in range(40)]
    got = {x.k: x.group_id for x in O.complete_link(spark.createDataFrame(rows, "b bigint, k bigint, v array<double>, a bigint"), block="b", key="k", vector="v", limit=0.4, apart="a").collect()}
    groups = {}
    for k, g in got.items():
        groups.setdefault(g, []).append(k)
    cos = lambda i, j: 1 - float(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]))
    for g, m in groups.items():
        assert g == min(m) and all(cos(i, j) <= 0.4 + 1e-9 and i % 7 != j % 7 for i, j in itertools.combinations(m, 2))
    for m, n in itertools.combinations(groups.values(), 2):
        assert any(cos(i, j) > 0.4 - 1e-9 or i % 7 == j % 7 for i in m for j in n)


def test_choose_finds_an_assignment_where_greedy_fails():
    # the long demand would take the only place of the short one
    needs, options = [(1, 10), (2, 4)], [(7, 0, 10, 5.0), (8, 50, 60, 1.0), (9, 3, 8, 4.0)]
    got, how = O.choose(needs, options, 0)
    assert how == "greedy"
    assert set(got) == {1, 2}
    assert O.choose([(1, 10), (2, 10)], [(7, 0, 10, 1.0)], 0) == ({1: 7}, "none")
    assert O.choose([(1, 10), (2, 10)], [(7, 0, 10, 1.0)], 0, depth=1) == ({1: 7}, "unknown")
    r = random.Random(2)
    for _ in range(60):
        needs = [(i, r.randint(1, 6)) for i in range(4)]
        options = [(i, s, s + r.randint(1, 8), r.random()) for i, s in enumerate(r.sample(range(30), 6))]
        gap, got = r.choice([0, 2]), None
        got, _ = O.choose(needs, options, gap)
        by = {o[0]: o for o in options}
        spans = sorted((by[c][1], by[c][1] + dict(needs)[n]) for n, c in got.items())
        assert all(by[c][2] - by[c][1] >= dict(needs)[n] for n, c in got.items())
        assert all(a[1] + gap <= b[0] for a, b in zip(spans, spans[1:]))
        best = any(
            all(o[2] - o[1] >= n[1] for n, o in zip(needs, p)) and all(a[1] + gap <= b[0] for a, b in itertools.pairwise(sorted((o[1], o[1] + n[1]) for n, o in zip(needs, p))))
            for p in itertools.permutations(options, 4)
        )
        assert (len(got) == 4) == best


def test_plan_and_catalog(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"version": 1, "slots": [{"id": "a", "in_sec": 1.5}, {"id": "b"}]}')
    plan = files.read_plan(spark, str(tmp_path / "plan.json"))
    assert [x.id for x in files.plan_slots(plan).collect()] == ["a"]
    (tmp_path / "old.json").write_text('{"version": 2}')
    with pytest.raises(Exception, match="plan of version 2"):
        files.read_plan(spark, str(tmp_path / "old.json")).collect()
    files.write_catalog(spark.createDataFrame([(1, ["a", "b"])], "id int, w array<string>"), str(tmp_path / "cat"))
    assert spark.read.csv(str(tmp_path / "cat"), header=True).first().w == "a | b"
    with pytest.raises(Exception, match="isn't finite"):
        files.write_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "bad"))


def test_recordings(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 1000, 0, "NONE", ""))
        x = [0] * 500 + [int(16000 * math.sin(i)) for i in range(500)]
        w.writeframes(struct.pack("<1000h", *x))
    (tmp_path / "b.WAV").write_bytes(b"nothing")
    got = {x.path.rsplit("/", 1)[1]: x for x in files.recordings(spark, str(tmp_path)).collect()}
    assert got["a.wav"].duration_sec == 1.0 and got["a.wav"].active_start == 0.5 and got["a.wav"].active_end == 1.0 and len(got["a.wav"].envelope) == 50
    assert got["b.WAV"].duration_sec is None
    assert files.list_files(spark, str(tmp_path), "*.wav").count() == 1


@pytest.mark.parametrize(("events", "safe"), [([1.2], False), ([2.7], False), ([4.4], True), ([3.8, 4.5], False), ([0.1], False), ([4.95], False), ([], True)])
def test_boundary_rules(spark, events, safe):
    us = lambda t: int(t * 1_000_000)
    spans = spark.createDataFrame([(1, 7, 0, us(5))], "series bigint, key bigint, s bigint, e bigint")
    at = spark.createDataFrame([(1, us(t)) for t in events], "series bigint, us bigint")
    got = boundary_safety(spans, at, margin=us(0.12), head=us(3), slack=us(2), width=us(2)).first()
    assert got.safe is safe


def test_folds(spark):
    iv = spark.createDataFrame([(1, 1, 0, 10, 5), (1, 2, 8, 12, 9), (1, 3, 13, 15, 1), (1, 4, 20, 22, 1)], "g bigint, k bigint, s bigint, e bigint, score bigint")
    assert {x.k for x in O.separated(iv, group="g", key="k", gap=2).collect()} == {2, 4}
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.01]), (1, 3, [0.0, 1.0]), (1, 4, [-1.0, 0.0])], "g bigint, k bigint, v array<double>")
    assert {x.k for x in O.gallery(v, group="g", key="k", vector="v", novelty=0.1, size=2).collect()} == {1, 3}
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "k bigint")
    alike = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "block bigint, a bigint, b bigint")
    # 2 goes with 1; 3 is alike only the rejected 2 and stays; 4 goes with 3
    assert {x.k for x in O.first_wins(df, alike, key="k").collect()} == {1, 3, 5}
    with pytest.raises(Exception, match="2 are the most"):
        O.separated(iv, group="g", key="k", gap=2, most=2).collect()


def test_fingerprints(spark):
    one = lambda a, b: spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(E.fingerprint_alike(F.col("a"), F.col("b"), 1, 2).alias("x")).first().x
    assert one([0, 255, 1 << 40], [1, 254, 77777]) is True
    assert one([0, 255], [1, 77777]) is False and one([], [1]) is False


def test_nested_placements(spark):
    edges = [(0, 1, 10, 30, 5), (1, 2, 0, 100, 0), (1, 2, 8, 12, 0), (2, 3, 6, 9, 0)]
    e = spark.createDataFrame(edges, "parent bigint, child bigint, start bigint, end bigint, source_in bigint")
    roots = spark.createDataFrame([(0,)], "node bigint")
    got = sorted((x.node, x.s, x.e, x.depth) for x in graph.flatten(e, roots).collect())
    # node 1 lies at 10..30 and begins at its own 5, so its time is moved by 5
    assert got == [(1, 10, 30, 1), (2, 10, 30, 2), (2, 13, 17, 2), (3, 11, 14, 3)]
    assert {x.node for x in graph.unreferenced(spark.createDataFrame([(0,), (1,), (9,)], "node bigint"), e).collect()} == {0, 9}
    loop = spark.createDataFrame([(0, 1, 0, 9, 0), (1, 2, 0, 9, 0), (2, 1, 0, 9, 0)], e.schema)
    with pytest.raises(Exception, match="a cycle at 1"):
        graph.flatten(loop, roots).collect()


def test_cache_digest_and_xml(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert files.read_cache(spark, at, "k string, v int").count() == 0
    df = spark.createDataFrame([(1, "x")], "b int, a string").withColumn("k", files.digest("b", "a"))
    assert df.first().k == df.withColumn("k", files.digest("a", "b")).first().k
    files.add_to_cache(df.select("k", F.col("b").alias("v")), at)
    assert files.read_cache(spark, at, "k string, v int").count() == 1
    (tmp_path / "p.xml").write_text("<r><Item id='1'><Name>n</Name></Item><Item id='2'/></r>")
    assert {tuple(x) for x in files.objects(spark, str(tmp_path / "p.xml"), "Item", "_id int, Name string").collect()} == {(1, "n"), (2, None)}


def kept_in_order(rows, limit):
    kept = {}
    for g, k, x, y, w, h, _ in sorted((r for r in rows), key=lambda r: (r[0] or 0, -r[6], r[1])):
        for x2, y2, w2, h2, _ in kept.setdefault(g, []):
            n = max(0, min(x + w, x2 + w2) - max(x, x2)) * max(0, min(y + h, y2 + h2) - max(y, y2))
            if n / max(1, w * h + w2 * h2 - n) >= limit:
                break
        else:
            kept[g].append((x, y, w, h, k))
    return sorted(((g, k) for g, boxes in kept.items() for *_, k in boxes), key=str)


@pytest.mark.parametrize(("seed", "span", "block"), [(0, 40, 512), (1, 300, 7), (2, 8, 1)])
def test_suppress(spark, seed, span, block):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3, None]), k, r.randrange(span), r.randrange(span), r.randrange(12), r.randrange(12), r.randrange(20)) for k in range(700)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, x bigint, y bigint, w int, h int, score int").repartition(3)
    got = O.suppress(df, group="g", key="k", limit=0.3, block_rows=block).collect()
    assert sorted((tuple(x) for x in got), key=str) == kept_in_order(rows, 0.3)
    assert O.suppress(df.limit(0), group="g", key="k").collect() == []


def test_suppress_takes_a_frame_of_any_size(spark):
    df = spark.range(60_000).selectExpr("id % 2 as g", "id as k", "(id * 7) % 90 as x", "(id * 13) % 80 as y", "20 + id % 51 as w", "15 + id % 23 as h", "(id * 31) % 101 as score")
    got = O.suppress(df, group="g", key="k", limit=0.3).collect()
    assert sorted(map(tuple, got), key=str) == kept_in_order([tuple(x) for x in df.collect()], 0.3)
