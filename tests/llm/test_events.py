import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import nearest as N
from strandline.llm.runs import Vocabulary, agglomerate, collapse_runs, edits
from strandline.llm.text import folded, letters, words

NAMES = ["wide_master", "title_card", "walk_and_talk"]


def brute_nearest(left, right, tol):
    out = {}
    for lid, e, t in left:
        if e is None or t is None or t != t or abs(t) == float("inf"):
            continue
        c = [(abs(rt - t), rt, rid) for rid, re, rt in right if re == e and rt is not None and rt == rt and abs(rt) != float("inf") and abs(rt - t) <= tol]
        if c:
            out[lid] = min(c)[2]
    return out


@pytest.mark.parametrize("cell", [5, 100_000])
def test_nearest_with_hot_entity_and_copies(spark, cell):
    r = random.Random(cell)
    times = lambda n: [r.choice([round(r.uniform(0, 40), 2), 7.0, r.choice([None, float("nan"), float("inf"), 5.5])]) for _ in range(n)]
    left = [(i, r.choice([1, 1, 1, 2, None]), t) for i, t in enumerate(times(400))]
    right = [(i, r.choice([1, 1, 1, 2, None]), t) for i, t in enumerate(times(300))]
    left, right = left + left[:30], right + right[:30]
    a = spark.createDataFrame(left, "lid bigint, src bigint, t double").withColumn("d", F.lit("clash")).withColumn("__g", F.lit(1))
    b = spark.createDataFrame(right, "rid bigint, src bigint, u double").withColumn("d", F.lit("clash"))
    got = N.nearest_in_time(a, b, entity="src", left_id="lid", left_time="t", right_id="rid", right_time="u", tolerance=0.25, width=10.0, rows_per_cell=cell).collect()
    assert {x[0]: x[1] for x in got} == brute_nearest(left, right, 0.25)
    assert len(got) == len({x[0] for x in got})


def test_a_burst_is_cut_where_its_records_are(spark):
    # nearly all right records within a hundredth of a second, left ones too; some far off
    r = random.Random(4)
    right = [(i, 1, 100 + r.random() / 100) for i in range(600)] + [(1000 + i, 1, 50.0 + i) for i in range(5)]
    left = [(i, 1, 100 + r.random() / 100) for i in range(500)] + [(900, 1, 99.9), (901, 1, 100.2), (902, 1, 52.1), (903, 1, 300.0)]
    a, b = spark.createDataFrame(left, "lid bigint, src bigint, t double"), spark.createDataFrame(right, "rid bigint, src bigint, u double")
    got = N.nearest_in_time(a, b, entity="src", left_id="lid", left_time="t", right_id="rid", right_time="u", tolerance=0.25, rows_per_cell=40).collect()
    assert {x[0]: x[1] for x in got} == brute_nearest(left, right, 0.25) and len(got) == 503


def test_nearest_empty(spark):
    a = spark.createDataFrame([], "lid bigint, src bigint, t double")
    b = spark.createDataFrame([(1, 1, 1.0)], "rid bigint, src bigint, u double")
    assert N.nearest_in_time(a, b, entity="src", left_id="lid", left_time="t", right_id="rid", right_time="u", tolerance=0.25).collect() == []


def test_edits_and_spellings():
    assert [edits(a, b) for a, b in (("", "abc"), ("kitten", "sitting"), ("flaw", "lawn"), ("abc", "abc"))] == [3, 3, 2, 0]
    v = Vocabulary(NAMES)
    spelt = ["Wide  Master", "ｗｉｄｅ　ｍаｓｔｅｒ", "[TITLE-CAR]", "walk/and/tolkk", "wälkAndTalk", "tit", "-", "", "wi​de master"]
    assert [NAMES and (v.entries[c] if c >= 0 else None) for c in v.codes(spelt)] == [
        "wide_master", "wide_master", "title_card", "walk_and_talk", "walk_and_talk", None, None, None, "wide_master",
    ]


def test_entries_that_differ_in_signs_or_script_are_told_apart():
    names = ["take 1", "take 2", "broad", "bread", "сцена", "シーン", "12", "42"]
    v = Vocabulary(names)
    spelt = ["Take-1", "TAKE_2", "tak 2", "take", "brod", "СЦЕНА", "сцен", "シーン", "12", "4 2", "77", "walk"]
    got = [v.entries[c] if c >= 0 else None for c in v.codes(spelt)]
    # what is equally near to two is named by its signs, then by the alphabet; nothing near is lost
    assert got == ["take 1", "take 2", "take 2", "take 1", "broad", "сцена", "сцена", "シーン", "12", "42", None, None]


def test_an_ambiguous_spelling_stays_in_its_run(spark):
    rows = [(i, 1, i * 1.0, c) for i, c in enumerate(["take 1", "take", "take1", "take 2", "take 2"])]
    df = spark.createDataFrame(rows, "id bigint, src bigint, t double, cat string")
    got = collapse_runs(df, entity="src", time="t", key="id", label="cat", entries=["take 1", "take 2"]).collect()
    assert sorted((x.first_id, x.last_id, x.n, x.category) for x in got) == [(0, 2, 3, "take 1"), (3, 4, 2, "take 2")]


def test_folding():
    assert folded("ĐẾM Gemäß ＡＢ") == folded("đem gemass ab")
    assert words("Pro­jector, GRI-\nEBOFEN <em>x</em> **y** a_b​c") == ["projector", "griebofen", "x", "y", "a", "bc"]
    assert words(None) == words("") == []
    assert letters("a1-B é") == "abe"


def test_agglomeration_takes_the_most_similar_pair_first():
    import numpy as np

    like = {frozenset("ab"): 0.6, frozenset("bc"): 0.9}
    sim = lambda x, y: 1.0 if x == y else like.get(frozenset(x + y), 0.0)
    # b goes to c first; the merged run goes by c, which isn't like a
    assert agglomerate(["a", "b", "c"], [5, 1, 3], np.array([True, True, False]), sim, 0.5).tolist() == [True, True, False]
    assert agglomerate(["a", "b"], [1, 1], np.array([False, False]), sim, 0.5).tolist() == [True, True]


@pytest.mark.parametrize("seed", range(3))
def test_runs_across_partitions(spark, seed):
    r = random.Random(seed)
    spelt = ["wide_master", "Wide Mastr", "title card", "TITLE_CARD", "nothing", None, "walk_and_talk"]
    rows, t = [], 0.0
    for i in range(600):
        t += r.choice([0.2, 0.4, 1.5, 1.7])
        src = r.choice([1, 1, 1, 2, None])
        rows.append((i, src, r.choice([round(t, 3)] * 9 + [None, float("nan")]), spelt[(i // 7) % 7] if r.random() < 0.8 else r.choice(spelt)))
    rows += rows[100:140]
    df = spark.createDataFrame(rows, "id bigint, src bigint, t double, cat string").withColumn("entity", F.lit(3))
    got = {tuple(x)[:7] for x in collapse_runs(df, entity="src", time="t", key="id", label="cat", entries=NAMES).collect()}
    v, runs = Vocabulary(NAMES), []
    good = sorted({(s, t, i, int(v.codes([c])[0])) for i, s, t, c in rows if s is not None and t is not None and t == t and c is not None and v.codes([c])[0] >= 0})
    for s, t, i, c in good:
        if runs and runs[-1][0] == s and runs[-1][1] == c and t - runs[-1][5] <= 1.5:
            runs[-1][3], runs[-1][5], runs[-1][6] = i, t, runs[-1][6] + 1
        else:
            runs.append([s, c, i, i, t, t, 1])
    assert got == {(s, v.entries[c], a, b, x, y, n) for s, c, a, b, x, y, n in runs}


def test_one_run_over_all_partitions_and_empty(spark):
    rows = [(i, 1, i * 0.5, "wide_master" if i % 3 else "Wide Masterr") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, src bigint, t double, cat string")
    got = collapse_runs(df, entity="src", time="t", key="id", label="cat", entries=NAMES).collect()
    assert [(x.first_id, x.last_id, x.n, x.duration_sec) for x in got] == [(0, 399, 400, 199.5)]
    assert collapse_runs(df.limit(0), entity="src", time="t", key="id", label="cat", entries=NAMES).collect() == []
