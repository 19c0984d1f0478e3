import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.llm.clusters import cluster, density_forest
from strandline.llm.hierarchy import Hierarchy, stable_clusters
from strandline.llm.spanning import forest_of, labels_of, spanning_forest
from strandline.llm.vectors import SearchSettings, Tree, _descend, _Search, _Shelf, build_index, chi_square_limit, keyed_vectors, normal, similar_pairs

DIMS = 16
SCHEMA = "id bigint, ks array<bigint>, vs array<array<float>>, rs array<bigint>, ws array<array<float>>"


def kruskal(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for w, u, v in sorted({(w, min(u, v), max(u, v)) for u, v, w in rows if u != v}):
        if find(u) != find(v):
            root[find(u)] = find(v)
            out.add((u, v, w))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("one_task", [0, 50_000])
def test_forest_and_labels(spark, seed, one_task):
    r = random.Random(seed)
    rows = [(a, b, float(r.choice([1, 2, 2, 3, 9]))) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(75))]
    rows += [(200, i, 1.0) for i in range(201, 230)] + [(300 + i, 301 + i, 1.0) for i in range(20)]
    want = kruskal(rows)
    frame = pd.DataFrame([(min(u, v), max(u, v), w) for u, v, w in rows if u != v], columns=["u", "v", "w"]).drop_duplicates()
    assert {tuple(x) for x in frame[forest_of(frame)].itertuples(index=False)} == want
    forest = spanning_forest(spark.createDataFrame(rows, "u bigint, v bigint, w double"), one_task)
    assert {(min(x.u, x.v), max(x.u, x.v), x.w) for x in forest.collect()} == want
    got = {x.node: x.comp for x in labels_of(forest, one_task).collect()}
    comps = {}
    for u, v, _ in want:
        joined = comps.get(u, {u}) | comps.get(v, {v})
        for x in joined:
            comps[x] = joined
    assert got == {x: min(c) for x, c in comps.items()}


def test_chances():
    assert chi_square_limit(4, 0.05) == pytest.approx(9.487729, abs=1e-4) and chi_square_limit(16, 0.01) == pytest.approx(31.9999, abs=1e-3)
    assert normal(np.array([-9.0, -1.96, 0.0, 1.96, 9.0])) == pytest.approx([0, 0.025, 0.5, 0.975, 1], abs=1e-3)
    rng = np.random.default_rng(1)
    y = rng.standard_normal((4000, 4)).astype("float32")
    tree, m = Tree(y, 5), np.full(4, np.inf)
    found = {n: (c, b) for n, b, _, c in _descend(5, tree.axis, tree.cut, (-m, m), y[:1], np.array([0.6]), np.ones(1), np.zeros(1, int), 0.0)}
    assert sorted(found) == list(range(32)) and sum(float(c[0]) for c, _ in found.values()) == pytest.approx(1, abs=1e-5)
    # the chance of a leaf is the share of neighbours at that distance that fall into it
    share = np.bincount(tree.cell(y[0] + 0.6 * rng.standard_normal((200_000, 4)).astype("float32")), minlength=32) / 200_000
    assert max(abs(share[n] - float(c[0])) for n, (c, _) in found.items()) < 0.01


def tracks(seed, n=400, copies=0):
    rng, r, rows, key = np.random.default_rng(seed), random.Random(seed), [], 1
    centres = rng.standard_normal((40, DIMS))
    for i in range(n):
        c = centres[r.randrange(40)]
        ks, vs = [], []
        for _ in range(r.randint(0, 3)):
            v = (c + 0.25 * rng.standard_normal(DIMS)) * r.choice([1, 5])
            vs.append([float(np.float32(x)) for x in v])
            ks.append(key)
            key += 1
        if r.random() < 0.1:
            vs, ks = vs + [r.choice([None, [0.0] * DIMS, [1.0] * 3, [float("nan")] * DIMS, []])], ks + [key]
            key += 1
        rows.append((i, ks, vs, ks[:1], vs[:1]))
    same = [float(np.float32(x)) for x in centres[0]]
    for i in range(copies):
        rows.append((n + i, [key, key + 1], [same, same], [], None))
        key += 2
    return rows + rows[:20] + [(n + copies, None, None, None, None), (None, [key], [same], [], [])]


def brute(rows, k, least):
    seen = {}
    for i, ks, vs, rs, ws in rows:
        for keys, vectors in ((ks, vs), (rs, ws)):
            for key, v in zip(keys or [], vectors or []):
                if i is not None and v is not None and len(v) == DIMS and np.isfinite(v).all() and any(v):
                    seen[key] = (i, np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)))
    keys = sorted(seen)
    m, g = np.array([seen[x][1] for x in keys]), np.array([seen[x][0] for x in keys])
    s, out = np.round(m @ m.T, 6), set()
    for a, key in enumerate(keys):
        best = sorted((-s[a, b], keys[b]) for b in range(len(keys)) if g[b] != g[a] and s[a, b] >= least)[:k]
        out |= {(min(key, b), max(key, b)) for _, b in best}
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_similar_pairs_against_brute_force(spark, copies):
    rows = tracks(7, copies=copies)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).repartition(3)
    settings = SearchSettings(dims=DIMS, leaf_rows=32, cell_rows=64)
    got = similar_pairs(df, group="id", pairs=[("ks", "vs"), ("rs", "ws")], settings=settings).collect()
    have, want = {(x.key_a, x.key_b) for x in got}, brute(rows, 5, 0.8)
    assert len(have) == len(got)
    assert len(have & want) / len(want) >= 0.97 and len(have - want) <= 0.03 * len(want)
    exact = SearchSettings(dims=DIMS, leaf_rows=32, cell_rows=64, least_chance=0.0)
    assert {(x.key_a, x.key_b) for x in similar_pairs(df, group="id", pairs=[("ks", "vs"), ("rs", "ws")], settings=exact).collect()} == want


@pytest.mark.parametrize("delivered", [1, 2])
def test_equal_vectors_of_a_track_have_all_neighbours(spark, delivered):
    rng = np.random.default_rng(4)
    base = np.eye(DIMS)[1]
    near = lambda: [float(np.float32(x)) for x in base + 0.05 * rng.standard_normal(DIMS)]
    same = [float(x) for x in base]
    # eight equal vectors of one track, two of another, and a track that gives its keys in both arrays
    rows = [(1, list(range(1, 9)), [same] * 8, None, None), (2, [20, 21], [same] * 2, None, None)]
    other = near()
    rows += [(3, [30, 31, 32], [other] * 3, [30, 31, 32], [other] * 3)]
    rows += [(10 + i, [100 + i], [near()], [], []) for i in range(12)]
    rows = rows * delivered
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    exact = SearchSettings(dims=DIMS, leaf_rows=32, cell_rows=64, least_chance=0.0)
    got = {(x.key_a, x.key_b) for x in similar_pairs(df, group="id", pairs=[("ks", "vs"), ("rs", "ws")], settings=exact).collect()}
    assert got == brute(rows, 5, 0.8)


def plain(rows):
    return [(i, [i], [[float(np.float32(x)) for x in v]], None, None) for i, v in rows]


def pairs_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    return {(x.key_a, x.key_b) for x in similar_pairs(df, group="id", pairs=[("ks", "vs"), ("rs", "ws")], settings=SearchSettings(dims=DIMS, **kw)).collect()}


def test_clumps_of_equal_vectors_find_each_other(spark):
    a, b = np.eye(DIMS)[0], 0.9 * np.eye(DIMS)[0] + np.sqrt(0.19) * np.eye(DIMS)[1]
    rows = plain([(i, a) for i in range(10)] + [(10 + i, b) for i in range(10)])
    assert pairs_of(spark, rows) == brute(rows, 5, 0.8) and len(brute(rows, 5, 0.8)) > 80 // 2
    assert pairs_of(spark, rows, k=12, leaf_rows=4) == brute(rows, 12, 0.8)


@pytest.mark.parametrize(("copies", "k"), [(8, 5), (14, 5), (8, 10), (30, 10)])
def test_copies_of_one_group_keep_their_link(spark, copies, k):
    base = np.eye(DIMS)[1]
    other = 0.995 * base + np.sqrt(1 - 0.995**2) * np.eye(DIMS)[2]
    same = [float(x) for x in base]
    rows = [(1, list(range(copies)), [same] * copies, None, None), (2, [100], [[float(np.float32(x)) for x in other]], None, None)]
    assert pairs_of(spark, rows, k=k, least_chance=0.0) == brute(rows, k, 0.8) == {(i, 100) for i in range(copies)}


def test_similar_pairs_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(df, group="id", pairs=[("ks", "vs")], settings=SearchSettings(dims=DIMS)).collect() == []
    df = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert similar_pairs(df, group="id", pairs=[("ks", "vs")], settings=SearchSettings(dims=DIMS)).collect() == []


def separated(seed, copies=0):
    """Groups around orthogonal directions: alike within, not between."""
    rng, rows, want = np.random.default_rng(seed), [], {}
    for c in range(DIMS):
        for _ in range([1, 2, 3, 30, 90][c % 5]):
            v = np.zeros(DIMS)
            v[c] = 1
            v += 0.08 * rng.standard_normal(DIMS)
            rows.append((len(rows) + 1, [[float(x) for x in v], None, [0.0] * DIMS]))
            want.setdefault(c, []).append(len(rows))
    for _ in range(copies):
        v = [0.0] * DIMS
        v[3] = 2.0
        rows.append((len(rows) + 1, [v]))
        want[3].append(len(rows))
    return rows, {(min(m), x) for m in want.values() if len(m) > 1 for x in m}


@pytest.mark.parametrize(("copies", "tree_edges"), [(0, 200_000), (40, 200_000), (40, 25)])
def test_clusters_of_separated_groups(spark, copies, tree_edges):
    rows, want = separated(3, copies)
    df = spark.createDataFrame(rows + rows[:15] + [(None, [[1.0] * DIMS]), (9999, None), (9998, [])], "id bigint, vs array<array<float>>").withColumn("cluster_id", F.lit("clash"))
    got = cluster(df, key="id", vectors="vs", dims=DIMS, k=4, tree_edges=tree_edges).collect()
    assert {(x.cluster_id, x.key) for x in got} == want and len(got) == len(want)
    assert {x.cluster_id for x in got if x.typical} == {c for c, _ in want}
    assert cluster(df.limit(0), key="id", vectors="vs", dims=DIMS).collect() == []


@pytest.mark.parametrize("copies", [False, True])
def test_a_cluster_isnt_split_where_nearer_records_crowd_out_the_rest(spark, copies):
    rng = np.random.default_rng(5)
    a, b, c, d = np.eye(DIMS)[:4]
    at = lambda x, spread=1e-3: [[float(y) for y in x + spread * rng.standard_normal(DIMS)]]
    # two tight groups, alike across; each record finds enough in its own
    vectors = [at(a, 0 if copies else 1e-3) for _ in range(15)] + [at(0.9 * a + 0.43 * b) for _ in range(15)]
    # a record that finds one other only, and that one leads to the first group
    vectors += [at(0.85 * a + 0.53 * c), at(0.72 * a + 0.45 * c + 0.53 * d)]
    rows = list(enumerate(vectors))
    got = cluster(spark.createDataFrame(rows + rows[:5], "id bigint, vs array<array<float>>"), key="id", vectors="vs", dims=DIMS, k=4).collect()
    assert sorted((x.cluster_id, x.key) for x in got) == [(0, i) for i in range(32)]


def test_contraction_changes_neither_persistence_nor_typical_records(spark):
    rows, _ = separated(3)
    # a dense core in a wide cluster
    rng, core = np.random.default_rng(6), np.eye(DIMS)[4]
    rows += [(len(rows) + 1 + i, [[float(x) for x in core + 0.08 * rng.standard_normal(DIMS) * (0.01 if i < 6 else 1)]]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, vs array<array<float>>")
    whole, cut = ({x.key: (x.cluster_id, round(x.persistence, 9), x.typical) for x in cluster(df, key="id", vectors="vs", dims=DIMS, k=4, tree_edges=n).collect()} for n in (200_000, 25))
    assert whole == cut


def test_a_tree_of_equal_edges_is_contracted(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [[float(x) for x in (np.eye(DIMS)[2] + 1e-4 * rng.standard_normal(DIMS))]]) for i in range(60)]
    got = cluster(spark.createDataFrame(rows, "id bigint, vs array<array<float>>"), key="id", vectors="vs", dims=DIMS, k=4, tree_edges=5).collect()
    assert sorted((x.cluster_id, x.key) for x in got) == [(0, i) for i in range(60)]


def reference_clusters(nodes, edges, radius, epsilon, least):
    """Node -> (cluster, persistence), by walking down from the heaviest edge, recursively and from the definitions."""
    rate = lambda d: 1 / max(d, 1e-6)

    def sides(part, inner):
        worst = max(inner, key=lambda e: (e[2], min(e[:2]), max(e[:2])))
        rest = [e for e in inner if e is not worst]
        one, grown = {worst[0]}, True
        while grown:
            grown = False
            for u, v, _ in rest:
                if (u in one) != (v in one):
                    one |= {u, v}
                    grown = True
        halves = one, part - one
        return worst[2], [(h, [e for e in rest if e[0] in h]) for h in halves]

    fall = {}

    def walk(part, inner, birth):
        """A cluster: (records, stability, split distance or None, children)."""
        stability, whole = 0.0, part
        while len(part) > 1:
            d, halves = sides(part, inner)
            big = [h for h in halves if len(h[0]) >= least]
            if len(big) == 2:
                stability += len(part) * (rate(d) - birth)
                return whole, stability, d, [walk(*h, rate(d)) for h in halves]
            out = [h for h in halves if h not in big]
            for h in out:
                stability += len(h[0]) * (rate(d) - birth)
                fall.update(dict.fromkeys(h[0], rate(d)))
            if not big:
                break
            part, inner = big[0]
        return whole, stability, None, []

    def total(c):
        return max(c[1], sum(map(total, c[3])))

    def chosen(c):
        if not c[3] or c[2] < epsilon or c[1] >= sum(map(total, c[3])) - 1e-9:
            return [c[0]]
        return [x for y in c[3] for x in chosen(y)]

    if len(nodes) < least:
        return {}
    return {x: (min(c), fall[x]) for c in chosen(walk(set(nodes), edges, rate(radius))) for x in c}


@pytest.mark.parametrize(("seed", "least", "tree_edges"), [(0, 2, 200_000), (0, 5, 9), (1, 3, 4)])
def test_clusters_in_stages_are_those_of_the_definition(spark, seed, least, tree_edges):
    r, edges, want, at = random.Random(seed), [], {}, 0
    for size in (2, 4, 30, 60):
        own = []
        for i in range(1, size):
            own.append((at + i, at + r.randrange(i), round(r.choice([0.01, 0.02, 0.05, 0.1, 0.19]) + r.random() / 1000 * (seed == 0), 6)))
        edges += [(at, *e) for e in own]
        want |= reference_clusters(list(range(at, at + size)), own, 0.2, 0.03, least)
        at += size
    df = spark.createDataFrame(edges, "tree bigint, u bigint, v bigint, w double")
    got = stable_clusters(df, radius=0.2, epsilon=0.03, least_size=least, tree_edges=tree_edges, one_task=50_000).collect()
    assert {x.node: (x.cluster, round(x.persistence, 6)) for x in got} == {k: (c, round(p, 6)) for k, (c, p) in want.items()}
    assert len(got) == len(want) and {x.cluster for x in got if x.typical} == {c for c, _ in want.values()}


def test_hierarchy_selects_stable_clusters():
    # two tight triples, joined far away: they are more stable than the whole; with a wide epsilon they stay one
    u, v, w = np.array([1, 2, 3, 4, 5]), np.array([2, 3, 4, 5, 6]), np.array([0.01, 0.01, 0.19, 0.01, 0.02])
    h = Hierarchy(np.arange(1, 7), np.ones(6), np.zeros(6), np.zeros(6), np.full(6, np.nan), u, v, w, np.argsort(w, kind="stable"), 2)
    label = [x[2] for x in h.decide("start", 5.0, None, "t", 0.0)]
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3]
    assert h.leaves_at[5] == pytest.approx(50) and h.leaves_at[0] == pytest.approx(100)
    assert len({x[2] for x in h.decide("start", 5.0, None, "t", 0.2)}) == 1


VS = "id bigint, vs array<array<float>>"


def true_forest(vectors, radius, least_points):
    """Weights of the minimum spanning forest of all pairs, and its trees."""
    m = np.float32(vectors).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - np.round(u @ u.T, 6)
    near = np.where(d <= radius + 1e-9, d, radius)
    np.fill_diagonal(near, 0)
    core = np.sort(near, 1)[:, least_points - 1]
    edges = [(a, b, max(d[a, b], core[a], core[b])) for a in range(len(u)) for b in range(a) if d[a, b] <= radius + 1e-9]
    return kruskal(edges)


def members(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster_id, set()).add(r.key)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("one_task", "least_points"), [(0, 4), (50_000, 2)])
def test_the_forest_is_that_of_all_pairs(spark, one_task, least_points):
    # two tight clumps near each other and both near a loose ring: their own link is in no list of the nearest
    rng = np.random.default_rng(8)
    e = np.eye(DIMS)
    vs = [v + 1e-3 * rng.standard_normal(DIMS) for v in [e[0]] * 12 + [e[0] + 0.3 * e[1]] * 12]
    vs += [e[0] + 0.5 * e[2 + i % 6] + 0.02 * rng.standard_normal(DIMS) for i in range(14)] + [e[9] + 0.1 * rng.standard_normal(DIMS) for _ in range(3)]
    rows = [(i, [[float(np.float32(x)) for x in v]]) for i, v in enumerate(vs)]
    forest = density_forest(spark.createDataFrame(rows, VS), key="id", vectors="vs", radius=0.2, k=4, least_points=least_points, dims=DIMS, one_task=one_task)[0].collect()
    want = true_forest([r[1][0] for r in rows], 0.2, least_points)
    assert len(forest) == len(want)
    assert sorted(x.w for x in forest) == pytest.approx(sorted(w for _, _, w in want), abs=3e-6)


def test_arcs_whose_ends_are_near_are_one_tree(spark):
    e = np.eye(DIMS)
    arc = lambda t, sign: np.cos(t) * e[0] + sign * np.sin(t) * e[1]
    # the smallest keys lie at the far ends, the nearest ends are 0.079 apart
    vs = [arc(1.2 - i * 0.025, 1) for i in range(40)] + [arc(1.2 - i * 0.025, -1) for i in range(40)]
    df = spark.createDataFrame([(i, [[float(x) for x in v]]) for i, v in enumerate(vs)], VS)
    got = cluster(df, key="id", vectors="vs", dims=DIMS, radius=0.2, epsilon=0.2, least_points=2, k=4).collect()
    assert members(got) == [list(range(80))]


def test_clusters_of_unequal_density_are_told_apart(spark):
    rng, e = np.random.default_rng(2), np.eye(DIMS)
    tight = [e[0] + 0.01 * rng.standard_normal(DIMS) for _ in range(30)]
    loose = [e[0] + 0.75 * e[1] + 0.05 * rng.standard_normal(DIMS) for _ in range(30)]
    bridge = [e[0] + 0.35 * e[1]]
    df = spark.createDataFrame([(i, [[float(x) for x in v]]) for i, v in enumerate(tight + loose + bridge)], VS)
    got = members(cluster(df, key="id", vectors="vs", dims=DIMS, radius=0.2, epsilon=0.0, least_points=4, least_size=5).collect())
    # the bridge may go to either
    assert [[x for x in c if x < 60] for c in got] == [list(range(30)), list(range(30, 60))]
    # as components of all pairs within the radius they'd be one
    assert members(cluster(df, key="id", vectors="vs", dims=DIMS, radius=0.2, epsilon=0.2, least_points=2).collect()) == [list(range(61))]


def test_a_task_keeps_no_list_of_the_leaves_within_reach(spark):
    rng = np.random.default_rng(8)
    settings = SearchSettings(dims=DIMS, leaf_rows=4, cell_rows=64)
    rows = [(i, [i], v.tolist()) for i, v in enumerate(rng.standard_normal((3000, DIMS)))]
    df = spark.createDataFrame([(i, k, [v]) for i, k, v in rows], "__id bigint, ks array<bigint>, vs array<array<float>>")
    index = build_index(df, lambda b: keyed_vectors(b, "__id", [("ks", "vs")], DIMS), 3000, "vectors", settings)
    leaves = sorted((x.cell, x.leaf) for x in index.rows(spark).where("leaf >= 0").select("cell", "leaf").collect())
    assert len(leaves) > 500
    tracemalloc.start()
    search = _Search(_Shelf(index), leaves)
    search.run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(search.keys) == 3000 and peak < 20_000_000
    # the last round opens most leaves and notes none
    assert sum(x.nbytes for x in search.seen.values()) < 3_000_000
