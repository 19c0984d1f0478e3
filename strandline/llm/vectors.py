"""Problem 4: the most similar vectors of every vector.

Vectors are projected with a stable (Gaussian) random matrix to a few numbers. A kd-tree over the projections, fitted on a
bounded sample, cuts the collection into cells; each cell cuts itself into leaves and is written to the shared folder
with its vectors. A query opens the leaves in the order of the chance that they hold a vector as near as its k-th, verifies
the vectors in them exactly, and stops where little chance is left outside; a chi-square test closes leaves that are too far.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import cut_lineage, scratch_path

@dataclass(frozen=True)
class SearchSettings:
    """Settings of the index and the search; the defaults hold for every size of collection."""

    dims: int = 80
    k: int = 5
    least_cosine: float = 0.8
    #: Numbers of the stable projection, an even number.
    projected: int = 16
    #: The search stops where a vector as near as the k-th found lies in a closed leaf with less than this chance; 0 opens all.
    least_chance: float = 0.02
    leaf_rows: int = 256
    cell_rows: int = 4096
    #: With more than cell_rows * max_cells vectors (134 million) cells grow; a cell of 300,000 vectors (10 billion) takes 100 MB.
    max_cells: int = 32_768
    #: The tree of cells is fitted on about twice as many vectors for each cell, four times as many at most (1,048,576 in all).
    sample_per_cell: int = 8
    seed: int = 20250301
    #: Queries that a task answers together.
    task_rows: int = 16_384
    #: Bytes of cells that a task remembers.
    cache_bytes: int = 160 << 20

    def matrix(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dims, self.projected)).astype("float32")


def usable(lists: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a flat array of vectors: which are usable (``dims`` finite numbers, not all zero), and these as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at = np.flatnonzero(pc.equal(pc.list_value_length(lists), dims).fill_null(False).to_numpy(zero_copy_only=False))
    values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("float32", copy=False).reshape(-1, dims)
    ok = np.isfinite(values).all(1) & (values != 0).any(1)
    return at[ok], values[ok]


def nested(lists) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of an array of lists: each element's row, its position there, and the elements."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lists.flatten()


def keyed_vectors(batch: pa.RecordBatch, group: str, pairs: list[tuple[str, str]], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, groups and raw vectors of a batch whose columns of ``pairs`` name keys and vectors position by position."""
    keys, groups, found = [], [], []
    own = batch.column(group)
    known, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False)
    for key, vector in pairs:
        krow, kpos, kval = nested(batch.column(key))
        vrow, vpos, vval = nested(batch.column(vector))
        good, values = usable(vval, dims)
        start = np.searchsorted(krow, np.arange(batch.num_rows + 1))
        at = start[vrow[good]] + vpos[good]
        fits = (at < start[vrow[good] + 1]) & known[vrow[good]]
        at, values, rows = at[fits], values[fits], vrow[good][fits]
        valid = kval.is_valid().to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, bool)
        keys.append(kval.fill_null(0).to_numpy(zero_copy_only=False)[at][valid].astype("int64"))
        groups.append(own[rows][valid].astype("int64"))
        found.append(values[valid])
    return np.concatenate(keys), np.concatenate(groups), np.concatenate(found)


def projections(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """In double precision first, so that equal vectors come out equal in whatever batch they stand."""
    return (unit(vectors) @ matrix.astype("float64")).astype("float32")


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype("float64")
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Tree:
    """A complete kd-tree: nodes 1, 2, ... as in a heap, each split at the median of the direction of most variance."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, n = depth, 1 << depth
        self.axis, self.cut = np.zeros(n, "int64"), np.zeros(n, "float32")
        parts = {1: sample}
        for node in range(1, n):
            y = parts.pop(node)
            axis = int(np.argmax(y.var(0))) if len(y) else 0
            cut = np.float32(np.median(y[:, axis])) if len(y) else np.float32(0)
            self.axis[node], self.cut[node] = axis, cut
            left = y[:, axis] < cut
            parts[2 * node], parts[2 * node + 1] = y[left], y[~left]

    def cell(self, y: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(y), "int64"), np.arange(len(y))
        for _ in range(self.depth):
            node = 2 * node + (y[rows, self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)


def _descend(depth: int, axis: np.ndarray, cut: np.ndarray, bounds, y: np.ndarray, d: np.ndarray, mass: np.ndarray, rows: np.ndarray, least: float | np.ndarray):
    """Of a tree's leaves: number, bounds, and which rows may have a vector at distance ``d`` in it with which chance.

    A projected difference is ``d`` times a standard normal number in each direction, so the chance of a node is that of its
    parent times the share of the normal distribution on its side of the cut. Chances below ``least`` (one number, or one
    for each row of ``y``) aren't followed. Leaves come in the order of their numbers.
    """
    limits = np.ndim(least) > 0
    stack = [(1, bounds, rows, mass)]
    while stack:
        node, (low, high), own, chance = stack.pop()
        if node >= 1 << depth:
            yield node - (1 << depth), (low, high), own, chance
            continue
        j, c = int(axis[node]), float(cut[node])
        at, scale = y[own, j], d[own]
        here = normal((c - at) / scale)
        below = 0.0 if low[j] == -np.inf else normal((low[j] - at) / scale)
        above = 1.0 if high[j] == np.inf else normal((high[j] - at) / scale)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.nan_to_num((here - below) / (above - below), nan=0.5)
        share = np.clip(share, 0, 1)
        for side, part in ((1, chance * (1 - share)), (0, chance * share)):
            on = part >= (least[own] if limits else least)
            if on.any():
                b = (low, high.copy()) if side == 0 else (low.copy(), high)
                b[1 - side][j] = c
                stack.append((2 * node + side, b, own[on], part[on]))


_NORMAL = np.array([0.5 * math.erfc(-x / 500 / math.sqrt(2)) for x in range(-3000, 3001)], "float32")


def normal(z: np.ndarray) -> np.ndarray:
    """The distribution function of the standard normal distribution, to three decimals of ``z``."""
    return _NORMAL[(np.clip(z, -6, 6) * 500 + 3000.5).astype("int32")]


def chi_square_limit(directions: int, chance: float) -> float:
    """What chi-square with an even number of degrees of freedom exceeds with this chance."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        x = (low + high) / 2
        term = total = 1.0
        for j in range(1, directions // 2):
            term *= x / 2 / j
            total += term
        low, high = (x, high) if math.exp(-x / 2) * total > chance else (low, x)
    return low


def _copies(vectors: np.ndarray) -> np.ndarray:
    """A number per row, equal for exact copies."""
    rows = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
    return pd.factorize(pd.Series([x.tobytes() for x in rows]) if len(rows) else pd.Series([], dtype=object))[0]


def keep_of_copies(keys: np.ndarray, groups: np.ndarray, copy: np.ndarray, k: int) -> np.ndarray:
    """Which rows stay: of each set of copies the smallest keys, k of a group at most and 2 k in all.

    Whatever group a query is of, the k smallest keys of other groups are among these.
    """
    order = np.lexsort((keys, copy))
    frame = pd.DataFrame({"c": copy[order], "g": groups[order]})
    first = (frame.groupby(["c", "g"]).cumcount() < k).to_numpy()
    place = frame[first].groupby("c").cumcount().to_numpy() < 2 * k
    keep = np.zeros(len(keys), bool)
    keep[order[np.flatnonzero(first)[place]]] = True
    return keep


def digest(vector: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(vector).tobytes(), digest_size=16).digest()


_PLACED = "cell int, key bigint, grp bigint, vec binary, copy binary, asks boolean"
#: Leaves (leaf >= 0; the first holds the cell's tree), copies that aren't in a leaf (-1), kept copies of such (-2); n is the
#: number of queries.
_INDEX = "cell int, leaf int, n int, low binary, high binary, keys binary, grps binary, vecs binary, copies binary, one binary, asks binary, tree binary"


class Index:
    """An index written to the shared folder, and what a search needs to know of it."""

    def __init__(self, path: str, settings: SearchSettings, tree: Tree, cells: list):
        self.path, self.settings, self.tree, self.cells = path, settings, tree, frozenset(cells)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(self.path)

    def has_followers(self, spark: SparkSession) -> bool:
        return self.rows(spark).where("leaf = -1").limit(1).count() > 0

    def followers(self, spark: SparkSession, linked: DataFrame | None = None) -> DataFrame:
        """Copies that are not in the index, each with what is near the same vector: key, grp, kept (far, key, grp).

        ``kept`` holds the copies in the index and, if the index's own neighbours are given as ``linked``, theirs too;
        nearest first (``far`` is the cosine with its sign changed), then by key.
        """
        rows = self.rows(spark).where("leaf < 0")
        own = rows.where("leaf = -1").select("copies", "keys", "grps").mapInPandas(_unpacked, "copy binary, key bigint, grp bigint")
        kept = rows.where("leaf = -2").select("copies", "keys", "grps").mapInPandas(_unpacked, "copy binary, key bigint, grp bigint")
        near = kept.withColumn("cosine", F.lit(1.0))
        if linked is not None:
            others = linked.join(kept.select("copy", "key"), "key")
            near = near.unionByName(others.select("copy", F.col("other").alias("key"), F.col("other_grp").alias("grp"), "cosine"))
        near = near.groupBy("copy").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "key", "grp"))).alias("kept"))
        return own.dropDuplicates(["key"]).join(near, "copy").select("key", "grp", "kept")


def _unpacked(batches):
    for rows in batches:
        parts = [(np.frombuffer(k, "int64"), np.frombuffer(g, "int64"), c) for k, g, c in zip(rows["keys"], rows["grps"], rows["copies"], strict=True)]
        yield pd.DataFrame({"copy": [c[i : i + 16] for _, _, c in parts for i in range(0, len(c), 16)], "key": np.concatenate([p[0] for p in parts]), "grp": np.concatenate([p[1] for p in parts])})


def build_index(source: DataFrame, rows_of, n_rows: int, what: str, settings: SearchSettings) -> Index:
    """Writes the index of all vectors.

    ``source`` has a column ``__id`` that the sample of the tree is drawn by; ``rows_of(batch)`` gives keys, groups and
    raw vectors of an Arrow batch of ``source`` and, if not all, which of them are queries; ``n_rows`` is about how many.
    Each key counts once.

    Plan: one pass over the sample, one shuffle of the vectors by cell, one write. Exact copies are reduced before the
    shuffle and again in their cell.
    """
    spark, m = source.sparkSession, settings.projected
    depth = max(0, math.ceil(math.log2(max(1, min(n_rows / settings.cell_rows, settings.max_cells)))))
    wanted = settings.sample_per_cell << depth

    def project(batches):
        p = settings.matrix()
        for batch in batches:
            v = rows_of(batch)[2]
            yield pa.RecordBatch.from_pydict({"y": pa.array([x.tobytes() for x in projections(v, p)], pa.binary())})

    steps = 1_000_000
    share = min(steps, math.ceil(steps * 2 * wanted / max(1, n_rows)))
    # the share is drawn by id, the limit bounds what the driver gets
    drawn = source.where(F.pmod(F.xxhash64("__id"), F.lit(steps)) < share).mapInArrow(project, "y binary").limit(4 * wanted).toArrow()
    tree = Tree(np.frombuffer(b"".join(drawn.column("y").to_pylist()), "float32").reshape(-1, m), depth)

    def place(batches):
        p = settings.matrix()
        for batch in batches:
            keys, groups, v, *asks = rows_of(batch)
            if not len(keys):
                continue
            copy, asks = _copies(v), asks[0] if asks else np.ones(len(keys), bool)
            once = ~pd.DataFrame({"k": keys, "c": copy}).duplicated().to_numpy()
            keys, groups, v, copy, asks = keys[once], groups[once], v[once], copy[once], asks[once]
            cell = tree.cell(projections(v, p))
            keep = keep_of_copies(keys, groups, copy, settings.k)
            # what follows takes the neighbours of those that are kept
            asks = asks | (np.bincount(copy)[copy] >= settings.k)
            vec = [x.tobytes() if k else None for x, k in zip(v, keep, strict=True)]
            mark = [None if k else digest(x) for x, k in zip(v, keep, strict=True)]
            # a copy that isn't needed goes anywhere, so that copies don't gather
            cell = np.where(keep, cell, keys % (1 << depth))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "key": keys, "grp": groups, "vec": pa.array(vec, pa.binary()), "copy": pa.array(mark, pa.binary()), "asks": asks})

    def leaves(key, rows: pd.DataFrame) -> pd.DataFrame:
        cell, p, out = int(key[0]), settings.matrix(), []
        # a key that has a vector in one row and only follows in another keeps the vector
        spare = rows[rows["vec"].isna()].drop_duplicates("key")
        rows = rows[rows["vec"].notna()].drop_duplicates("key").sort_values("key", kind="stable")

        def extra(leaf, k, g, c):
            out.append((cell, leaf, len(k), b"", b"", k.astype("int64").tobytes(), g.astype("int64").tobytes(), b"", b"".join(c), b"", b"", b""))

        if len(spare):
            extra(-1, spare["key"].to_numpy(), spare["grp"].to_numpy(), spare["copy"])
        v = np.frombuffer(b"".join(rows["vec"]), "float32").reshape(-1, settings.dims)
        k, g, asks = rows["key"].to_numpy("int64"), rows["grp"].to_numpy("int64"), rows["asks"].to_numpy(bool)
        copy = _copies(v)
        if len(k):
            keep = keep_of_copies(k, g, copy, settings.k)
            # whatever follows, here or in a batch, left at least k of its copies behind
            many = np.isin(copy, np.flatnonzero(np.bincount(copy) >= settings.k))
            asks = asks | many
            if many.any():
                at = np.flatnonzero(many & keep)
                extra(-2, k[at], g[at], [digest(v[i]) for i in at])
            if not keep.all():
                at = np.flatnonzero(~keep)
                extra(-1, k[at], g[at], [digest(v[i]) for i in at])
            k, g, v, asks = k[keep], g[keep], v[keep], asks[keep]
            y = projections(v, p)
            inner = Tree(y, max(0, math.ceil(math.log2(len(k) / settings.leaf_rows))))
            leaf = inner.cell(y)
            shape = inner.axis.astype("int32").tobytes() + inner.cut.tobytes()
            for n in np.unique(leaf):
                at = np.flatnonzero(leaf == n)
                one = g[at[:1]].tobytes() if (g[at] == g[at[0]]).all() else b""
                out.append((cell, int(n), int(asks[at].sum()), y[at].min(0).tobytes(), y[at].max(0).tobytes(), k[at].tobytes(), g[at].tobytes(), v[at].tobytes(), b"", one, asks[at].tobytes(), shape))
                shape = b""
        return pd.DataFrame(out, columns=[c.split()[0] for c in _INDEX.split(", ")])

    path = qualified(spark, scratch_path(spark, what))
    placed = source.mapInArrow(place, _PLACED)
    placed.groupBy("cell").applyInPandas(leaves, _INDEX).write.partitionBy("cell").parquet(path)
    cells = [r["cell"] for r in spark.read.schema(_INDEX).parquet(path).where("leaf >= 0").select("cell").distinct().collect()]
    return Index(path, settings, tree, cells)


class _Cell:
    """A cell as read back: its tree and its leaves' boxes at first, vectors when a leaf is opened."""

    def __init__(self, fs, folder: str, m: int, dims: int):
        self._at, self._dims, self._full = (fs, folder), dims, None
        t = self._read("leaf", "low", "high", "one", "tree")
        leaf = t.column("leaf").to_numpy()
        order = np.argsort(leaf)
        self.place = {int(x): i for i, x in enumerate(leaf[order])}
        self.low, self.high = (np.frombuffer(b"".join(t.column(c).to_pylist()), "float32").reshape(-1, m)[order] for c in ("low", "high"))
        shape = max(t.column("tree").to_pylist(), key=len)
        n = len(shape) // 8
        self.depth, self.axis, self.cut = n.bit_length() - 1, np.frombuffer(shape[: 4 * n], "int32"), np.frombuffer(shape[4 * n :], "float32")
        # leaves of one group only, and that group
        one = t.column("one").to_pylist()
        self.pure = np.array([len(x) > 0 for x in one], bool)[order]
        self.one = np.frombuffer(b"".join(x or bytes(8) for x in one), "int64")[order]
        #: Bytes of what stays, with the objects around it, and of the vectors.
        self.shape_size, self.size = self.low.nbytes * 2 + len(shape) + 4096 + 128 * len(leaf), 0

    def _read(self, *columns: str) -> pa.Table:
        import pyarrow.dataset as ds

        fs, folder = self._at
        return ds.dataset(folder, format="parquet", filesystem=fs).to_table(columns=list(columns), filter=ds.field("leaf") >= 0)

    def forget(self) -> None:
        self._full, self.size = None, 0

    def vectors(self, i: int):
        """Of the i-th leaf: keys, groups, raw vectors, unit vectors, which are queries."""
        if self._full is None:
            t = self._read("leaf", "keys", "grps", "vecs", "asks").to_pylist()
            t.sort(key=lambda r: r["leaf"])
            self._full = []
            for r in t:
                raw = np.frombuffer(r["vecs"], "float32").reshape(-1, self._dims)
                scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
                scaled /= np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
                self._full.append((np.frombuffer(r["keys"], "int64"), np.frombuffer(r["grps"], "int64"), raw, scaled, np.frombuffer(r["asks"], "bool")))
                self.size += 2 * raw.nbytes
        return self._full[i]


def _file_system(path: str):
    """pyarrow's file system for a path as Hadoop qualifies it, and the path within."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Hadoop finds it in, so that workers read it from there too."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


class _Shelf:
    """Cells that a worker remembers, the least recently used go first: vectors before the trees and boxes, which each
    search needs of all cells and which take up to a half of the room."""

    def __init__(self, index: Index):
        self._fs, self._root = _file_system(index.path)
        self.index, self._s = index, index.settings
        self._kept: OrderedDict[int, _Cell] = OrderedDict()
        self._full: OrderedDict[int, _Cell] = OrderedDict()
        self._shapes = 0

    def cell(self, number: int) -> _Cell:
        if number not in self._kept:
            while self._kept and self._shapes > self._s.cache_bytes // 2:
                gone, old = self._kept.popitem(last=False)
                self._shapes -= old.shape_size
                self._full.pop(gone, None)
            self._kept[number] = _Cell(self._fs, f"{self._root}/cell={number}", self._s.projected, self._s.dims)
            self._shapes += self._kept[number].shape_size
        self._kept.move_to_end(number)
        return self._kept[number]

    def vectors(self, number: int, i: int):
        """See :meth:`_Cell.vectors`; what the cell holds is forgotten again by the bound of bytes."""
        cell = self.cell(number)
        if number not in self._full:
            while self._full and self._shapes + sum(c.size for c in self._full.values()) > self._s.cache_bytes:
                self._full.popitem(last=False)[1].forget()
            self._full[number] = cell
        self._full.move_to_end(number)
        return cell.vectors(i)


#: Steps of half a power of two in which chances are sorted.
_STEPS = 64


def _step(chance: np.ndarray) -> np.ndarray:
    return np.minimum(-2 * np.log2(np.maximum(chance, 1e-30)), _STEPS - 1).astype("int64")


class _Search:
    """All queries of a task at once: cell by cell, those that a cell may still help."""

    def __init__(self, shelf: _Shelf, leaves: list[tuple[int, int]]):
        self.index, self.shelf = shelf.index, shelf
        s = self.index.settings
        self.own = {}
        parts, n = [], 0
        for number, leaf in leaves:
            *part, asks = shelf.vectors(number, shelf.cell(number).place[leaf])
            part = [x[asks] for x in part]
            self.own.setdefault(number, []).append((leaf, np.arange(n, n + len(part[0]))))
            n += len(part[0])
            parts.append(part)
        self.keys, self.groups, self.raw, self.units = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.y = projections(self.raw, s.matrix()) if n else np.zeros((0, s.projected), "float32")
        self.least = s.least_cosine - 1e-6
        self.bound = np.full(n, np.float32(self.least - 1e-6))
        self.best = [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
        self.far = chi_square_limit(s.projected, s.least_chance / 2) if s.least_chance > 0 else np.inf
        # a leaf's queries so far; the last round needs no note of its own
        self.seen: dict[tuple[int, int], np.ndarray] = {}
        self.mark = np.zeros(n, bool)

    def run(self):
        """Keys, groups, neighbours' keys, their groups and cosines, at most k to a query, sorted by query."""
        for number, own in self.own.items():
            self._visit(number, own, True)
        chance = self.index.settings.least_chance
        rounds = (0.4, chance) if chance > 0 else (0.0,)
        for left in rounds:
            for number, wanted in self._chosen(left):
                self._visit(number, wanted, left != rounds[-1])
        return self.keys[self.best[0]], self.groups[self.best[0]], *self.best[1:]

    def _chosen(self, left: float) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Per cell the leaves and the queries that open them, so that each query's closed leaves have less than ``left`` chance.

        Leaves within reach grow with the collection, so no list of them is kept: the first walk only sums the chances by
        step, the second follows what reaches a query's own step and gives it cell by cell.
        """
        n = len(self.keys)
        if not n:
            return
        d = np.sqrt(np.maximum(2 - 2 * self.bound.astype("float64"), 1e-12))
        least, last = left * 1e-3, np.full(n, _STEPS)
        if left > 0:
            sums = np.zeros((n, _STEPS))
            for _, reached in self._reached(d, least):
                for _, rows, chance in reached:
                    sums[rows, _step(chance)] += chance
            # the first step at which enough is open
            last = (np.cumsum(sums, 1) < 1 - left).sum(1)
            # nothing below belongs to a query's last step; a little less, for the logarithm's rounding
            least = np.where(last < _STEPS - 1, np.maximum(least, 2.0 ** (-(last + 1) / 2) * (1 - 1e-9)), least)
        for number, reached in self._reached(d, least):
            wanted = [(leaf, on) for leaf, rows, chance in reached if len(on := rows[_step(chance) <= last[rows]])]
            if wanted:
                yield number, wanted

    def _reached(self, d: np.ndarray, least: float | np.ndarray):
        """Per cell, in the order of their numbers: its leaves with the queries that may have a vector there, and the chance."""
        tree, m, n = self.index.tree, self.index.settings.projected, len(self.keys)
        everywhere = (np.full(m, -np.inf), np.full(m, np.inf))
        for number, bounds, rows, chance in _descend(tree.depth, tree.axis, tree.cut, everywhere, self.y, d, np.ones(n), np.arange(n), least):
            if number in self.index.cells:
                cell = self.shelf.cell(number)
                yield number, ((leaf, r, c) for leaf, _, r, c in _descend(cell.depth, cell.axis, cell.cut, bounds, self.y, d, chance, rows, least) if leaf in cell.place)

    def _visit(self, number: int, wanted: list[tuple[int, np.ndarray]], again: bool) -> None:
        """Verifies the vectors of a cell's leaves for the queries that open them; ``again``: a later round may open them too."""
        s, cell, found = self.index.settings, self.shelf.cell(number), []
        for leaf, q in wanted:
            j = cell.place[leaf]
            seen = self.seen.get((number, leaf))
            if seen is not None:
                self.mark[seen] = True
                q = q[~self.mark[q]]
                self.mark[seen] = False
            if cell.pure[j]:
                q = q[self.groups[q] != cell.one[j]]
            # a leaf of the query itself has no gap
            gap = np.maximum(np.maximum(cell.low[j] - self.y[q], self.y[q] - cell.high[j]), 0)
            q = q[np.einsum("qm,qm->q", gap, gap) <= self.far * np.maximum(2 - 2 * self.bound[q], 1e-6)] if self.far < np.inf else q
            if not len(q):
                continue
            if again:
                self.seen[number, leaf] = (q if seen is None else np.concatenate([seen, q])).astype("int32")
            keys, groups, raw, units, _ = self.shelf.vectors(number, j)
            for part in np.array_split(q, -(-len(q) // 2048)):
                near = np.flatnonzero((self.units[part] @ units.T >= self.bound[part][:, None]).ravel())
                if not len(near):
                    continue
                qi, ci = part[near // len(keys)], near % len(keys)
                fits = self.groups[qi] != groups[ci]
                qi, ci = qi[fits], ci[fits]
                a, b = self.raw[qi].astype("float64"), raw[ci].astype("float64")
                dot = np.einsum("ij,ij->i", a, b)
                cosine = np.round(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)
                ok = cosine >= s.least_cosine
                found.append([qi[ok], keys[ci[ok]], groups[ci[ok]], cosine[ok]])
        if not any(len(x[0]) for x in found):
            return
        touched = np.zeros(len(self.keys), bool)
        for x in found:
            touched[x[0]] = True
        held = touched[self.best[0]]
        qi, k2, g2, c = (np.concatenate([*(x[i] for x in found), self.best[i][held]]) for i in range(4))
        order = np.lexsort((k2, -c, qi))
        qi, k2, g2, c = qi[order], k2[order], g2[order], c[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep, full = place < s.k, place == s.k - 1
        # an equal cosine of a smaller key still counts, and single precision is a little off
        self.bound[qi[full]] = np.maximum(self.bound[qi[full]], (c[full] - 2e-6).astype("float32"))
        merged = [np.concatenate([x[~held], y[keep]]) for x, y in zip(self.best, (qi, k2, g2, c), strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.best = [x[order] for x in merged]


#: The shelf that a worker process keeps from task to task.
_SHELVES: dict[str, _Shelf] = {}


def _shelf(index: Index) -> _Shelf:
    if index.path not in _SHELVES:
        _SHELVES.clear()
        _SHELVES[index.path] = _Shelf(index)
    return _SHELVES[index.path]


def neighbours(index: Index, spark: SparkSession, each=None, schema: str = "key bigint, grp bigint, other bigint, other_grp bigint, cosine double") -> DataFrame:
    """The up to k most similar vectors of other groups for each query in the index, by cosine to six decimals.

    Equal cosines go by the smaller key. ``each`` may reduce the rows of a task (a frame in, a frame of ``schema`` out).

    Plan: a task takes a range of leaves with about ``task_rows`` queries, reads a cell from the shared folder where a
    query may have a neighbour in it, and forgets cells by a bound of bytes; no vector is shuffled again.
    """
    leaves = index.rows(spark).where("leaf >= 0 and n > 0").select("cell", "leaf", "n")
    total = leaves.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // index.settings.task_rows))
    ranged = leaves.repartitionByRange(tasks, "cell", "leaf")

    def search(batches):
        own = sorted(x for rows in batches for x in zip(rows["cell"].tolist(), rows["leaf"].tolist(), strict=True))
        if own:
            frame = pd.DataFrame(dict(zip(("key", "grp", "other", "other_grp", "cosine"), _Search(_shelf(index), own).run(), strict=True)))
            yield frame if each is None else each(frame)

    return ranged.mapInPandas(search, schema)


def most_similar(source: DataFrame, *, group: str, pairs: list[tuple[str, str]], settings: SearchSettings = SearchSettings(), every: int = 1) -> DataFrame:  # noqa: B008
    """The k most similar vectors of other groups for each key divisible by ``every``: ``key``, ``other``, ``cosine``.

    ``pairs`` names columns of keys and of vectors that belong together position by position. Neighbours have at least
    ``least_cosine``; the cosine has six decimals, equal ones go by the smaller key. All vectors are in the index, whatever
    is asked.

    Defined cases: vectors that are null, of another length, all zero or not finite, and null keys and groups take no
    part; a key counts once; arrays may be null, empty or of unequal length; exact copies beyond k of a group or 2 k in all
    take the neighbours of those that stay in the index; an empty table gives an empty result; other columns are
    not read.
    """
    spark = source.sparkSession
    columns = [c for p in pairs for c in p]
    rows = source.select(F.col(group).alias("__id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)]).where("__id is not null")
    counted = rows.agg(*[F.sum(F.greatest(F.size(f"__{i}"), F.lit(0))) for i in range(0, len(columns), 2)]).first()
    named = [(f"__{i}", f"__{i + 1}") for i in range(0, len(columns), 2)]

    def rows_of(batch):
        keys, groups, vectors = keyed_vectors(batch, "__id", named, settings.dims)
        return keys, groups, vectors, keys % every == 0

    index = build_index(rows, rows_of, sum(x or 0 for x in counted), "vectors", settings)
    linked = neighbours(index, spark)
    both = linked.select("key", "other", "cosine")
    if index.has_followers(spark):
        linked = cut_lineage(linked)
        copies = index.followers(spark, linked).select("key", F.slice(F.filter("kept", lambda x: (x["grp"] != F.col("grp")) & (x["key"] != F.col("key"))), 1, settings.k).alias("k"))
        copies = copies.select("key", F.explode("k").alias("x")).select("key", F.col("x.key").alias("other"), (-F.col("x.far")).alias("cosine"))
        both = linked.select("key", "other", "cosine").unionByName(copies)
    return both if every == 1 else both.where(F.pmod("key", F.lit(every)) == 0)


def similar_pairs(source: DataFrame, *, group: str, pairs: list[tuple[str, str]], settings: SearchSettings = SearchSettings()) -> DataFrame:  # noqa: B008
    """Pairs of keys of which at least one is among the k most similar of the other: ``key_a`` < ``key_b``, ``cosine``.

    See :func:`most_similar` for the parameters and the defined cases.
    """
    both = most_similar(source, group=group, pairs=pairs, settings=settings)
    return both.groupBy(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).agg(F.max("cosine").alias("cosine"))
