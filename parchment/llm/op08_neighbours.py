"""Approximate nearest neighbours by low-dimensional 2-stable (Gaussian) projections and kd-trees: projected
neighbours are visited in order of distance and verified on the original vectors until a chi-square test says
that a closer one is unlikely to be left.

Largest inner product becomes smallest distance by one more coordinate: with M the largest norm of a class of vectors, x
gets sqrt(M^2 - |x|^2) and the query, scaled to norm M, gets 0. For projections on m Gaussian directions, the squared projected
distance over the squared distance is chi-square with m degrees of freedom: a vector that is closer than the k-th best found
lies within stop * (its distance) with probability `sure`, so nothing beyond is verified. Classes of norms, each with its own
M, keep the extra coordinate small; a class whose M times the query's norm stays below the k-th best has nothing closer at all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.llm.shared import cut
from parchment.llm.vectors import usable


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    term = total = 1.0
    for k in range(1, m // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    """m Gaussian directions for vectors of `dim` components and the one added to them; the same on every executor."""
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, m))


def project(x: np.ndarray, longest: float, m: int, seed: int) -> np.ndarray:
    extra = np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(1)))
    return np.c_[x, extra] @ directions(x.shape[1], m, seed)


def project_queries(x: np.ndarray, longest: float, m: int, seed: int) -> np.ndarray:
    return (x * (longest / np.linalg.norm(x, axis=1))[:, None]) @ directions(x.shape[1], m, seed)[:-1]


def reach(bound: np.ndarray, norm: np.ndarray, longest: float, stop: float) -> np.ndarray:
    """Squared projected distance within which vectors better than `bound` lie, as far as the test can tell; below 0: there are none."""
    left = 2 * longest**2 - 2 * longest / norm * bound
    return np.where(left >= -1e-9 * longest**2, stop * np.maximum(left, 1e-12 * longest**2), -1.0)


class KdTree:
    """Leaves of a kd-tree over projected points: split at the median of the widest coordinate. order: points by leaf;
    low and high: the box of each leaf. `cells`: split planes only, so that any point falls into one leaf, whose box has no end."""

    def __init__(self, points: np.ndarray, leaf: int = 48, cells: bool = False):
        n, m = points.shape
        self.order, found = np.arange(n), []
        self.splits: list = []  # coordinate, value, left, right; leaves as -1 - number
        todo = [(0, n, np.full(m, -np.inf), np.full(m, np.inf), -1, 0)]
        while todo:
            a, b, low, high, parent, side = todo.pop()
            own = self.order[a:b]
            spread = np.ptp(points[own], axis=0) if b > a else np.zeros(m)
            if b - a <= leaf or spread.max() == 0:
                if parent >= 0:
                    self.splits[parent][2 + side] = -1 - len(found)
                found.append((a, b, low, high))
                continue
            c, half = int(spread.argmax()), (b - a) // 2
            self.order[a:b] = own[np.argpartition(points[own, c], half)]
            value = float(points[self.order[a + half], c])
            if parent >= 0:
                self.splits[parent][2 + side] = len(self.splits)
            self.splits.append([c, value, 0, 0])
            for begin, end, k in ((a, a + half, 0), (a + half, b, 1)):
                lo, hi = low.copy(), high.copy()
                (hi if k == 0 else lo)[c] = value
                todo.append((begin, end, lo, hi, len(self.splits) - 1, k))
        by_place = np.argsort([f[0] for f in found], kind="stable")
        number = np.empty(len(found), np.int64)
        number[by_place] = np.arange(len(found))
        self.splits = [(c, v, *(-1 - int(number[-1 - x]) if x < 0 else x for x in ends)) for c, v, *ends in self.splits]
        found = [found[i] for i in by_place]
        self.starts, self.ends = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
        if cells:
            self.low, self.high = (np.array([f[i] for f in found]) for i in (2, 3))
        else:
            laid = points[self.order]
            self.low, self.high = (np.array([f(laid[a:b], axis=0) for a, b, *_ in found]) for f in (np.min, np.max))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf on whose side of every split each point lies."""
        out = np.zeros(len(points), np.int64)
        if not self.splits:
            return out
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                c, value, left, right = self.splits[node]
                up = points[own, c] >= value
                todo += [(left, own[~up]), (right, own[up])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0.0) ** 2).sum(1)


class Shard:
    """Vectors of one length with their projections, in the order of a kd-tree's leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, longest: float, m: int, seed: int):
        points = project(x, longest, m, seed)
        self.tree = KdTree(points)
        self.x, self.ids, self.points = np.ascontiguousarray(x[self.tree.order]), ids[self.tree.order], points[self.tree.order]
        self.squares, self.longest = (self.points**2).sum(1), longest
        self.leaf = np.repeat(np.arange(len(self.tree.starts)), self.tree.ends - self.tree.starts)

    def search(self, q: np.ndarray, qid: int, p: np.ndarray, start: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products of the best vectors, k at most and none below `start`, that the test lets it find, and how many
        it verified.

        Leaves are opened by the distance of their boxes, first the nearest few, then all that are left within reach. Of their
        points those within reach are verified by growing projected distance, four times as many each time; the reach
        shrinks as better ones are found."""
        norm, bound, seen = float(np.linalg.norm(q)), start, 0
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        boxes = self.tree.distances(p)
        order = np.argsort(boxes, kind="stable")
        limit = lambda: float(reach(bound, norm, self.longest, stop)) * (1 + 1e-9) if bound > -math.inf else math.inf

        def verify(rows: np.ndarray) -> None:
            nonlocal best_rows, best, seen, bound
            rows = rows[self.ids[rows] != qid]
            seen += len(rows)
            best_rows, best = np.r_[best_rows, rows], np.r_[best, self.x[rows] @ q]
            if len(best) >= k:
                least = np.partition(best, -k)[-k]
                bound = max(bound, least)
                keep = best >= least - 1e-9 * max(1.0, abs(least))
                best_rows, best = best_rows[keep], best[keep]

        for some in (order[:4], order[4:]):
            some = some[boxes[some] <= limit()]
            if 4 * len(some) < len(boxes):
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(self.tree.starts[some], self.tree.ends[some], strict=True))])
                d = self.squares[rows] - 2 * (self.points[rows] @ p) + p @ p
                rows, d = rows[inside := d <= limit()], d[inside]
            else:
                opened = np.zeros(len(boxes), bool)
                opened[some] = True
                d = self.squares - 2 * (self.points @ p) + p @ p
                rows = np.flatnonzero((d <= limit()) & opened[self.leaf])
                d = d[rows]
            many = 4 * k
            while len(rows):
                if len(rows) > many:
                    parted = np.argpartition(d, many)
                    verify(rows[parted[:many]])
                    rest = parted[many:]
                    rest = rest[d[rest] <= limit()]
                    rows, d = rows[rest], d[rest]
                    many *= 4
                else:
                    verify(rows)
                    break
        exact = (self.x[best_rows] * q).sum(1)  # the same sum for equal vectors, wherever they lie
        order = np.lexsort((self.ids[best_rows], -exact))[:k]
        order = order[exact[order] >= start - 1e-9 * max(1.0, abs(start))] if start > -math.inf else order
        return self.ids[best_rows][order], exact[order], seen


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, sure: float = 0.92, m: int = 24, seed: int = 11, shard_rows: int = 32_768, block_rows: int = 8_192,
            sample: int = 65_536, visits: str | None = None) -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score double: for every row whose id is divisible by `every`
    its k nearest by inner product among all other rows of the same length, ties to the smaller id.

    Unusable vectors (null, empty, zero, or with a null or non-finite component) and rows with a null id take no
    part; fewer candidates than k give them all; an empty table gives an
    empty table. vec_id must be whole numbers; rows with equal ids count as one, whichever is smaller. Extra
    columns are ignored. visits: adds a column of this name, how many vectors were verified for the query.

    Vectors are dealt by length, class of norms, and cell: a kd-tree over a sample of at most `sample` projected points (it
    decides who lies where, not who is found) splits each class into cells of about shard_rows. A cell that is larger is
    parted by hash, so no task holds more. Each query is first searched in the shard it lies in; with the k-th best
    found there it visits only those other shards whose boxes the test cannot rule out, at most block_rows queries in a task.
    """
    stop = chi_square_quantile(sure, m)
    good = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = cut(good.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm")), "vectors")
    top = cut(good.groupBy("dim").agg(F.max("norm").alias("top")), "lengths")
    small = F.broadcast if top.count() <= 100_000 else (lambda d: d)  # tables of lengths, at most 16 rows each; where these are many they are joined
    good = good.join(small(top), "dim").select("vec_id", "v", "dim", "norm", F.least(F.floor(F.log2(F.col("top") / F.col("norm")) * 2), F.lit(15)).cast("int").alias("class"))
    groups = good.groupBy("dim", "class").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    groups = cut(groups.withColumn("cells", F.ceil(F.col("n") / shard_rows).cast("int")), "groups")
    good = cut(good.join(small(groups.select("dim", "class", "longest", "cells")), ["dim", "class"]), "vectors")

    lay = lambda column: np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=float).reshape(len(column), -1)
    # cells: the tops of the kd-trees, from a share of each class that needs more than one
    large = good.where("cells > 1")
    rows = large.count()
    trees: dict[tuple[int, int], KdTree] = {}
    if rows:
        share = min(1.0, sample / rows)
        few = large.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30) * 0.9))).limit(sample).toArrow()
        keys = list(zip(few["dim"].to_pylist(), few["class"].to_pylist(), strict=True))
        for key in dict.fromkeys(keys):
            own = few.filter(pa.array([x == key for x in keys]))
            points = project(lay(own["v"]), own["longest"][0].as_py(), m, seed)
            trees[key] = KdTree(points, leaf=max(16, -(-len(own) // own["cells"][0].as_py())), cells=True)
    shared = embeddings.sparkSession.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            dims, classes, longest = (batch.column(i).to_numpy() for i in (0, 1, 3))
            cell = np.zeros(len(dims), np.int32)
            for key in set(zip(dims.tolist(), classes.tolist(), strict=True)):
                if key in shared.value:
                    own = np.flatnonzero((dims == key[0]) & (classes == key[1]))
                    cell[own] = shared.value[key].leaf_of(project(lay(batch.column(2).take(pa.array(own))), float(longest[own[0]]), m, seed))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(cell)], ["dim", "class", "v", "longest", "vec_id", "cell"])

    cells = good.select("dim", "class", "v", "longest", "vec_id").mapInArrow(deal, "dim int, class int, v array<double>, longest double, vec_id long, cell int")
    cells = cut(cells, "cells")
    parts = cells.groupBy("dim", "class", "cell").agg(F.ceil(F.count("*") / shard_rows / 1.5).cast("int").alias("parts"))
    shard = ["dim", "class", "cell", "part"]
    dealt = cells.join(parts, ["dim", "class", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def results(found: list[tuple]) -> dict:
        """Columns of what was found: for each query a row without vec_id that says how many were verified, then its vectors."""
        query, times = np.array([f[0] for f in found], np.int64), np.array([len(f[1]) for f in found], np.int64)
        flat = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0)
        ids = pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(flat(1), pa.int64())])
        score = pa.concat_arrays([pa.nulls(len(found), pa.float64()), pa.array(flat(2), pa.float64())])
        return {"query_id": pa.array(np.r_[query, np.repeat(query, times)]), "vec_id": ids, "score": score, "seen": pa.array(np.r_[np.array([f[3] for f in found], np.int64), np.zeros(times.sum(), np.int64)])}

    def at_home(table: pa.Table) -> pa.Table:
        x, ids, longest = lay(table["v"]), table["vec_id"].to_numpy(), table["longest"][0].as_py()
        asked = np.flatnonzero(ids % every == 0)
        found = []
        if len(asked):
            own = Shard(x, ids, longest, m, seed)
            for i, p in zip(asked, project_queries(x[asked], longest, m, seed), strict=True):
                found.append((ids[i], *own.search(x[i], ids[i], p, -math.inf, k, stop)))
        out, home = results(found), [table[c][0].as_py() for c in shard]
        bound = np.array([f[2][k - 1] if len(f[2]) >= k else -math.inf for f in found], float)
        n = len(out["query_id"])
        bound = pa.array(np.r_[bound, np.full(n - len(found), np.nan)], pa.float64(), from_pandas=True)
        return pa.table({**out, "bound": bound, **{c: pa.array([h] * n, pa.int32()) for c, h in zip(shard, home, strict=True)}})

    first = cut(dealt.groupBy(*shard).applyInArrow(at_home, "query_id long, vec_id long, score double, seen long, bound double, dim int, class int, cell int, part int"), "home")

    def visit(batches):
        for batch in batches:
            dims, classes, longest, norms, bound = (batch.column(i).to_numpy() for i in range(5))
            row, cell = [], []
            for key in set(zip(dims.tolist(), classes.tolist(), strict=True)):
                own = np.flatnonzero((dims == key[0]) & (classes == key[1]))
                top = float(longest[own[0]])
                limit = np.where(np.isfinite(bound[own]), reach(np.where(np.isfinite(bound[own]), bound[own], 0.0), norms[own], top, stop), np.inf)
                tree = shared.value.get(key)
                if tree is None:
                    own = own[limit >= 0]
                    row.append(own)
                    cell.append(np.zeros(len(own), np.int64))
                    continue
                for i, p, far in zip(own, project_queries(lay(batch.column(5).take(pa.array(own))), top, m, seed), limit, strict=True):
                    c = np.flatnonzero(tree.distances(p) <= far)
                    row.append(np.full(len(c), i))
                    cell.append(c)
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1, 4, 5, 6, 7, 8, 9)), pa.array(np.concatenate(cell) if row else [], pa.int32())], ["dim", "class", "bound", "v", "query_id", "home_class", "home_cell", "home_part", "cell"])

    bounds = first.where("vec_id is null").select("query_id", "bound", *(F.col(c).alias(f"home_{c}") for c in shard[1:]))
    asking = good.select("vec_id", "v", "dim", "norm").where(F.col("vec_id") % every == 0).join(bounds, F.col("vec_id") == F.col("query_id"))
    asking = asking.join(small(groups.select("dim", "class", "longest")), "dim").select("dim", "class", "longest", "norm", "bound", "v", "query_id", "home_class", "home_cell", "home_part")
    asking = asking.mapInArrow(visit, "dim int, class int, bound double, v array<double>, query_id long, home_class int, home_cell int, home_part int, cell int")
    asking = asking.join(parts, ["dim", "class", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = cut(asking.where("not (class = home_class and cell = home_cell and part = home_part)").select(*shard, "query_id", "v", "bound"), "visits")
    blocks = asking.groupBy(*shard).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    there = dealt.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*shard, "block", "vec_id", "v", "longest")
    asking = asking.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select(*shard, "block", "query_id", "v", "bound")

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            own = Shard(lay(left["v"]), left["vec_id"].to_numpy(), left["longest"][0].as_py(), m, seed)
            q = lay(right["v"])
            for x, qid, p, b in zip(q, right["query_id"].to_numpy(), project_queries(q, own.longest, m, seed), right["bound"].to_numpy(), strict=True):
                found.append((qid, *own.search(x, qid, p, b, k, stop)))
        return pa.table(results(found))

    more = there.groupBy(*shard, "block").cogroup(asking.groupBy(*shard, "block")).applyInArrow(elsewhere, "query_id long, vec_id long, score double, seen long")
    found = first.select("query_id", "vec_id", "score", "seen").unionByName(more)
    if visits:
        found = cut(found, "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = found.where("vec_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return out.join(found.groupBy("query_id").agg(F.sum("seen").alias(visits)), "query_id") if visits else out
