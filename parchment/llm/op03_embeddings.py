"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are dealt into cells, each around a pivot; a vector visits as a guest those earlier cells
into which a link may lead (links are shorter than `eps`, so it must lie within eps of the plane between
the two pivots). In each cell cover trees are built, nested levels whose radii halve, and traversed two at
a time: a pair of nodes ends when the distance of their centres less both covering radii exceeds eps (no
link), or that distance plus both radii stays within it (all linked, counted without listing them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.shared import components, cut
from parchment.llm.vectors import usable

SLACK = 1e-9


class Node:
    __slots__ = ("at", "children", "far", "own")

    def __init__(self, at: int, own: np.ndarray, far: float, children: list[Node]):
        self.at, self.own, self.far, self.children = at, own, far, children


def cover_tree(x: np.ndarray, least: float) -> Node | None:
    """Over unit vectors x. A node covers `own` (indices), all within `far` of its centre `at`; the centres of its
    children are more than half its level's radius apart and its first child has its own centre. Nodes of radius up to
    `least` keep their vectors in one leaf."""

    def build(own: np.ndarray, dist: np.ndarray, radius: float) -> Node:
        far = float(dist.max(initial=0.0))
        if len(own) == 1 or radius <= least:
            return Node(int(own[0]), own, far, [])
        radius /= 2
        if far <= radius:  # this level has one node, the next one is looked at at once
            return build(own, dist, radius)
        children, left, d = [], own, dist
        while len(left):
            near = d <= radius
            near[0] = True
            children.append(build(left[near], d[near], radius))
            left = left[~near]
            if len(left):
                centre = left[0]
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[left] @ x[centre])))
                d[0] = 0.0
        return Node(int(own[0]), own, far, children)

    if not len(x):
        return None
    own = np.arange(len(x))
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[0])))
    d[0] = 0.0
    return build(own, d, 2.0)


class Links:
    """Counts of links per vector and a spanning set of them."""

    def __init__(self, times: np.ndarray):
        self.times, self.count, self.edges, self.size = times, np.zeros(len(times), np.int64), [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.edges.append(np.stack([u, v]))
        self.size += len(u)
        if self.size > 2_000_000:
            self.edges = [self.spanning()]
            self.size = self.edges[0].shape[1]

    def spanning(self) -> np.ndarray:
        """Edges (vector, smallest index of its component)."""
        if not self.edges:
            return np.zeros((2, 0), np.int64)
        u, v = np.concatenate(self.edges, axis=1)
        label = np.arange(len(self.times))
        while True:
            low = np.minimum(label[u], label[v])
            if (low == label[u]).all() and (low == label[v]).all():
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            label = np.minimum(label, label[label])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([moved, label[moved]])


def dual(x: np.ndarray, a: Node, b: Node, cosine: float, out: Links) -> None:
    """Links between the vectors of two trees over the same x, or within one tree where a is b."""
    eps = math.sqrt(2 - 2 * cosine)
    stack = [(a, b)]

    def all_linked(a: Node, b: Node) -> None:
        if a is b:
            if len(a.own) > 1:
                out.count[a.own] += out.times[a.own].sum() - out.times[a.own]
                out.add(a.own[1:], np.full(len(a.own) - 1, a.own[0]))
            return
        out.count[a.own] += out.times[b.own].sum()
        out.count[b.own] += out.times[a.own].sum()
        out.add(a.own, np.full(len(a.own), b.own[0]))
        out.add(b.own, np.full(len(b.own), a.own[0]))

    while stack:
        a, b = stack.pop()
        if a is b and 2 * a.far <= eps - SLACK:
            all_linked(a, b)
            continue
        if not a.children and not b.children:
            hit = x[a.own] @ x[b.own].T >= cosine
            if a is b:
                np.fill_diagonal(hit, False)
                out.count[a.own] += hit @ out.times[a.own]
            else:
                out.count[a.own] += hit @ out.times[b.own]
                out.count[b.own] += out.times[a.own] @ hit
            i, j = np.nonzero(hit)
            if len(i):
                out.add(a.own[i], b.own[j])
            continue
        left, right = a.children or [a], b.children or [b]
        at, bt = np.array([n.at for n in left]), np.array([n.at for n in right])
        fa, fb = np.array([n.far for n in left]), np.array([n.far for n in right])
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[at] @ x[bt].T)))
        radii = fa[:, None] + fb[None]
        near = d - radii <= eps + SLACK
        sure = d + radii <= eps - SLACK
        if a is b:
            near &= np.triu(np.ones_like(near))
            np.fill_diagonal(near, [len(n.own) > 1 for n in left])
            np.fill_diagonal(sure, False)
        # single vectors are settled here: their exact cosine decides
        lone = np.array([len(n.own) == 1 for n in left])[:, None] & np.array([len(n.own) == 1 for n in right])[None]
        exact = near & lone
        if exact.any():
            i, j = np.nonzero(exact)
            if a is b:
                i, j = i[i != j], j[i != j]
            hit = np.einsum("ij,ij->i", x[at[i]], x[bt[j]]) >= cosine
            u, v = at[i[hit]], bt[j[hit]]
            np.add.at(out.count, u, out.times[v])
            np.add.at(out.count, v, out.times[u])
            if len(u):
                out.add(u, v)
        for i, j in zip(*np.nonzero(near & ~lone), strict=True):
            if sure[i, j]:
                all_linked(left[i], right[j])
            else:
                stack.append((left[i], right[j]))


def pivots_of(rows: DataFrame, cell: int, most: int) -> dict[object, np.ndarray]:
    """Pivots of labels with more than two cells' worth of vectors: one for `cell` vectors, those with the smallest hash; at most
    `most` over all labels (a bounded, documented sample: it decides who compares where, never what is linked)."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell).withColumn("k", F.ceil(F.col("n") / cell).cast("int"))
    sizes = sizes.orderBy(F.desc("n"), "label").limit(most).collect()
    share = min(1.0, most / max(1, sum(r.k for r in sizes)))
    want = {r.label: max(1, int(r.k * share)) for r in sizes}
    if not want:
        return {}
    from pyspark.sql.window import Window

    # the few with the smallest hash are found by a bound on the hash first, so that no label is sorted as a whole
    bound = F.create_map(*(F.lit(v) for r in sizes for v in (r.label, float(min(1.0, 4.0 * want[r.label] / r.n + 64.0 / r.n)))))
    h = (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30))
    few = rows.where(F.col("label").isin(*want)).where(h < F.element_at(bound, F.col("label")))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(h, "vec_id")))
    need = F.create_map(*(F.lit(v) for k, n in want.items() for v in (k, n)))
    out: dict[object, list] = {}
    for r in few.where(F.col("r") <= F.element_at(need, F.col("label"))).orderBy("label", "r").select("label", "v").collect():
        out.setdefault(r.label, []).append(r.v)
    return {k: (p := np.array(v, dtype=float)) / np.linalg.norm(p, axis=1, keepdims=True) for k, v in out.items()}


def near_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, cell: int = 1_500, most_pivots: int = 8_192, part_rows: int = 4_000) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links long, component_id long, kept boolean.

    Vectors are compared only where labels (whole numbers or texts) are equal and not null, and only with those of their own length.
    Unusable vectors (null, empty, zero, or with a null or non-finite component) and rows with a null id link with nothing.
    Equal vectors of a label are one class with a count; they are linked with each other. vec_id must be whole
    numbers; an id that several rows have is one vertex: its rows get the largest number of links of their classes and the smallest component, where classes that
    have the same smallest id are counted together. Extra columns are ignored; an empty
    table gives an empty table. A cell of more than part_rows vectors and guests is split into parts that are compared
    two by two, so no task holds more than twice that.
    """
    ids = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    good = ids.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("v"))
    good = good.select("vec_id", F.concat_ws("/", F.size("v"), "label").alias("label"), F.transform("v", lambda x: x + 0).alias("v"))
    classes = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "classes")
    pivots = embeddings.sparkSession.sparkContext.broadcast(pivots_of(classes, cell, most_pivots))
    label_kind, vector_kind = classes.schema["label"].dataType.simpleString(), classes.schema["v"].dataType.simpleString()
    eps = math.sqrt(2 - 2 * cosine)

    def unit(column) -> np.ndarray:
        flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=float).reshape(len(column), -1)
        return flat / np.linalg.norm(flat, axis=1, keepdims=True)

    def deal(batches):
        for batch in batches:
            labels = batch.column(0).to_pylist()
            row, cells, home = [], [], []
            for key in set(labels):
                own = np.array([i for i, k in enumerate(labels) if k == key])
                p = pivots.value.get(key)
                if p is None or len(p) == 1:
                    row.append(own)
                    cells.append(np.zeros(len(own), np.int64))
                    home.append(np.ones(len(own), bool))
                    continue
                c = unit(batch.column(1).take(pa.array(own))) @ p.T
                nearest = c.argmax(1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p.T)))[nearest]
                reach = c.max(1)[:, None] - c <= eps * apart + SLACK
                # a link between two cells is found in the earlier one, which the vector of the later one visits
                reach &= np.arange(len(p))[None] <= nearest[:, None]
                reach[np.arange(len(own)), nearest] = True
                i, j = np.nonzero(reach)
                row.append(own[i])
                cells.append(j)
                home.append(nearest[i] == j)
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(4)), pa.array(np.concatenate(cells) if row else [], pa.int32()), pa.array(np.concatenate(home) if row else [], pa.bool_())], ["label", "v", "vec_id", "times", "cell", "home"])

    dealt = cut(classes.select("label", "v", "vec_id", "times").mapInArrow(deal, f"label {label_kind}, v {vector_kind}, vec_id long, times long, cell int, home boolean"), "cells")
    counts = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = dealt.join(counts, ["label", "cell"])
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(part, k).alias("i"), F.greatest(part, k).alias("j")))
    dealt = dealt.select("label", "cell", "v", "vec_id", "times", "home", part.alias("part"), F.explode(pairs).alias("pair")).select("label", "cell", "pair.i", "pair.j", "part", "v", "vec_id", "times", "home")

    def compare(table: pa.Table) -> pa.Table:
        x, ids, times = unit(table["v"]), table["vec_id"].to_numpy(), table["times"].to_numpy()
        home, parts = table["home"].to_numpy(), table["part"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        order = np.argsort(ids, kind="stable")
        x, ids, times, home, parts = x[order], ids[order], times[order], home[order], parts[order]
        out = Links(times)

        def tree(mask: np.ndarray) -> Node | None:
            at = np.flatnonzero(mask)
            root = cover_tree(x[at], eps / 8)
            todo = [root] if root else []
            while todo:
                n = todo.pop()
                n.own, n.at = at[n.own], int(at[n.at])
                todo += n.children
            return root

        homes = [tree(home & (parts == k)) for k in dict.fromkeys((i, j))]
        guests = [tree(~home & (parts == k)) for k in dict.fromkeys((i, j))]
        todo = [(homes[0], homes[0]), (homes[0], guests[0])] if i == j else [(homes[0], homes[1]), (homes[0], guests[1]), (homes[1], guests[0])]
        for a, b in todo:
            if a is not None and b is not None:
                dual(x, a, b, cosine, out)
        linked = out.spanning()
        root = np.arange(len(ids))
        root[linked[0]] = linked[1]
        some = np.flatnonzero(out.count > 0)
        return pa.table({"vec_id": ids[some], "n": out.count[some], "root": ids[root[some]]})

    found = cut(dealt.groupBy("label", "cell", "i", "j").applyInArrow(compare, "vec_id long, n long, root long"), "links")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = classes.join(links, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    classes = classes.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    members = good.select("vec_id", "label", "v").join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.select("vec_id").join(members, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
