"""Near-duplicate embeddings by dual traversal of cover trees.

Only vectors of one label are compared. Vectors are scaled to length 1 in double precision, where cosine c is chord
sqrt(2 - 2c). Equal vectors are one class from the start and their copies are never expanded. A label's classes are dealt
into cells: the nearest of DIRECTIONS fixed unit vectors, and within it blocks of about BLOCK vectors, so that no task
holds more than two blocks. Each block gets its cover tree once (nested levels whose radii halve; the centres of a level within
a node are further apart than its radius), which is stored with its points. Pairs are pruned from the top: first cells, then
blocks of cells that may meet, both by centres and covering radii, before any vector moves; then the trees of two blocks are
walked together, level by level: a pair of nodes is dropped when the distance of their centres exceeds both covering radii and
the threshold. Pairs of leaves are compared directly.

What a task gives is linear in its vectors: for each the number of vectors it links with, and a forest of links that joins
what is connected. Vectors far apart in many dimensions leave little to prune; a label of n vectors then costs n^2
multiplications in blocks, and n^2 / BLOCK vectors are moved.

Vectors that are null, of length 0 or hold null or non-finite numbers link with nothing, nor do those without a label. Vectors
of different dimensions don't link. Rows that repeat an identifier are copies of a node; ties go to the smaller identifier.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import cut, ship

BLOCK, DIRECTIONS, LEAF, SEED = 2_048, 32, 64, 11
SLACK = 1e-9  # distances are rounded; pruning allows for it, comparing does not


class CoverTree:
    """Levels of nodes over points on the unit sphere; node: centre, covering radius, points, children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        centres, radii = [], []

        def node(centre: int, members: np.ndarray) -> int:
            self.members.append(members)
            self.children.append([])
            centres.append(centre)
            radii.append(float(np.sqrt(np.maximum(0, 2 - 2 * (points[members] @ points[centre]))).max()))
            return len(centres) - 1

        self.root = node(0, np.arange(len(points)))
        todo = [(self.root, 1.0)]
        while todo:
            k, radius = todo.pop()
            members = self.members[k]
            if len(members) <= leaf or radii[k] == 0 or radius < 1e-3:
                continue
            if radii[k] <= radius:  # nothing to split at this level
                todo.append((k, radius / 2))
                continue
            rest, centre = members, centres[k]  # nested: a node's centre is its first child's
            single = []
            while len(rest):
                near = np.maximum(0, 2 - 2 * (points[rest] @ points[centre])) <= radius * radius
                near[rest == centre] = True
                own = rest[near]
                if len(own) > 1:
                    child = node(centre, own)
                    self.children[k].append(child)
                    todo.append((child, radius / 2))
                else:
                    single.append(own[0])
                rest = rest[~near]
                centre = rest[0] if len(rest) else -1
            for i in range(0, len(single), leaf):  # points alone at this level share leaves
                own = np.array(single[i : i + leaf])
                self.children[k].append(node(int(own[0]), own))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def stored(self) -> bytes:
        """All but the points."""
        return pickle.dumps((self.members, self.children, self.centres, self.radii, self.root))

    @classmethod
    def read(cls, points: np.ndarray, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.points = points
        tree.members, tree.children, tree.centres, tree.radii, tree.root = pickle.loads(data)
        return tree


def dual_pairs(a: CoverTree, b: CoverTree, chord: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points of a and of b to be compared; with same, each unordered pair of leaves once."""
    todo = [(a.root, b.root)]
    while todo:
        x, y = np.array(todo).T
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.points[a.centres[x]], b.points[b.centres[y]])))
        near = gap <= a.radii[x] + b.radii[y] + chord + SLACK
        todo = []
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            left, right = a.children[i], b.children[j]
            if not left and not right:
                yield a.members[i], b.members[j]
            elif same and i == j:
                todo += [(p, q) for n, p in enumerate(left) for q in left[n:]]
            elif left and (not right or a.radii[i] >= b.radii[j]):
                todo += [(p, j) for p in left]
            else:
                todo += [(i, q) for q in right]


def linked(one: CoverTree, other: CoverTree | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (places in one, places in the other) at the threshold; without other, pairs of one with the first place smaller."""
    chord = float(np.sqrt(2 - 2 * cosine))
    two = other or one
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in dual_pairs(one, two, chord, other is None):
        i, j = np.nonzero(one.points[p] @ two.points[q].T >= cosine)
        i, j = p[i], q[j]
        if other is None:
            keep = i != j
            i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
        rows.append(i)
        columns.append(j)
    i, j = np.concatenate(rows), np.concatenate(columns)
    if other is None and len(i):  # a leaf against itself gives both orders
        n = len(one.points)
        i, j = np.divmod(np.unique(i * n + j), n)
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the pairs (i, j) join, fewer than n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _directions(dim: int) -> np.ndarray:
    d = np.random.default_rng(SEED).normal(size=(DIRECTIONS, dim))
    return d / np.linalg.norm(d, axis=1)[:, None]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest direction of each class's vector."""
    for batch in batches:
        cell = np.zeros(batch.num_rows, np.int32)
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            cell[at] = (_matrix(batch.column("v").take(pa.array(at))) @ _directions(int(d)).T).argmax(axis=1)
        yield batch.append_column("cell", pa.array(cell))


def _block(table: pa.Table) -> pa.Table:
    """One row: the block's ball, and its points with their tree."""
    table = table.sort_by("rep")
    m = _matrix(table["v"].combine_chunks())
    mean = m.mean(axis=0)
    centre = mean / (np.linalg.norm(mean) or 1.0)
    radius = float(np.sqrt(np.maximum(0, np.einsum("ij,ij->i", m - centre, m - centre))).max())
    facts = {c: table.slice(0, 1)[c] for c in ("block", "label", "dim", "cell")}
    numbers = {c: pa.array([table[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("rep", "copies")}
    return pa.table({**facts, "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], **numbers, "points": pa.array([m.tobytes()], pa.binary()), "tree": pa.array([CoverTree(m).stored()], pa.binary())})


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("side").to_pylist()
        reps, copies = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("rep", "copies"))
        trees = [CoverTree.read(np.frombuffer(r["points"]).reshape(-1, r["dim"]), r["tree"]) for r in rows]
        i, j = linked(trees[0], trees[1] if len(trees) > 1 else None, cosine)
        if len(trees) > 1:
            j = j + len(trees[0].points)
        links = np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))
        joins = forest(len(reps), i, j)
        some = np.flatnonzero(links)
        n = [None] * len(joins)
        return pa.table(
            {
                "a": pa.array([*reps[some].tolist(), *(int(reps[x]) for x, _ in joins)], pa.int64()),
                "b": pa.array([*[None] * len(some), *(int(reps[y]) for _, y in joins)], pa.int64()),
                "links": pa.array([*links[some].astype(int).tolist(), *n], pa.int64()),
            }
        )

    return run


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _meeting(balls: DataFrame, key: str, chord: float, within: DataFrame | None = None) -> DataFrame:
    """(one, two), one <= two, of balls of one label and dimension that the threshold may join; of `within`'s pairs of cells only, if it is given."""
    side = lambda n: balls.select("label", "dim", F.col("cell").alias(f"cell{n}"), F.col(key).alias(n), F.col("centre").alias(f"centre{n}"), F.col("radius").alias(f"radius{n}"))
    if within is None:
        pairs = side("one").join(side("two"), ["label", "dim"])
    else:
        pairs = within.join(side("one"), ["label", "dim", "cellone"]).join(side("two"), ["label", "dim", "celltwo"])
    near = _distance("centreone", "centretwo") <= F.col("radiusone") + F.col("radiustwo") + chord + SLACK
    return pairs.filter(near & ((F.col("one") <= F.col("two")) if within is None else (F.col("cellone") != F.col("celltwo")) | (F.col("one") <= F.col("two"))))


def block_pairs(balls: DataFrame, chord: float) -> DataFrame:
    """(block1, block2) of blocks that the threshold may join: a cell's ball covers the balls of its blocks, and only blocks of cells that meet are
    looked at."""
    first = balls.groupBy("label", "dim", "cell").agg(F.min_by("centre", "block").alias("middle"))
    cells = balls.join(first, ["label", "dim", "cell"]).groupBy("label", "dim", "cell", "middle").agg(F.max(_distance("middle", "centre") + F.col("radius")).alias("radius"))
    cells = cut(cells.withColumnRenamed("middle", "centre"), "cells")
    within = _meeting(cells, "cell", chord).select("label", "dim", "cellone", "celltwo")
    return _meeting(balls, "block", chord, within).select(F.col("one").alias("block1"), F.col("two").alias("block2"))


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id (long), n_links, component, kept (id = component)."""
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    # -0.0 and 0.0 are equal as group keys, and give equal cosines.
    classes = rows.filter(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("dim", F.size("v")).mapInArrow(_cells, "label {0}, v array<double>, rep long, copies long, dim int, cell int".format(rows.schema["label"].dataType.simpleString())), "vectors")
    counts = classes.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    dealt = classes.join(counts, ["label", "dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
    # Small cells of a label go together, up to a block's size on average.
    totals = counts.groupBy("label", "dim").agg(F.sum("n").alias("all"))
    dealt = dealt.join(totals, ["label", "dim"]).withColumn("cell", F.pmod("cell", F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK))))
    dealt = dealt.withColumn("block", F.xxhash64("label", "dim", "cell", F.when(F.col("n") > BLOCK, F.col("salt")))).select("block", "label", "dim", "cell", "rep", "copies", "v")
    kind = rows.schema["label"].dataType.simpleString()
    blocks = cut(dealt.groupBy("block").applyInArrow(_block, f"block long, label {kind}, dim int, cell long, centre array<double>, radius double, rep binary, copies binary, points binary, tree binary"), "blocks")
    pairs = cut(block_pairs(blocks.select("block", "label", "dim", "cell", "centre", "radius"), float(np.sqrt(2 - 2 * cosine))), "block-pairs")
    tasks = pairs.select("block1", "block2", F.explode(F.when(F.col("block1") == F.col("block2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sent = tasks.withColumn("block", F.when(F.col("side") == 0, F.col("block1")).otherwise(F.col("block2"))).join(blocks.select("block", "dim", "rep", "copies", "points", "tree"), "block")
    found = cut(sent.groupBy("block1", "block2").applyInArrow(_compare(cosine), "a long, b long, links long"), "vector-links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b"))
    facts = classes.select("label", "v", "rep", "copies").join(links, F.col("rep") == links["a"], "left").join(joined, F.col("rep") == joined["node"], "left")
    facts = facts.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    keyed = rows.withColumn("usable", usable)
    here = keyed.filter("usable").join(facts, ["label", "v"]).select("id", "n_links", "component")
    alone = keyed.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return here.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
