"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits the vectors by hyperplanes between two random ones, at the
median, down to leaves.  A query visits the leaves of all trees in the order of one
shared priority queue: by how far the query lies, at most on the way, beyond the
hyperplanes that part it from a leaf.  The leaves' vectors are compared exactly.
How many leaves to visit is measured: as many as reach the target recall on a
sample of queries, whose true neighbours come from comparing them with all vectors.

A leaf is compared in one task as long as it is small; where many vectors or many
queries meet in one, both are dealt to parts, and each pair of parts is a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices, stored
from .words import mix

NEIGHBOURS, TREES, LEAF, RECALL = 10, 8, 1600, 0.94
#: Leaves of a tree, at most; for more vectors the leaves are larger and are dealt to several tasks.
MAX_LEAVES = 1 << 13
#: Vectors, and queries, of a leaf that meet in one task, about.
TASK_VECTORS = 20_000
#: Vectors that the hyperplanes are laid through, at least and for each leaf; queries that recall is measured on.
SAMPLE, SAMPLE_LEAF, PROBES = 20_000, 64, 400
#: Similarities that are held at once.
BLOCK = 4_000_000

#: Queries whose ways through the trees are followed at once.
ROWS = 512

RESULT = "vec_id long, neighbour_id long, similarity double, rank int"


@dataclass
class Forest:
    """For each tree and level: a matrix of normals and an array of offsets, one for each node of the level."""

    trees: list[list[tuple[np.ndarray, np.ndarray]]]

    @property
    def leaves(self) -> int:
        return 1 << len(self.trees[0])

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """(vector, tree) -> leaf."""
        out = np.zeros((len(v), len(self.trees)), np.int64)
        for t, levels in enumerate(self.trees):
            for normal, cut in levels:
                node = out[:, t]
                out[:, t] = 2 * node + (np.einsum("ij,ij->i", v, normal[node]) > cut[node])
        return out

    def order(self, v: np.ndarray, visits: int) -> np.ndarray:
        """(vector, visit) -> tree * leaves + leaf, the nearest first.

        The way to a nearer child costs nothing and to the other one its distance
        from the hyperplane; a leaf's cost is the highest on its way.  Costs never
        fall on the way down, so the ``visits`` best nodes of a level hold the best leaves.
        """
        if len(v) > ROWS:
            return np.concatenate([self.order(v[i : i + ROWS], visits) for i in range(0, len(v), ROWS)])
        places, costs = [], []
        for t, levels in enumerate(self.trees):
            node, cost = np.zeros((len(v), 1), np.int64), np.zeros((len(v), 1))
            for normal, cut in levels:
                if 4 * node.shape[1] > len(normal):
                    side = (v @ normal.T - cut)[np.arange(len(v))[:, None], node]
                else:
                    side = np.einsum("ij,ikj->ik", v, normal[node]) - cut[node]
                near = 2 * node + (side > 0)
                node, cost = np.concatenate([near, near ^ 1], 1), np.concatenate([cost, np.maximum(cost, np.abs(side))], 1)
                if node.shape[1] > visits:
                    keep = np.argpartition(cost, visits - 1, 1)[:, :visits]
                    node, cost = np.take_along_axis(node, keep, 1), np.take_along_axis(cost, keep, 1)
            places.append(node + t * self.leaves)
            costs.append(cost)
        place, cost = np.concatenate(places, 1), np.concatenate(costs, 1)
        best = np.lexsort((place, cost), axis=1)[:, :visits]
        return np.take_along_axis(place, best, 1)


def grow(sample: np.ndarray, levels: int, trees: int = TREES, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        node, tree = np.zeros(len(sample), np.int64), []
        for level in range(levels):
            normals, cuts = np.zeros((1 << level, sample.shape[1])), np.zeros(1 << level)
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
            side = np.zeros(len(sample), np.int64)
            for k in range(1 << level):
                own = order[ends[k] : ends[k + 1]]
                if len(own) < 2:
                    continue
                # Of some pairs of vectors, the one along which the node's vectors are spread the most.
                best = -1.0
                for _ in range(4):
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    d = a - b
                    d = d / (np.linalg.norm(d) or 1)
                    at = sample[own] @ d
                    if at.std() > best:
                        best, normals[k], cuts[k] = at.std(), d, np.median(at)
                side[own] = sample[own] @ normals[k] > cuts[k]
            tree.append((normals, cuts))
            node = 2 * node + side
        out.append(tree)
    return Forest(out)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    return (v / np.where(length > 0, length, 1)).astype(np.float32)


def top(similarity: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, highest first, lower ids first among equals, and their ids."""
    if similarity.shape[1] > 4 * k:
        least = -np.partition(-similarity, k - 1, 1)[:, k - 1 : k]
        # All that reach the k-th highest, so that ties are cut by id.
        width = int((similarity >= least).sum(1).max())
        keep = np.argpartition(-similarity, width - 1, 1)[:, :width]
        similarity, ids = np.take_along_axis(similarity, keep, 1), ids[keep]
    else:
        ids = np.broadcast_to(ids, similarity.shape)
    order = np.lexsort((ids, -similarity), axis=1)[:, :k]
    return np.take_along_axis(similarity, order, 1), np.take_along_axis(ids, order, 1)


def _compared(q_id, q, m_id, m, k, others=True):
    """Top k members for each query, blockwise; with ``others`` a query isn't its own neighbour."""
    for a, b in slices([max(1, len(m))] * len(q), BLOCK):
        # In double precision and rounded, so that a pair has one value wherever it is compared, and ties are ties.
        s = np.round(q[a:b].astype(np.float64) @ m.T.astype(np.float64), 9)
        if others:
            s[q_id[a:b, None] == m_id[None, :]] = -np.inf
        yield q_id[a:b], *top(s, m_id, k)


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, every: int = 1, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, max_leaves: int = MAX_LEAVES, task_vectors: int = TASK_VECTORS) -> DataFrame:
    """vec_id, neighbour_id, similarity (cosine), rank (from 1): of each query its k nearest others, as far as found.

    Queries are the vectors whose id is divisible by ``every``; they are compared with
    all vectors.  Left out are rows with a null id, and vectors that are
    null or empty, hold a null, NaN or infinity, or have another length than
    most.  A vector of zeros has similarity 0 with all.  Rows that repeat an id count
    once, with the lowest of their vectors.  Equal similarities go by the lower
    id.  Fewer than k others give fewer rows, no vectors give none; other columns are
    ignored.

    Search is approximate: on queries drawn by hash, visits are raised until the
    share of true neighbours among the candidates reaches ``recall``.  The
    hyperplanes are laid through a sample of max(SAMPLE, SAMPLE_LEAF * leaves) vectors;
    every vector is in the index.

    Equal vectors are searched for once: of theirs only the k + 1 lowest ids can be
    among anyone's k nearest, so that many are members of leaves, and all queries of
    a vector get its k + 1 nearest but themselves.
    """
    spark = vectors.sparkSession
    e = F.col("v")
    own = only(vectors, id=vec_id, v=embedding).select(F.col("id").cast("long").alias("id"), e.cast("array<float>").alias("v"))
    own = own.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    own = own.groupBy("id").agg(F.min("v").alias("v"))
    own = stored(own.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or sizes["count"] < 2:
        return spark.createDataFrame([], RESULT)
    n, d = sizes["count"], sizes["d"]
    own = own.where(F.size("v") == d)
    levels = int(np.clip(round(np.log2(max(1, n / leaf))), 0, np.log2(max_leaves)))
    drawn = own.select("id", "v").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(max(SAMPLE, SAMPLE_LEAF << levels)).toArrow()
    sample, sample_id = unit(_matrix(drawn.column("v"))), drawn.column("id").to_numpy()
    forest = grow(sample, levels, trees)
    probes = min(PROBES, len(sample))
    visits = _visits(own, forest, sample_id[:probes], sample[:probes], k, recall)
    shared = spark.sparkContext.broadcast(forest)
    leaves = forest.leaves
    # The limit of a group is applied before the shuffle too, so that a hot vector stays small.
    place = lambda df, most: df.withColumn("place", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("place") <= most)
    members = stored(place(own, k + 1).select(F.lit(True).alias("member"), "id", "v"))
    asked = own.where(F.col("id") % every == 0)
    heads = stored(place(asked, 1).select(F.lit(False).alias("member"), "id", "v"))
    both = members.unionByName(heads)

    def cells_of(member: bool, v: np.ndarray) -> np.ndarray:
        return shared.value.leaf_of(v) + np.arange(trees) * leaves if member else shared.value.order(v, visits)

    def count(batches):
        total = np.zeros((2, trees * leaves), np.int64)
        for role, _, v in _by_role(batches):
            total[int(role)] += np.bincount(cells_of(role, v).ravel(), minlength=trees * leaves)
        role, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(role.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[role, cell])], ["role", "cell", "n"])

    # One number for each role and leaf: at most 2 * trees * max_leaves.
    held = np.zeros((2, trees * leaves), np.int64)
    for r in both.mapInArrow(count, "role int, cell int, n long").groupBy("role", "cell").agg(F.sum("n").alias("n")).collect():
        held[r["role"], r["cell"]] = r["n"]
    parts = np.maximum(1, -(-held // task_vectors)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts[0] * parts[1])])
    task = spark.sparkContext.broadcast((parts, first))

    def send(batches):
        parts, first = task.value
        for role, ids, v in _by_role(batches):
            at = cells_of(role, v)
            row, cell = np.repeat(np.arange(len(ids)), at.shape[1]), at.ravel()
            # The part of a row among its own kind in the leaf, with each part of the other kind.
            mine = (mix(ids.astype(np.uint64)).astype(np.uint64)[row] % parts[int(role), cell].astype(np.uint64)).astype(np.int64)
            others = parts[1 - int(role), cell]
            row, cell, mine = (np.repeat(x, others) for x in (row, cell, mine))
            other = np.arange(len(row)) - np.repeat(np.cumsum(others) - others, others)
            to = first[cell] + (other * parts[1, cell] + mine if role else mine * parts[1, cell] + other)
            order = np.argsort(to, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
            for i, j in slices([len(g) * (4 * d + 8) for g in groups], 8 << 20):
                some = groups[i:j]
                yield pa.RecordBatch.from_arrays([pa.array([int(to[g[0]]) for g in some], pa.int64()), pa.array([bool(role)] * len(some)), pa.array([ids[row[g]].tobytes() for g in some], pa.binary()), pa.array([v[row[g]].tobytes() for g in some], pa.binary())], ["cell", "member", "ids", "v"])

    near = k + 1
    merge = max(1, n // every * visits * near // 2_000_000 + 1)

    def compare(key, t):
        role = t.column("member").to_numpy(zero_copy_only=False)
        side = []
        for want in (False, True):
            some = t.filter(pa.array(role == want))
            side += [np.frombuffer(b"".join(some.column("ids").to_pylist()), np.int64), np.frombuffer(b"".join(some.column("v").to_pylist()), np.float32).reshape(-1, d)]
        q_id, q, m_id, m = side
        rows: dict[str, list] = {"bucket": [], "packed": []}
        for own_id, s, found in _compared(q_id, q, m_id, m, near, False) if len(m_id) and len(q_id) else ():
            who = np.broadcast_to(own_id[:, None], s.shape).ravel()
            bucket = (mix(who.astype(np.uint64)) % np.uint64(merge)).astype(np.int64)
            s, found = s.ravel(), found.ravel()
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                rows["bucket"].append(int(bucket[part[0]]))
                rows["packed"].append(who[part].tobytes() + found[part].tobytes() + s[part].tobytes())
        return pa.table([pa.array(rows["bucket"], pa.int32()), pa.array(rows["packed"], pa.binary())], ["bucket", "packed"])

    def best(key, t):
        who, found, s = (np.concatenate(x) for x in zip(*((np.frombuffer(p, np.int64, len(p) // 24), np.frombuffer(p, np.int64, len(p) // 24, len(p) // 3), np.frombuffer(p, np.float64, len(p) // 24, 2 * len(p) // 3)) for p in t.column("packed").to_pylist())))
        # Trees may give the same neighbour, at the same similarity.
        order = np.lexsort((found, -s, who))
        who, found, s = who[order], found[order], s[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1])
        who, found, s = who[new], found[new], s[new]
        begin = np.flatnonzero(np.diff(who, prepend=who[0] - 1))
        rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who)))) + 1
        keep = rank <= near
        return pa.table({"head": who[keep], "neighbour_id": found[keep], "similarity": s[keep], "rank": rank[keep].astype(np.int32)})

    met = both.mapInArrow(send, "cell long, member boolean, ids binary, v binary").groupBy("cell").applyInArrow(compare, "bucket int, packed binary")
    found = met.groupBy("bucket").applyInArrow(best, "head long, neighbour_id long, similarity double, rank int")
    # The k + 1 nearest of each distinct query, in order; each query of that vector leaves itself out.
    lists = found.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id", "similarity"))).alias("near"))
    heads_of = heads.select("id").join(own.select("id", "h", "g"), "id").select(F.col("id").alias("head"), "h", "g")
    answered = asked.select("id", "h", "g").join(heads_of.join(lists, "head"), ["h", "g"])
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    out = answered.select(F.col("id").alias("vec_id"), F.posexplode(others).alias("pos", "x"))
    return out.select("vec_id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.similarity").alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank"))


def _by_role(batches):
    """(member, ids, unit vectors) of pieces of batches; the rows of a piece are all members, or all queries."""
    for b in batches:
        role = b.column("member").to_numpy(zero_copy_only=False)
        for want in (False, True):
            some = b.filter(pa.array(role == want))
            for i in range(0, some.num_rows, 4096):
                piece = some.slice(i, 4096)
                yield want, piece.column("id").to_numpy(), unit(_matrix(piece.column("v")))


def _visits(own: DataFrame, forest: Forest, q_id: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Least number of leaves to visit such that ``recall`` of the probes' true neighbours lie in them."""
    shared = own.sparkSession.sparkContext.broadcast((q_id, q))

    def run(batches):
        for b in batches:
            if b.num_rows:
                q_id, q = shared.value
                v = unit(_matrix(b.column("v")))
                for who, s, near in _compared(q_id, q, b.column("id").to_numpy(), v, k):
                    good = np.isfinite(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(who[:, None], s.shape)[good]), pa.array(near[good]), pa.array(s[good])], ["q", "near", "s"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "near"))
    true = own.mapInArrow(run, "q long, near long, s double").withColumn("rank", rank).where(F.col("rank") <= k).select("q", F.col("near").alias("id"))
    # At most probes * k rows: a bounded table, so a broadcast.
    found = own.join(F.broadcast(true), "id").select("q", "v").toArrow()
    if not found.num_rows:
        return 1
    total = len(forest.trees) * forest.leaves
    order = forest.order(q, total)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(total), order.shape), 1)
    sorter = np.argsort(q_id)
    row = sorter[np.searchsorted(q_id, found.column("q").to_numpy(), sorter=sorter)]
    leaf = forest.leaf_of(unit(_matrix(found.column("v")))) + np.arange(len(forest.trees)) * forest.leaves
    needed = np.sort(place[row[:, None], leaf].min(1)) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
