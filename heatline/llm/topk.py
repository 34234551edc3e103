"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors are turned into integers first. Queries are a stated set and go through in blocks of BLOCK, so what is sent to
the tasks has a fixed size; for each block every task reads its share of all rows, in batches of BATCH. The queries of a
block have a cover tree for each TREE of them, and each batch of candidates has one.

A cover tree (Beygelzimer et al. 2006) has nested nets of its points: those of level i are more than scale/2^i apart, and
every point is within scale/2^i of one of them. Its nodes are the points of a level, each under the nearest point of the
level above, with the largest distance to any point below as radius. Query nodes are visited from the root down to
groups of at most GROUP queries. For a query node q of radius r, no point under a node c of radius s scores more than
q.c + |q| s + |c| r + r s, so a pair of nodes whose bound is under the worst kth score of the node's queries is skipped.
Within a group each query's own bound, q.c + |q| s, is held against its own kth score, level by level.

The kth scores start from a bounded sample of candidates (SAMPLE rows): these are real candidates, so each bound is a
true one. All rows are searched; the sample only lets pruning start early. Each task returns at most k rows for a query,
and the k best of these per query are kept by a window.

Products of doubles are exact here: rows with a part too large for that are compared in Python's integers instead, and
scores that don't fit into 64 bits count as the nearest number that does.

Vectors that are null, empty or hold null or non-finite parts take no part, nor do rows with a null id. A query meets
only candidates of its own length. Of rows that repeat a query's id, one stands for the query (all of them, if their
vectors differ, would be one query with several vectors: the first by vector is taken); none is its candidate. Other
repeated ids are candidates each. Ties go to the smaller id. Empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, TREE, BATCH, GROUP, SAMPLE = 32_768, 4096, 2048, 64, 2048
#: Candidates that a task gathers before it keeps the best of them.
WAITING = 1_000_000
_MOST, _LEAST = 2**63 - 1, -(2**63)


class CoverTree:
    """Cover tree of the rows of x (integers as doubles).

    first[p]: the level where row p enters the nets; len(scales) for rows equal to a point in them. parent[p]: the point
    above it, one level up. below[i]: rows by their node of level i; radius[i][p]: of the node of p there."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        square = (x * x).sum(1)
        far = np.sqrt(np.maximum(square[:, None] + square - 2 * (x @ x.T), 0))
        self.x, self.norm = x, np.sqrt(square)
        self.first, self.parent = np.full(n, -1), np.zeros(n, np.int64)
        gap, near = far[0].copy(), np.zeros(n, np.int64)
        self.first[0], self.scales = 0, [float(gap.max())]
        while gap.max() > 0:
            scale, level = self.scales[-1] / 2, len(self.scales)
            if gap.max() <= scale:  # no new point at this level
                self.scales[-1] = scale
                continue
            above = near.copy()
            for p in (gap > scale).nonzero()[0]:  # points of a level are apart from all others of it
                if gap[p] > scale:
                    self.first[p], self.parent[p] = level, above[p]
                    closer = far[p] < gap
                    gap[closer], near[closer] = far[p][closer], p
            self.scales.append(scale)
        same = self.first < 0
        self.first[same], self.parent[same] = len(self.scales), near[same]
        node, self.below, self.radius = np.where(same, self.parent, np.arange(n)), [], []
        for level in range(len(self.scales) - 1, -1, -1):
            node = np.where(self.first[node] > level, self.parent[node], node)
            radius = np.zeros(n)
            np.maximum.at(radius, node, far[node, np.arange(n)])
            self.below.append(node)
            self.radius.append(radius * (1 + 1e-9))
        self.below.reverse()
        self.radius.reverse()

    def entering(self, level: int) -> np.ndarray:
        """The rows that enter at a level, with their parent's level above it; rows equal to a point enter last."""
        return (self.first == level).nonzero()[0]


class Group:
    """A node of the query tree: rows, the norm of its point and its radius; nodes of at most GROUP rows have no kids."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.rows, self.center, self.kids = rows, x[rows[0]], []
        self.norm = float(np.linalg.norm(self.center))
        self.radius = float(np.sqrt(((x[rows] - self.center) ** 2).sum(1).max())) * (1 + 1e-9)


def groups(tree: CoverTree, most: int) -> Group:
    """The nodes of a cover tree down to groups of at most `most` rows; small sisters share a group."""

    def node(rows: np.ndarray, level: int) -> Group:
        made = Group(tree.x, rows)
        if len(rows) > most:
            if level < len(tree.scales):
                order = np.argsort(tree.below[level][rows], kind="stable")
                rows, starts = rows[order], np.unique(tree.below[level][rows][order], return_index=True)[1]
            else:
                starts = np.arange(0, len(rows), most)  # equal rows
            parts: list[list[np.ndarray]] = []
            for part in np.split(rows, starts[1:]):
                if parts and sum(map(len, parts[-1])) + len(part) <= most:
                    parts[-1].append(part)
                else:
                    parts.append([part])
            made.kids = [node(np.concatenate(p), level + 1) for p in parts]
        return made

    return node(np.arange(len(tree.x)), 1)


class Best:
    """The k best candidates of each query so far, by score and then smaller id; least: what a candidate has to reach."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.query, self.score, self.of = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), float(_LEAST)) if least is None else least.copy()
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compared = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: of each of the rows (of queries) with each of the ids."""
        self.compared += scores.size
        if scores.shape[1] > self.k and self.least[rows].min() <= _LEAST:  # a first bound: the kth of these
            others = np.where(self.ids[rows][:, None] == ids, float(_LEAST), scores)
            self.least[rows] = np.maximum(self.least[rows], np.partition(others, -self.k, axis=1)[:, -self.k])
        q, c = (scores >= self.least[rows][:, None]).nonzero()
        own = self.ids[rows[q]] != ids[c]
        q, c = q[own], c[own]
        self.waiting.append((rows[q], scores[q, c].astype(np.int64), ids[c]))
        if sum(len(w[0]) for w in self.waiting) > WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        q, s, i = (np.concatenate(x) for x in zip((self.query, self.score, self.of), *self.waiting))
        self.waiting = []
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.searchsorted(q, q)
        keep = np.arange(len(q)) - starts < self.k
        self.query, self.score, self.of = q[keep], s[keep], i[keep]
        last = (np.arange(len(q)) - starts) == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def search(queries: np.ndarray, top: Group, tree: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Adds the tree's rows to the queries' best."""
    norms = np.sqrt((queries * queries).sum(1))
    entering = [tree.entering(level) for level in range(len(tree.scales) + 1)]

    def under(points: np.ndarray, level: int) -> np.ndarray:
        """The rows that enter at a level under points of the level above."""
        marked = np.zeros(len(tree.x), bool)
        marked[points] = True
        return entering[level][marked[tree.parent[entering[level]]]]

    def scan(group: Group, level: int, points: np.ndarray) -> None:
        x, norm = queries[group.rows], norms[group.rows][:, None]
        scores = x @ tree.x[points].T
        best.add(group.rows, ids[points], scores)
        while level <= len(tree.scales) - 1 and len(points):
            radius = tree.radius[level][points]
            reach = scores + norm * radius + 1e-6 * (1 + np.abs(scores))
            keep = (reach >= best.least[group.rows][:, None]).any(0)
            points, scores, level = points[keep], scores[:, keep], level + 1
            new = under(points, level)
            if len(new):
                more = x @ tree.x[new].T
                best.add(group.rows, ids[new], more)
                points, scores = np.concatenate([points, new]), np.hstack([scores, more])

    todo = [(top, 0, np.zeros(1, np.int64))]
    while todo:
        group, level, points = todo.pop()
        radius = tree.radius[level][points]
        bound = tree.x[points] @ group.center + group.norm * radius + group.radius * (tree.norm[points] + radius)
        points = points[bound + 1e-6 * (1 + np.abs(bound)) >= best.least[group.rows].min()]
        if not len(points):
            continue
        if not group.kids:
            scan(group, level, points)
            continue
        if level + 1 < len(tree.scales) and tree.radius[level][points].max() > group.radius:
            level += 1
            points = np.concatenate([points, under(points, level)])
        todo += [(kid, level, points) for kid in reversed(group.kids)]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows in Python's integers, held within 64 bits."""
    whole = [[int(v) for v in row] for row in b]
    return np.array([[max(_LEAST, min(_MOST, sum(p * q for p, q in zip(map(int, row), other)))) for other in whole] for row in a], np.int64).reshape(len(a), len(b))


def plain(x: np.ndarray) -> np.ndarray:
    """Rows whose products with each other are exact in doubles."""
    return np.abs(x).max(1) <= np.sqrt(2.0**53 / x.shape[1]) if len(x) else np.zeros(0, bool)


class Searcher:
    """A block of queries with their trees; add() takes candidates in batches."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None, group: int = GROUP):
        small = plain(x)
        self.ids, self.x, self.rows = ids, x, small.nonzero()[0]
        self.large, self.best = (~small).nonzero()[0], Best(ids, k, least)
        self.tops = []
        for at in range(0, len(self.rows), TREE):
            part = self.rows[at : at + TREE]
            self.tops.append(groups(CoverTree(x[part]), group))
            todo = self.tops[-1:]
            while todo:  # rows of the block instead of rows of the tree
                one = todo.pop()
                one.rows = part[one.rows]
                todo += one.kids

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        small = plain(x)
        if len(self.rows) and small.any():
            tree = CoverTree(x[small])
            for top in self.tops:
                search(self.x, top, tree, ids[small], self.best)
        if len(self.rows) and not small.all():
            self.best.add(self.rows, ids[~small], _exact(self.x[self.rows], x[~small]))
        if len(self.large):
            self.best.add(self.large, ids, _exact(self.x[self.large], x))
        self.best.settle()


def whole(column: Column, scale: int = 64) -> Column:
    """scale * x of each part of a vector as doubles; null where the vector takes no part."""
    doubles = F.transform(column.cast("array<double>"), lambda x: x * scale)
    ok = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok & (F.size(doubles) > 0), doubles)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its k best among the other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col)).alias("v")).filter("id is not null and v is not null").withColumn("w", F.size("v"))
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("w", F.size("v"))
    out = None
    for width, n in sorted(map(tuple, asked.groupBy("w").count().collect())):
        blocks = -(-n // block)
        own = rows.filter(F.col("w") == width).select("id", "v")
        part = min(1.0, 4 * SAMPLE / max(1, own.count()))  # a range of hashes first, so that few rows are sent
        sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(2**40)) <= int(part * 2**40)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        for b in range(blocks):
            part = asked.filter((F.col("w") == width) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b)).select("id", "v").toArrow()
            if not part.num_rows:
                continue
            first = Searcher(part["id"].to_numpy(), _matrix(part["v"].combine_chunks(), width), k)
            first.add(sample["id"].to_numpy(), _matrix(sample["v"].combine_chunks(), width))
            sent = spark.sparkContext.broadcast((first, first.best.least))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
                searcher, least = sent.value
                searcher.best = best = Best(searcher.ids, k, least)  # the broadcast value is shared by tasks of a worker
                ids, vs = [], []
                for batch in batches:
                    for at in range(0, batch.num_rows, BATCH):
                        part = batch.slice(at, BATCH)
                        ids.append(part.column(0).to_numpy())
                        vs.append(_matrix(part.column(1), width))
                        if sum(map(len, ids)) >= BATCH:
                            searcher.add(np.concatenate(ids), np.concatenate(vs))
                            ids, vs = [], []
                if ids:
                    searcher.add(np.concatenate(ids), np.concatenate(vs))
                q = searcher.ids[best.query]
                for at in range(0, len(q), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (q, best.of, best.score)], ["query_id", "id", "score"])

            found = own.mapInArrow(run, "query_id long, id long, score long")
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
