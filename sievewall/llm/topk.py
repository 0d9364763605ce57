"""Exact top-k by integer inner product: dual-tree search over cover trees, whose top level deals the vectors into cells."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, written

#: A query block and a data block meet in one task; vectors of each. Both are of one cell.
QUERY_BLOCK, DATA_BLOCK = 1024, 8192
#: Cells are the top level's centres: one for each data block's worth of vectors, up to so many, chosen from a sample of about so many.
MOST_CELLS, SAMPLE = 1024, 8192
#: Nodes of at most so many vectors are compared outright.
LEAF = 64


def spread_centres(points: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Centres farthest first, until `most` are chosen or all points are `within` of one: each point's centre, its distance, the centres' rows.

    The greatest distance that is left covers all points, and no two centres
    are nearer to each other than that.
    """
    distances = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    owner, centres = np.zeros(len(points), np.int64), [0]
    while len(centres) < most and distances.max() > within:
        far = int(distances.argmax())
        d = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = d < distances
        owner[closer], distances[closer] = len(centres), d[closer]
        centres.append(far)
    return owner, distances, centres


class CoverTree:
    """A cover tree over rows of a matrix, with their ids.

    A node's children are centres that cover its rows within a radius and are
    no nearer to each other than that. The radius is half the parent's, or,
    where that took more centres than a quarter of a leaf's worth of rows
    each, what so many centres cover. A node keeps its centre, the greatest
    distance from it to a row below, and its rows, which are consecutive in
    `order`.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.order = points, ids, np.arange(len(points))
        #: Of each node: the centre's row, its reach and norm, the first and last row in `order`, its children.
        self.nodes: list[tuple[int, float, float, int, int, list[int]]] = []
        pending = [(0, len(points), math.inf, -1)]
        while pending:
            first, last, radius, parent = pending.pop()
            rows = self.order[first:last]
            own = points[rows].astype(np.float64)
            reach = float(np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max())
            number = len(self.nodes)
            self.nodes.append((int(rows[0]), reach, float(np.sqrt((own[0] ** 2).sum())), first, last, []))
            if parent >= 0:
                self.nodes[parent][5].append(number)
            if last - first <= LEAF or reach == 0:
                continue
            radius = min(radius, reach) / 2
            owner, distances, centres = spread_centres(own, max(2, len(own) // (LEAF // 4)), radius)
            radius = max(radius, float(distances.max()))
            other = np.ones(len(own), bool)
            other[centres] = False
            sort = np.lexsort((other, owner))
            owner = owner[sort]
            self.order[first:last] = rows[sort]
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), last - first]
            pending += [(first + x, first + y, radius, number) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def packed(self) -> tuple:
        """The tree as plain arrays and lists, which any process can read."""
        return self.points, self.ids, self.order, self.nodes

    @classmethod
    def unpacked(cls, parts: tuple) -> CoverTree:
        tree = cls.__new__(cls)
        tree.points, tree.ids, tree.order, tree.nodes = parts
        return tree


class Best:
    """The k best of each query so far: higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[row, candidate]; candidates marked with the least integer are none."""
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        all_ids = np.where(all_scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, all_ids)
        order = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, order, axis=1)


def dual_search(q: CoverTree, d: CoverTree, k: int, at_least: np.ndarray | None = None) -> Best:
    """The k best rows of d for each row of q, rows of its own id left out.

    Pairs of nodes are taken in the order of their bound, the best first: no
    inner product below them exceeds the centres' plus what the covering radii
    allow. A pair is pruned if its bound is under the worst kth score in the
    query node, or under what each query is known to reach elsewhere.
    """
    best = Best(len(q.points), k)
    known = np.full(len(q.points), np.iinfo(np.int64).min, np.int64) if at_least is None else at_least
    q_centres, d_centres = (t.points[[n[0] for n in t.nodes]].astype(np.float64) for t in (q, d))

    def bound(a: int, b: int) -> float:
        _, qr, qn, *_ = q.nodes[a]
        _, dr, dn, *_ = d.nodes[b]
        return upper_bound(float(q_centres[a] @ d_centres[b]), qr, qn, dr, dn)

    def floor_of(a: int) -> int:
        rows = q.order[q.nodes[a][3] : q.nodes[a][4]]
        return int(np.maximum(best.scores[rows, -1], known[rows]).min())

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        limit, a, b = heapq.heappop(heap)
        if -limit < floor_of(a):
            continue
        qa, db = q.nodes[a], d.nodes[b]
        if not qa[5] and not db[5]:
            rows, cols = q.order[qa[3] : qa[4]], d.order[db[3] : db[4]]
            scores = q.points[rows] @ d.points[cols].T
            scores[q.ids[rows][:, None] == d.ids[cols][None, :]] = np.iinfo(np.int64).min
            best.offer(rows, scores, d.ids[cols])
            continue
        split_query = bool(qa[5]) and (not db[5] or qa[1] >= db[1])
        for kid in qa[5] if split_query else db[5]:
            pair = (kid, b) if split_query else (a, kid)
            heapq.heappush(heap, (-bound(*pair), *pair))
    return best


def upper_bound(centres, q_reach, q_norm, d_reach, d_norm):
    """What no inner product of a row of either node exceeds; a margin keeps rounding from pruning a tie."""
    limit = centres + q_norm * d_reach + d_norm * q_reach + q_reach * d_reach
    return limit + 1e-6 * np.abs(limit) + 1e-3


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double.

    Null if the vector is null or holds a null or a non-finite component, or
    one so large that inner products of such vectors would not fit 64 bits.
    """
    scaled = F.transform(embedding, lambda x: x.cast("double") * scale)
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(embedding), F.lit(1)))
    fine = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= most), F.lit(False)))
    return F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    sizes = pc.list_value_length(column).to_numpy()
    found = np.zeros((len(column), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return found


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, v, cell (of the nearest centre), distance. The centres go along with the function: MOST_CELLS at most."""
    width, squares = centres.shape[1], (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("v"), width).astype(np.float64)
            cell = (squares - 2 * (points @ centres.T)).argmin(axis=1)
            distance = np.sqrt(((points - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cell", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, cell int, distance double")


def trees(blocks: DataFrame, width: int) -> DataFrame:
    """cell, part, tree: each block's cover tree, built once. blocks(cell, part, vec_id, v, floor)."""

    def run(table: pa.Table) -> pa.Table:
        tree = CoverTree(matrix(table["v"].combine_chunks(), width), table["vec_id"].to_numpy())
        floors = pc.fill_null(table["floor"], np.iinfo(np.int64).min).to_numpy()
        packed = pickle.dumps((tree.packed(), floors), protocol=5)
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "tree": pa.array([packed], pa.binary())})

    return blocks.select("cell", "part", "vec_id", "v", "floor").groupBy("cell", "part").applyInArrow(run, "cell int, part int, tree binary")


def searched(meetings: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: k answers a query of each meeting. meetings(q_cell, q_part, d_cell, d_part); queries and data: trees."""
    asked = queries.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("tree").alias("asks"))
    given = data.select(F.col("cell").alias("d_cell"), F.col("part").alias("d_part"), F.col("tree").alias("gives"))
    parts = max(1, int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = meetings.repartition(parts, "q_cell", "q_part", "d_cell", "d_part").join(asked, ["q_cell", "q_part"]).join(given, ["d_cell", "d_part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, gives in zip(batch.column("asks"), batch.column("gives"), strict=True):
                (q, floors), (d, _) = pickle.loads(asks.as_py()), pickle.loads(gives.as_py())
                q, d = CoverTree.unpacked(q), CoverTree.unpacked(d)
                best = dual_search(q, d, k, floors)
                real = best.scores > np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, real.sum(axis=1))), pa.array(best.ids[real]), pa.array(best.scores[real])], names=["query_id", "vec_id", "score"])

    return met.select("asks", "gives").mapInArrow(run, "query_id long, vec_id long, score long")


class Cells:
    """What is known of the cells: how many vectors and queries each has and how far they reach. There are MOST_CELLS at most."""

    def __init__(self, centres: np.ndarray, rows: list):
        self.centres = centres
        n = len(centres)
        self.data, self.queries, self.d_reach, self.q_reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r in rows:
            self.data[r.cell], self.queries[r.cell], self.d_reach[r.cell], self.q_reach[r.cell] = r.n, r.q, r.reach, r.q_reach or 0.0

    def pairs(self, k: int) -> list[tuple[int, int, float, bool]]:
        """q_cell, d_cell, bound, first of every two cells that have queries and data; the first ones hold more than k vectors near the centre's best."""
        norms, found = np.sqrt((self.centres**2).sum(axis=1)), []
        for q in np.flatnonzero(self.queries).tolist():
            products = self.centres @ self.centres[q]
            bounds = upper_bound(products, self.q_reach[q], norms[q], self.d_reach, norms)
            order = [d for d in np.argsort(-products).tolist() if self.data[d]]
            ahead, first = 0, set()
            for d in order:
                if ahead > k:
                    break
                first.add(d)
                ahead += int(self.data[d])
            found += [(q, d, float(bounds[d]), d in first) for d in order]
        return found


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`; candidates are all
    rows but those with the query's own id. Components become
    floor(1024 * x); vectors that are null or hold a null or a non-finite
    component take no part, nor do rows without an id, nor vectors with a
    component whose square, times their length, passes 2 ** 62 (scores are
    64-bit integers). Vectors of different lengths are compared as if the
    shorter ended in zeros. Ties go to the smaller id; all candidates are
    returned if there are fewer than k. Rows repeated under one id are
    candidates each; queries repeated under one id answer once, from the
    vector that sorts first. Other columns are not read.

    The centres of the tree's top level come from a sample of bounded size;
    each vector goes to the cell of its nearest centre, and a cell with many
    is cut into parts. Each part's tree is built once. Queries first search
    the cells around their centre's best ones, which gives each a kth score
    to beat. Then a query block meets only the cells whose bound, by both
    covering radii, reaches the least of its scores; others are pruned before
    anything is sent. A last pass keeps the k best of all answers.
    """
    spark = vectors.sparkSession
    ints = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v")).where("vec_id is not null and v is not null")
    ints = written(ints, "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    size = ints.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("v")).alias("width")).first()
    if not size.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size.width)
    share = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / size.n))
    sample = matrix(ints.where(share).limit(4 * SAMPLE).select("v").toArrow()["v"].combine_chunks(), width).astype(np.float64)
    sample = sample if len(sample) else np.zeros((1, width))
    centres = sample[spread_centres(sample, min(MOST_CELLS, -(-size.n // DATA_BLOCK)))[2]]
    # The row's number, fixed by the writing, parts rows that share an id and a vector.
    cells = written(placed(ints, centres).withColumn("row", F.monotonically_increasing_id()), "topk-cells")
    removed(ints)
    queries = cells.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "distance", "row")).alias("f")).select("vec_id", "f.*")
    queries = written(queries, "topk-queries")
    stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("reach")).join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("q"), F.max("distance").alias("q_reach")), "cell", "left").fillna(0, ["q"])
    known = Cells(centres, stats.collect())
    pairs = spark.createDataFrame(known.pairs(k), "q_cell int, d_cell int, bound double, first boolean")

    def parted(rows: DataFrame, counts: np.ndarray, block: int) -> DataFrame:
        parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in counts]), F.col("cell") + 1)
        return rows.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))

    def parts_of(counts: np.ndarray, block: int, name: str) -> DataFrame:
        rows = [(i, max(1, -(-int(n) // block))) for i, n in enumerate(counts) if n]
        return spark.createDataFrame(rows, f"{name}_cell int, parts int").withColumn(f"{name}_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    data_trees = written(trees(parted(cells, known.data, DATA_BLOCK).withColumn("floor", F.lit(None).cast("long")), width), "topk-trees")
    asked = parted(queries, known.queries, QUERY_BLOCK)
    q_parts, d_parts = parts_of(known.queries, QUERY_BLOCK, "q"), parts_of(known.data, DATA_BLOCK, "d")
    blind = written(trees(asked.withColumn("floor", F.lit(None).cast("long")), width), "topk-query-trees")
    first = written(searched(pairs.where("first").join(q_parts, "q_cell").join(d_parts, "d_cell").select("q_cell", "q_part", "d_cell", "d_part"), blind, data_trees, k), "topk-first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    bounded = written(asked.join(floors, "vec_id", "left"), "topk-floors")
    least = bounded.groupBy(F.col("cell").alias("q_cell"), F.col("part").alias("q_part")).agg(F.min(F.coalesce("floor", F.lit(-(1 << 63)))).alias("least"))
    rest = written(least.join(pairs.where("not first"), "q_cell").where(F.col("bound") >= F.col("least")).join(d_parts, "d_cell").select("q_cell", "q_part", "d_cell", "d_part"), "topk-meetings")
    answers = first
    if not rest.isEmpty():
        answers = first.unionByName(searched(rest, written(trees(bounded, width), "topk-query-trees"), data_trees, k))
    removed(queries, blind, cells)
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
