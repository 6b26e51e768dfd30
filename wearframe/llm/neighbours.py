"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and sent to all tasks; every row is put into a leaf. A query walks the tree through a priority queue that
always opens the node whose centre has the largest inner product with it, and so lists leaves from promising to hopeless. How many leaves are visited
is not a constant: a sample of queries is answered exactly over all rows, and visits are widened until the wanted share of their neighbours would be found.

Leaves are packed into groups of rows (a leaf larger than a group is split), queries into blocks. A task takes one group and one block and returns the
nearest rows of each query, so neither a crowded leaf nor a crowd of queries is one task's work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearframe.llm.common import staged

K = 20
#: The tree is fitted on at most about so many vectors and bytes of them; it aims at leaves of LEAF_ROWS rows and never has more than a leaf for LEAST_FIT of them.
FIT_ROWS = 16_384
FIT_BYTES = 32 << 20
LEAF_ROWS = 256
LEAST_FIT = 4
BRANCHES = 8
ROUNDS = 8
#: Queries answered exactly to calibrate, and the share of their neighbours that visits must reach.
PROBES = 256
RECALL = 0.95
#: Rows of a group: a sixteenth of all, within these bounds; queries of a block.
GROUP_ROWS = (1024, 65_536)
QUERY_ROWS = 65_536
#: Cells of a matrix of inner products at a time.
CELLS = 1 << 20
#: Inner products of matrix products are off by less than this, times both lengths.
SLACK = 1e-12


@dataclass
class Tree:
    """Nodes of a k-means tree: centres, children, and the number of each leaf (-1 for inner nodes)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: at every node the child with the nearest centre."""
        node = np.zeros(len(vectors), np.int64)
        open_rows = np.arange(len(vectors)) if self.children[0] else np.empty(0, np.int64)
        while len(open_rows):
            order = open_rows[np.argsort(node[open_rows], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                kids = np.array(self.children[node[rows[0]]])
                centres = self.centres[kids]
                node[rows] = kids[(vectors[rows] @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)]
            open_rows = order[self.leaf[node[order]] < 0]
        return self.leaf[node]

    def visit(self, products: np.ndarray, sizes: list[int], most: int, rows: int) -> list[int]:
        """Leaves best bin first, given the query's inner product with every centre: `most` leaves, and on until they hold `rows` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        near = products.tolist()
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-near[kid], kid))
            else:
                out.append(int(self.leaf[node]))
                held += sizes[out[-1]]
        return out


def fit(sample: np.ndarray, leaf_rows: float, seed: int = 11) -> Tree:
    """A tree over `sample`: nodes of more than `leaf_rows` vectors are split by k-means unless all their vectors are equal. Leaves are numbered depth first."""
    rng = np.random.default_rng(seed)
    centres, children, leaf = [sample.mean(axis=0)], [[]], [-1]
    stack, numbered = [(0, np.arange(len(sample)))], 0
    while stack:
        node, rows = stack.pop()
        own, parts = sample[rows], []
        if len(rows) > leaf_rows:
            middle = own[np.sort(rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False))]
            for _ in range(ROUNDS):
                part = (own @ middle.T - 0.5 * (middle * middle).sum(axis=1)).argmax(axis=1)
                filled = np.unique(part)
                middle = np.stack([own[part == p].mean(axis=0) for p in filled])
            parts = [rows[part == p] for p in filled]
        if len(parts) < 2:
            leaf[node] = numbered
            numbered += 1
            continue
        for rows_of, centre in zip(parts, middle, strict=True):
            children[node].append(len(centres))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
            stack.append((len(centres) - 1, rows_of))
    return Tree(np.array(centres), children, np.array(leaf))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """`id` and `vec`: vectors that are not null, not zero, and of non-null finite components."""
    kind = df.schema[vec_col].dataType
    vec = F.col(vec_col) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & good)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of equal lengths as double rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def hashed_sample(df: DataFrame, rows: int, most: int, salt: int) -> DataFrame:
    """About `most` of `rows` rows, by a hash of their id; all of them if there are no more."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / rows)))


class Best:
    """The k best rows of each query so far: larger score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.most = k, np.full(queries, -np.inf), 2 * k * queries
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        self.parts.append((query, ids, score, *more))
        self.held += len(query)
        if self.held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.lexsort((columns[1], -columns[2], columns[0]))
        query = columns[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        columns = tuple(c[order[place < self.k]] for c in columns)
        last = place[place < self.k] == self.k - 1
        self.floor[columns[0][last]] = columns[2][last]
        self.parts, self.held = [columns], 0
        return columns


def scan(best: Best, rows: np.ndarray, names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: np.ndarray) -> None:
    """Adds to `best` all vectors that may be among the k nearest of `queries` (rows `rows` of the block, called `names`), except the query itself.

    Equal vectors are compared once, and of their ids only the k + 1 smallest can matter. Scores are plain sums over components, equal for equal vectors;
    the matrix product only selects, with a slack for its rounding, so ties at the border are all kept.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors, leaf = ids[order], np.ascontiguousarray(vectors[order]), leaf[order]
    _, first, same = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by_vector = np.argsort(same, kind="stable")
    place = np.arange(len(ids)) - np.searchsorted(same[by_vector], same[by_vector])
    by_vector = by_vector[place <= best.k]
    starts = np.searchsorted(same[by_vector], np.arange(len(first) + 1))
    distinct = vectors[first]
    longest = np.sqrt((distinct * distinct).sum(axis=1).max())
    for at in range(0, len(rows), max(1, CELLS // len(distinct))):
        part = slice(at, at + max(1, CELLS // len(distinct)))
        own = queries[part]
        product = own @ distinct.T
        floor = best.floor[rows[part]]
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and len(distinct) > best.k + 1:
            floor[new] = np.partition(product[new], -(best.k + 1), axis=1)[:, -(best.k + 1)]
        floor = floor - SLACK * longest * np.sqrt((own * own).sum(axis=1))
        q, v = np.nonzero(product >= floor[:, None])
        score = (own[q] * distinct[v]).sum(axis=1)
        many = starts[v + 1] - starts[v]
        spread = np.repeat(np.arange(len(q)), many)
        copy = by_vector[np.repeat(starts[v], many) + np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)]
        other = ids[copy] != names[part][q[spread]]
        spread, copy = spread[other], copy[other]
        best.add(rows[part][q[spread]], ids[copy], score[spread], leaf[copy])


def exact_answers(placed: DataFrame, probe_ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """`probe`, `id`, `score`, `leaf` of the k nearest rows of each probe, over all rows."""
    dim = probes.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(probes), k)
        for batch in batches:
            leaf, ids, vectors = batch.column(2).to_numpy(), batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for at in range(0, len(ids), 4096):
                part = slice(at, at + 4096)
                scan(best, np.arange(len(probes)), probe_ids, probes, ids[part], vectors[part], leaf[part])
                best.cut()
        q, i, s, w = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array(w)], names=["probe", "id", "score", "leaf"])

    found = placed.select("id", "vec", F.col("leaf").cast("long")).mapInArrow(nearest, "probe long, id long, score double, leaf long")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def calibrated(tree: Tree, sizes: list[int], probes: np.ndarray, answers: list[tuple[int, int]], k: int, recall: float) -> int:
    """The number of leaves to visit: widened by a quarter until `recall` of the probes' true neighbours lie in visited leaves. Answers are (probe, leaf)."""
    if not answers:
        return 1
    products = probes @ tree.centres.T
    place = [{leaf: i for i, leaf in enumerate(tree.visit(p, sizes, tree.leaves, 0))} for p in products]
    at = np.array([place[probe][leaf] for probe, leaf in answers])
    most = 1
    while (at < most).mean() < recall and most < tree.leaves:
        most = min(tree.leaves, most + max(1, most // 4))
    return most


def groups_of(sizes: list[int], group_rows: int) -> tuple[list[int], list[int]]:
    """First group and number of groups of each leaf: neighbouring leaves share a group up to `group_rows`; a larger leaf has groups of its own."""
    first, parts, group, room = [], [], -1, 0
    for n in sizes:
        if n > group_rows:
            first.append(group + 1)
            parts.append(-(-n // group_rows))
            group, room = group + parts[-1], 0
            continue
        if n > room or group < 0:
            group, room = group + 1, group_rows
        first.append(group)
        parts.append(1)
        room -= n
    return first, parts


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS,
           leaf_rows: int = LEAF_ROWS, probes: int = PROBES, group_rows: tuple[int, int] = GROUP_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of `vectors` with the largest inner product for each row of `queries`: query_id, rank (from 1), vec_id, score.

    About `recall` of the true neighbours are found (calibrated on `probes` queries). Scores are exact, in double precision. Equal scores go to the smaller
    id. Fewer than k candidates are all returned. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
    length than the most common one (of equally common ones the largest), nor null ids. Rows with one id are one vector (the least of them); a query never finds its own id.
    Columns besides id and vector are not read. No vectors, or no queries, give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).first().m
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.n
    one = lambda df, name: staged(df.filter(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec")), name)
    rows, asked = one(rows, "vectors"), one(asked, "queries")
    n, n_asked = rows.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)

    most = min(fit_rows, max(64, FIT_BYTES // (8 * dim)))
    sample = matrix(hashed_sample(rows, n, most, 1).orderBy("id").select("vec").toArrow().column(0), dim)
    tree = fit(sample, max(LEAST_FIT, leaf_rows * len(sample) / n))
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value.place(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], names=["id", "vec", "leaf"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = staged(rows.mapInArrow(place, f"id long, vec {kind}, leaf int"), "placed")
    sizes = [0] * tree.leaves
    for r in placed.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]

    probe = hashed_sample(asked, n_asked, probes, 2).orderBy("id").toArrow()
    probe_ids, probe_vecs = probe.column("id").to_numpy(), matrix(probe.column("vec"), dim) if probe.num_rows else np.empty((0, dim))
    answers = [(r.probe, r.leaf) for r in exact_answers(placed, probe_ids, probe_vecs, k).select("probe", "leaf").collect()] if len(probe_ids) else []
    visits = calibrated(tree, sizes, probe_vecs, answers, k, recall) if answers else tree.leaves

    first, parts = groups_of(sizes, min(max(-(-n // 16), group_rows[0]), group_rows[1]))
    blocks = -(-n_asked // query_rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                products = matrix(part.column(1), dim) @ tree.centres.T
                row, group, leaves = [], [], []
                for i, p in enumerate(products):
                    of: dict[int, list[int]] = {}
                    for leaf in tree.visit(p, sizes, visits, k + 1):
                        for g in range(first[leaf], first[leaf] + parts[leaf]):
                            of.setdefault(g, []).append(leaf)
                    for g, found in of.items():
                        row.append(i)
                        group.append(g)
                        leaves.append(found)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)), pa.array(group, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "vec", "group", "leaves"])

    block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    routed = staged(asked.mapInArrow(walk, f"id long, vec {kind}, group int, leaves array<int>").select("*", block), "routed")
    firsts, many = F.array(*[F.lit(x) for x in first]), F.array(*[F.lit(x) for x in parts])
    layout = spark.createDataFrame(list(zip(range(len(first)), first, parts, strict=True)), "leaf int, f int, p int")
    grouped = placed.join(F.broadcast(layout), "leaf").withColumn("group", (F.col("f") + F.pmod(F.xxhash64("id", F.lit(4)), F.col("p"))).cast("int"))
    met = grouped.join(routed.select("group", F.col("block").alias("__b")).distinct(), "group").select(F.col("group").alias("__g"), "__b", "leaf", "id", "vec")

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        best = Best(asked.num_rows, k)
        if asked.num_rows and rows.num_rows:
            names, vectors = asked.column("id").to_numpy(), matrix(asked.column("vec"), dim)
            leaves = asked.column("leaves").combine_chunks()
            whose = np.repeat(np.arange(asked.num_rows), leaves.value_lengths().to_numpy())
            wanted = leaves.flatten().to_numpy()
            ids, others, leaf = rows.column("id").to_numpy(), matrix(rows.column("vec"), dim), rows.column("leaf").to_numpy()
            order, by_leaf = np.argsort(wanted, kind="stable"), np.argsort(leaf, kind="stable")
            for x in np.unique(leaf):
                visiting = whose[order[np.searchsorted(wanted[order], x) : np.searchsorted(wanted[order], x, "right")]]
                if len(visiting):
                    inside = by_leaf[np.searchsorted(leaf[by_leaf], x) : np.searchsorted(leaf[by_leaf], x, "right")]
                    scan(best, visiting, names[visiting], vectors[visiting], ids[inside], others[inside], leaf[inside])
        q, i, s, _ = best.cut()
        return pa.table({"query_id": asked.column("id").to_numpy()[q] if asked.num_rows else q, "vec_id": i, "score": s})

    pairs = routed.groupBy("group", "block").cogroup(met.groupBy("__g", "__b")).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
