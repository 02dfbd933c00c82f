"""Exact top-k inner products by aggregation of sorted lists without random access.

In a block of candidates every dimension is a list sorted by value. The lists are read in step from
both ends, for all queries at once: an entry adds its product to the candidate's score. What a
candidate has not shown yet lies between the two places where the lists stand, which bounds its
score from below and above. A candidate whose upper bound is under the k-th best lower bound is out;
reading ends when few enough are left, and only their scores are worked out in full. Bounds carry
over from block to block. Queries meet all rows in tiles of a set of queries with a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.llm.text import cut, shuffle_width


@dataclass(frozen=True)
class TopParams:
    k: int = 5
    scale: int = 256
    #: Queries that one task holds, and candidates whose lists are sorted and read together.
    queries: int = 16_384
    block: int = 4096
    #: Queries that read the lists together, and readings after which bounds are taken.
    together: int = 128
    readings: int = 12
    #: Candidates left per query, on average, at which reading ends and scores are resolved.
    left: int = 48


class SortedLists:
    """The values of a block of candidates, by dimension and in order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.n = vectors, len(vectors)
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def qualified(self, queries: np.ndarray, least: np.ndarray, own: np.ndarray, p: TopParams) -> tuple[np.ndarray, np.ndarray, int]:
        """candidate, query (places), entries read: pairs whose score may be among the k best.

        ``least``: score that a query's pairs must reach; ``own``: (candidate, query) pairs to leave out.
        """
        n, dim, half = self.n, queries.shape[1], (self.n + 1) // 2
        none = _lowest(queries.dtype)
        score = np.zeros((n, len(queries)), dtype=queries.dtype)
        unseen = np.ones((n, dim), dtype=queries.dtype)
        alive = np.ones((n, len(queries)), dtype=bool)
        alive[own[:, 0], own[:, 1]] = False
        step, read = max(1, -(-half // p.readings)), 0
        while read < half and alive.sum() > p.left * len(queries):
            upto = min(half, read + step)
            for d in range(dim):
                entries = np.concatenate([self.order[read:upto, d], self.order[max(upto, n - upto) : n - read, d]])
                score[entries] += self.vectors[entries, d, None] * queries[None, :, d]
                unseen[entries, d] = 0
            read = upto
            if read < half:
                ends = self.values[read][None, :] * queries, self.values[n - 1 - read][None, :] * queries
                low, high = score + unseen @ np.minimum(*ends).T, score + unseen @ np.maximum(*ends).T
            else:
                low = high = score
            low = np.where(alive, low, none)  # one that is out or the query itself backs no bound
            if n >= p.k:
                least = np.maximum(least, np.partition(low, n - p.k, axis=0)[n - p.k])
            alive &= high >= least[None, :]
        return *np.nonzero(alive), read


def _lowest(dtype) -> float | int:
    return -np.inf if np.issubdtype(dtype, np.floating) else np.iinfo(dtype).min


class Tile:
    """The k best candidates so far of the queries of one tile."""

    def __init__(self, dim: int, p: TopParams):
        self.dim, self.p = dim, p
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.queries = None

    def add_queries(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def add_candidates(self, node: np.ndarray, number: np.ndarray, vectors: np.ndarray) -> None:
        if self.queries is None:
            self._begin()
        if not len(self.node):
            return
        self.held.append((node, number, vectors))
        while sum(len(h[0]) for h in self.held) >= self.p.block:
            node, number, vectors = (np.concatenate(c) for c in zip(*self.held, strict=True))
            b = self.p.block
            self._meet(node[:b], number[:b], vectors[:b])
            self.held = [(node[b:], number[b:], vectors[b:])]

    def _begin(self) -> None:
        empty = (np.zeros(0, np.int64), np.zeros((0, self.dim), np.int64))
        self.node, self.queries = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else empty
        shape = (len(self.node), self.p.k)
        self.score, self.number, self.found = np.full(shape, np.iinfo(np.int64).min), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1)

    def _meet(self, node: np.ndarray, number: np.ndarray, vectors: np.ndarray) -> None:
        p = self.p
        largest = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(self.queries.astype(np.float64)).max(initial=0)) * max(1, self.dim)
        if largest >= 1 << 62:
            raise OverflowError("components are too large for exact 64-bit scores")
        exact = np.float64 if largest < 1 << 52 else np.int64  # doubles are exact so far, and faster
        lists = SortedLists(vectors.astype(exact))
        at_node = np.argsort(node)
        for at in range(0, len(self.node), p.together):
            q = slice(at, at + p.together)
            queries = self.queries[q].astype(exact)
            place = np.searchsorted(node[at_node], self.node[q])
            own = at_node[np.minimum(place, len(node) - 1)]
            same = np.flatnonzero(node[own] == self.node[q])
            least = np.where(self.found[q, -1] >= 0, self.score[q, -1].astype(exact), _lowest(exact))
            c, of, _ = lists.qualified(queries, least, np.stack([own[same], same], axis=1), p)
            scores = np.empty(len(c), dtype=np.int64)
            for x in range(0, len(c), 50_000):
                y = slice(x, x + 50_000)
                scores[y] = np.einsum("ij,ij->i", lists.vectors[c[y]], queries[of[y]])
            self._keep(of + at, scores, number[c], node[c])

    def _keep(self, q: np.ndarray, score: np.ndarray, number: np.ndarray, node: np.ndarray) -> None:
        touched, k = np.unique(q), self.p.k
        of = np.concatenate([np.repeat(touched, k), q])
        score, number, node = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.score, score), (self.number, number), (self.found, node)))
        order = np.lexsort((node, number, ~score, node < 0, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        order, of, place = order[place < k], of[place < k], place[place < k]
        for mine, new in ((self.score, score), (self.number, number), (self.found, node)):
            mine[of, place] = new[order]

    def finish(self) -> pa.RecordBatch:
        if self.queries is None:
            self._begin()
        if self.held and len(self.held[0][0]):
            self._meet(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
        q, place = np.nonzero(self.found >= 0)
        return pa.RecordBatch.from_arrays([pa.array(self.node[q]), pa.array(self.found[q, place]), pa.array(self.number[q, place]), pa.array(self.score[q, place])], names=["query", "node", "number", "score"])


def whole_vectors(vectors: DataFrame, is_query: Column, id_col: str, vector: str, scale: int) -> DataFrame:
    """id, query, dim, vec (array<long>): floor(scale * x) of vectors without null or non-finite components."""
    v = F.col("vec")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = vectors.select(vectors[id_col].cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), vectors[vector].cast("array<double>").alias("vec"))
    return flat.where(v.isNotNull() & ~odd).select("id", "query", F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x * scale)).alias("vec"))


def top_inner_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", p: TopParams = TopParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row.

    All rows are candidates but the query's own. Ties go to the smaller id, a missing id comes
    last. Rows that repeat a query's id and vector are candidates like any other, and a repeated
    query row has its own results. Ids are whole numbers. Vectors that are null or hold null or
    non-finite components take no part; vectors of different lengths don't meet, empty ones score
    0 with each other. Components whose products could leave 64 bits fail the job. Extra columns
    are not looked at. An empty table, or one without queries, gives no rows.

    Each query is sent to every block of rows, each row to every set of ``queries`` queries; a task
    holds one set and streams its block. What tiles return is k rows a query and block.
    """
    spark = vectors.sparkSession
    points = cut(whole_vectors(vectors, is_query, id_col, vector, p.scale).withColumn("node", F.monotonically_increasing_id()))
    sizes = points.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    width = shuffle_width(spark)
    sets = max(1, -(-sizes["q"] // p.queries))
    blocks = max(1, min(-(-2 * width // sets), -(-sizes["n"] // 256)), -(-sizes["n"] // (1 << 20)))
    dealt = F.xxhash64("node")
    asked = points.where("query").select(
        "dim", F.pmod(dealt, F.lit(sets)).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("role"), "node", "id", "vec"
    )
    rows = points.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), "node", "id", "vec"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            by = np.stack([batch.column(c).to_numpy() for c in ("dim", "set", "block", "role")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1, [len(by)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if key != tuple(by[a, :3]):
                    if tile is not None:
                        yield tile.finish()
                    key, tile = tuple(by[a, :3]), Tile(int(by[a, 0]), p)
                part = batch.slice(a, b - a)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b - a, tile.dim)
                node = part.column("node").to_numpy()
                if by[a, 3] == 0:
                    tile.add_queries(node, x)
                else:
                    tile.add_candidates(node, part.column("id").fill_null(np.iinfo(np.int64).max).to_numpy(), x)
        if tile is not None:
            yield tile.finish()

    by = ["dim", "set", "block"]
    found = asked.unionByName(rows).repartition(2 * width, *by).sortWithinPartitions(*by, "role").mapInArrow(run, "query long, node long, number long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "number", "node")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
    named = points.select("node", "id")
    return (
        top.join(named.select(F.col("node").alias("query"), F.col("id").alias("query_id")), "query")
        .join(named.select("node", F.col("id").alias("vec_id")), "node")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
