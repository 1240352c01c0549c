"""Approximate nearest neighbours by NN-descent, with joins of neighbours of neighbours, and greedy graph search.

Equal vectors are one node, named by the smallest id. The first graph comes from windows of nodes that are sorted by
random sign codes. In each round every node's neighbours, in both directions, meet at the node and are compared with
one another; each keeps its nearest. A node with very many neighbours is dealt in blocks. Half-precision copies of the
vectors travel in these joins; the search ends with exact cosines of the original vectors in double precision.

A query starts at its own node and goes on to the neighbours of the nearest nodes not yet visited, in a beam. Then
each node stands for all ids of its vector that can be among the nearest.

Defined results: vectors that are null, empty or zero or hold null or non-finite components take no part, nor do those
of another length than most have (of equally frequent lengths the smaller counts); of rows that share an id one vector is used; ties go to the smaller id; with few candidates all are returned; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, prepare, stored
from .hamming_join import grouped

#: Neighbours a node keeps; rounds at most; a round that changes a smaller share of the graph is the last.
NEIGHBOURS, ROUNDS, ENOUGH = 32, 6, 0.04
#: Sort orders and window of the first graph.
ORDERS, WINDOW = 6, 96
#: Neighbours that meet at once, and partners each of them may learn of there.
MEETING, LEARNS = 256, 24
#: Nodes kept for a query, nodes it goes on from in a step, steps.
BEAM, WIDTH, STEPS = 192, 64, 6


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): components as bytes, for rows that take part; one row an id. With ``size``, their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, sizes = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not x.is_valid or not len(x) or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    ids.append(i)
                    sizes.append(len(v))
                    out.append((v + 0.0).astype("<f8" if (v != v.astype(np.float32)).any() else "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "vector", "size"])

    return rows.select(F.col(id_col).cast("long"), vector_col).mapInArrow(work, "vec_id long, vector binary, size int")


def components_of(vectors: list[bytes], size: int) -> np.ndarray:
    """Rows of doubles, from single or double bytes of vectors with ``size`` components."""
    if all(len(v) == 4 * size for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f4").reshape(-1, size).astype(np.float64)
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * size else "<f8").astype(np.float64) for v in vectors]).reshape(-1, size)


def unit_halves(nodes: DataFrame, size: int) -> DataFrame:
    """(node, half, code_0, ...): the unit vector in half precision, and sign codes by random directions."""
    directions = np.random.default_rng(3).normal(size=(size, 16 * ORDERS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = components_of(batch.column(1).to_pylist(), size)
            v = v / np.abs(v).max(1, initial=1e-300, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            signs = (v @ directions > 0).reshape(len(v), ORDERS, 16)
            codes = signs @ (1 << np.arange(15, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()), *(pa.array(codes[:, k], pa.int64()) for k in range(ORDERS))], ["node", "half", *(f"code_{k}" for k in range(ORDERS))])

    return nodes.mapInArrow(work, "node long, half binary, " + ", ".join(f"code_{k} long" for k in range(ORDERS)))


def halves(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float32)


def best_partners(nodes: np.ndarray, v: np.ndarray, most: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim): for each of the nodes the ``most`` nearest of the others, if nearer than its floor."""
    sim = v @ v.T
    sim[nodes[:, None] == nodes[None, :]] = -np.inf
    most = min(most, len(nodes) - 1)
    if most < 1:
        return nodes[:0], nodes[:0], np.zeros(0, np.float32)
    at = np.argpartition(-sim, most - 1, 1)[:, :most]
    row = np.repeat(np.arange(len(nodes)), most)
    value = sim[row, at.ravel()]
    good = np.isfinite(value) if floor is None else value > floor[row]
    return nodes[row[good]], nodes[at.ravel()[good]], value[good]


EDGES = "a long, b long, sim float"


def edge_batch(parts: list[tuple]) -> pa.RecordBatch:
    a, b, sim = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim.astype(np.float32))], ["a", "b", "sim"])


def window_edges(points: DataFrame) -> DataFrame:
    """Edges within overlapping windows of the points sorted by each code."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, column = [], []

        def window() -> tuple:
            return best_partners(np.array(nodes), halves(column), LEARNS)

        fresh = 0
        for batch in batches:
            parts = []
            for node, half in zip(batch.column("node").to_pylist(), batch.column("half").to_pylist()):
                nodes.append(node)
                column.append(half)
                fresh += 1
                if len(nodes) == WINDOW:
                    parts.append(window())
                    del nodes[: WINDOW // 2], column[: WINDOW // 2]
                    fresh = 0
            if parts:
                yield edge_batch(parts)
        if fresh and len(nodes) > 1:
            yield edge_batch([window()])

    out = None
    for k in range(ORDERS):
        order = points.select("node", "half", F.col(f"code_{k}").alias("code"))
        # Few points are one partition, so that a small table is one window.
        edges = order.repartitionByRange("code", "node").sortWithinPartitions("code", "node").mapInArrow(work, EDGES)
        out = edges if out is None else out.union(edges)
    return out


def nearest(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each node, of edges that may repeat. Spark keeps only these before it shuffles, too."""
    order = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return edges.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))


def met(graph: DataFrame, points: DataFrame) -> DataFrame:
    """Edges found where the neighbours of a node, in both directions, meet at it; at least one of two is new there."""
    at = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), "fresh").union(graph.select(F.col("b").alias("at"), F.col("a").alias("node"), "fresh"))
    at = at.groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
    sizes = at.groupBy("at").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any")
    blocks = F.ceil(F.col("n") / MEETING)
    dealt = at.join(sizes, "at").select("at", F.pmod(F.xxhash64("node", "at"), blocks).cast("long").alias("block"), "node", "fresh")
    floors = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    carried = points.select("node", "half").join(floors, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for group in grouped(batches, ["at", "block"]):
            nodes, fresh, floor = (group.column(c).to_numpy() for c in ("node", "fresh", "floor"))
            parts.append(best_partners(nodes, halves(group.column("half").to_pylist()), LEARNS, floor))
            n += len(parts[-1][0])
            if n > 50_000:
                yield edge_batch(parts)
                parts, n = [], 0
        if parts:
            yield edge_batch(parts)

    rows = dealt.join(carried, "node").repartition("at", "block").sortWithinPartitions("at", "block")
    return rows.select("at", "block", "node", "fresh", "floor", "half").mapInArrow(work, EDGES)


def neighbour_graph(points: DataFrame) -> DataFrame:
    """(a, b, sim): each node's nearest."""
    fresh = F.lit(True).alias("fresh")
    graph = stored(nearest(window_edges(points).select("*", fresh)), "graph")
    for _ in range(ROUNDS):
        found = met(graph, points)
        new = stored(nearest(graph.select("a", "b", "sim", F.lit(False).alias("fresh")).union(found.select("*", fresh))), "graph")
        dropped(graph)
        graph = new
        n = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("changed")).first()
        if n["changed"] <= ENOUGH * n["n"]:
            break
    return graph.select("a", "b", "sim")


def beam_search(queries: DataFrame, graph: DataFrame, points: DataFrame) -> DataFrame:
    """(query, node) of the nearest nodes found for (query, node it starts from)."""
    half = points.select("node", "half")
    of_query = queries.join(half, "node").select("query", F.col("half").alias("target"))
    links = graph.select(F.col("a").alias("node"), F.col("b").alias("next")).union(graph.select(F.col("b").alias("node"), F.col("a").alias("next"))).distinct()

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = (halves(batch.column("target").to_pylist()) * halves(batch.column("half").to_pylist())).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(sim.astype(np.float32)), pa.array([False] * batch.num_rows)], ["query", "node", "sim", "visited"])

    found = queries.select("query", "node", F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("visited"))
    for _ in range(STEPS):
        order = Window.partitionBy("query").orderBy("visited", F.col("sim").desc(), "node")
        ahead = found.withColumn("go", F.row_number().over(order) <= WIDTH).select("query", "node", "sim", (F.col("visited") | F.col("go")).alias("visited"), (F.col("go") & ~F.col("visited")).alias("go"))
        ahead = stored(ahead, "beam")
        nexts = ahead.where("go").join(links, "node").select("query", F.col("next").alias("node")).distinct().join(ahead.select("query", "node"), ["query", "node"], "left_anti")
        scored = nexts.join(half, "node").join(of_query, "query").select("query", "node", "target", "half").mapInArrow(similar, "query long, node long, sim float, visited boolean")
        keep = Window.partitionBy("query").orderBy(F.col("sim").desc(), "node")
        last, found = found, stored(ahead.drop("go").union(scored).withColumn("place", F.row_number().over(keep)).where(F.col("place") <= BEAM).drop("place"), "beam")
        for gone in (ahead, last):
            dropped(gone)
    return found.select("query", "node")


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows of each row where ``is_query`` (of vec_id) holds."""
    prepare(rows.sparkSession)
    clean = stored(clean_vectors(rows, id_col, vector_col), "vectors")
    first = clean.groupBy("size").count().orderBy(F.col("count").desc(), "size").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not first:
        return rows.sparkSession.createDataFrame([], empty)
    size = first["size"]
    vectors = stored(clean.where(F.col("size") == size).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    dropped(clean)
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    # Of equal vectors the k + 1 smallest ids can be results; queries keep their own ids.
    members = stored(vectors.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1).withColumn("node", F.min("vec_id").over(Window.partitionBy("vector"))).select("node", "vec_id", "vector"), "members")
    nodes = members.where("node = vec_id").select("node", "vector")
    points = stored(unit_halves(nodes, size), "points")
    graph = neighbour_graph(points)
    queries = vectors.where(is_query).join(nodes, "vector").select(F.col("vec_id").alias("query"), "node")
    starts = stored(queries, "queries")
    hits = beam_search(starts, graph, points)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (components_of(batch.column(c).to_pylist(), size) for c in ("target", "vector"))
                score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])

    target = starts.join(vectors.select(F.col("vec_id").alias("query"), F.col("vector").alias("target")), "query").select("query", "target")
    scored = hits.join(members, "node").where("vec_id <> query").join(target, "query").select("query", "vec_id", "target", "vector").mapInArrow(exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
