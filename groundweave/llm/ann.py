"""Nearest neighbours by cosine with robust-pruned directed graphs, one a shard.

Equal vectors are one node that keeps its ``k`` + 1 least ids, which is all that a top-k
with ties to the smaller id can ask of it. Nodes are dealt to shards of about
``shard_nodes`` by hash. In each shard a graph is built: greedy beam searches from the
shard's medoid propose neighbours for every node, and relaxed pruning keeps the nearest
and drops what a kept one is nearer to by the factor ``alpha`` (first 1, then ``alpha``);
reverse edges are added and pruned alike. A query beam-searches every shard; what its
beams hold is scored in double precision on the original vectors, and the best k of all
shards are ranked. A shard no larger than the beam is scored whole.

Index rows and blocks of ``block_queries`` queries meet by (shard, block), so a task holds
one shard and one block, whatever the number of queries.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors
of another length are compared only with their like. A null id takes no part. Repeated
rows of one id and vector count once. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_dir, stored

DEGREE, BEAM, ALPHA = 28, 64, 1.2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, for the graph; scores come from the vectors themselves."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True, initial=1e-300)
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(node ids, distances) of each query's beam, nearest first; -1 and inf where it isn't full. All queries advance together."""
    b, rows = len(queries), np.arange(len(queries))
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, len(points) + 1), dtype=bool)
    seen[:, -1] = True  # stands for the missing neighbours, -1
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = 1 - queries @ points[entry]
    active = rows
    while len(active):
        first = open_[active].argmax(axis=1)
        node = ids[active, first]
        open_[active, first] = False
        near = graph[node]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = 1 - np.matmul(points[near], queries[active][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, axis=1)
        dist[active] = np.take_along_axis(all_dist, order, axis=1)
        open_[active] = np.take_along_axis(all_open, order, axis=1)
        active = active[open_[active].any(axis=1)]
    return ids, dist


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node in ``of`` out of its row of candidates (-1: none)."""
    out = np.full((len(of), degree), -1, np.int64)
    for a in range(0, len(of), 256):
        own, cand = of[a : a + 256], candidates[a : a + 256]
        cand = np.sort(np.where(cand == own[:, None], -1, cand), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        there = points[cand]
        to_own = 1 - np.matmul(there, points[own][:, :, None])[:, :, 0]
        to_own[cand < 0] = np.inf
        alive, rows = cand >= 0, np.arange(len(own))
        for k in range(degree):
            best = np.where(alive, to_own, np.inf).argmin(axis=1)
            live = alive[rows, best]
            if not live.any():
                break
            out[a : a + 256, k][live] = cand[rows, best][live]
            between = 1 - np.matmul(there, there[rows, best][:, :, None])[:, :, 0]
            alive &= alpha * between > to_own
            alive[rows, best] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours by node, -1 where fewer, entry node) of a shard's unit vectors."""
    n = len(points)
    entry = int((points @ points.mean(axis=0)).argmax())
    rng = np.random.default_rng(n)
    graph = np.full((n, degree), -1, np.int64)
    start = min(degree // 2, n - 1)
    if start > 0:
        graph[:, :start] = rng.integers(0, n, (n, start))
        graph[graph == np.arange(n)[:, None]] = -1
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            own = order[at : at + 512]
            ids, _ = beam_search(points, graph, entry, points[own], beam)
            kept = robust_prune(points, own, np.concatenate([ids, graph[own]], axis=1), degree, a)
            graph[own] = kept
            _add_reverse(points, graph, own, kept, degree, a)
    return graph, entry


def _add_reverse(points, graph, own, kept, degree, alpha) -> None:
    source, target = np.repeat(own, kept.shape[1]), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")
    for a in range(0, len(nodes), 256):
        some = by_count[a : a + 256]
        wide = int(count[some].max())
        new = np.full((len(some), wide), -1, np.int64)
        lanes = np.arange(wide)
        inside = lanes < count[some][:, None]
        new[inside] = source[(first[some][:, None] + lanes)[inside]]
        graph[nodes[some]] = robust_prune(points, nodes[some], np.concatenate([graph[nodes[some]], new], axis=1), degree, alpha)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector"))
    return picked.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: its hashes, its k + 1 least ids, the vector.

    The rank keeps no more than those ids of a vector in any task before the shuffle.
    """
    keyed = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    least = keyed.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return least.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))


def build_index(rows: DataFrame, *, k: int = 5, shard_nodes: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The stored index, a row for each shard: shard, dim, ids and their owners, vectors, graph, entry."""
    spark = rows.sparkSession
    nodes = stored(distinct_vectors(usable(rows, id_col, vector_col), k), shared_dir(spark, "nodes"))
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int")})

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h1", "h2"])
        vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
        graph, entry = build_graph(unit(vectors)) if len(vectors) > BEAM else (np.zeros((len(vectors), 0), np.int64), 0)
        sizes = group["ids"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(vectors)), sizes)
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "dim": [vectors.shape[1]], "entry": [entry], "degree": [graph.shape[1]],
            "ids": [np.concatenate(group["ids"].to_numpy()).astype("<i8").tobytes()], "owners": [owner.astype("<i4").tobytes()],
            "vectors": [vectors.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()],
        })

    schema = "shard int, dim int, entry int, degree int, ids binary, owners binary, vectors binary, graph binary"
    return stored(dealt.groupBy("dim", "shard").applyInPandas(build, schema), shared_dir(spark, "graphs"))


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, block_queries: int = 8192, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest ids other than its own."""
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    n_blocks = max(1, -(-asked.count() // block_queries))
    shards = index.select("dim", "shard")
    blocks = asked.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
    # The list of shards is short: one row for about shard_nodes vectors.
    left = blocks.join(F.broadcast(shards), "dim").select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "shard", "block")), "vec_id", "vector")
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(asked) and len(held):
            row = held.iloc[0]
            exact = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
            owners, ids = np.frombuffer(row["owners"], "<i4"), np.frombuffer(row["ids"], "<i8")
            first = np.searchsorted(owners, np.arange(len(exact) + 1))
            norm = np.sqrt((exact * exact).sum(axis=1))
            points = unit(exact)
            graph = np.frombuffer(row["graph"], "<i4").reshape(len(exact), -1).astype(np.int64)
            for a in range(0, len(asked), 512):
                some = asked.iloc[a : a + 512]
                wide = np.stack(some["vector"].to_numpy()).astype(np.float64)
                if graph.shape[1]:
                    found, _ = beam_search(points, graph, row["entry"], unit(wide), beam)
                else:
                    found = np.tile(np.arange(len(exact)), (len(wide), 1))
                length = np.sqrt((wide * wide).sum(axis=1))
                score = (exact[found] * wide[:, None, :]).sum(axis=2) / (norm[found] * length[:, None])
                score[found < 0] = -np.inf
                for i, own in enumerate(some["vec_id"].tolist()):
                    best = np.sort(-score[i])[: k + 1]
                    rows = []
                    for j in np.flatnonzero(-score[i] <= best[-1]).tolist():
                        if found[i, j] >= 0:
                            rows += [(-score[i, j], v) for v in ids[first[found[i, j]] : first[found[i, j] + 1]].tolist() if v != own]
                    parts += [(own, v, -s) for s, v in sorted(rows)[:k]]
        return pd.DataFrame(parts, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("q_dim", "q_shard", "q_block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
