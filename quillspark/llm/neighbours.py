"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so the order by Euclidean distance is the order by cosine. Every table hashes a
vector with ``hashes`` functions floor((a.x + b) / width), a drawn from a normal (2-stable) distribution. A query
visits its own bucket and the buckets next to it in the order of their estimated success: moving function i by one step
costs the squared distance of the query's projection to that edge of its interval, a set of moves costs the sum, and
the cheapest sets are generated with a heap. All buckets found in all tables are merged and ranked by the exact cosine.

Rows that repeat both id and vector count once. Of the rows with the same vector those with the ``k + 1`` smallest ids are
indexed: no more of them can be among a query's k nearest, ties going to the smaller id. Index and queries meet bucket by bucket; a bucket with more than
``block_rows`` vectors is split into blocks that each see the bucket's queries, and a block returns only its k best
ids per query, so no pairs are materialised and no task holds more than a block. A query with fewer than k neighbours found
is answered exactly, block by block over all vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of different dimensions are never compared; rows that repeat an id are compared as
they are, but a query never returns its own id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin

FOUND = "query_id long, vec_id long, score double"


def probe_moves(low: np.ndarray, high: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """The ``probes`` cheapest sets of moves (function, step), cheapest first, beginning with none.

    ``low[i]`` and ``high[i]`` are the distances of the projection to the lower and upper edge of its interval, in
    widths.
    """
    cost = np.concatenate((low ** 2, high ** 2))
    order = np.argsort(cost, kind="stable")
    ranked = cost[order].tolist()
    n = len(low)
    move = [(int(i) % n, -1 if i < n else 1) for i in order]
    out: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(ranked[0], (0,))] if ranked else []
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(ranked):
            heapq.heappush(heap, (total - ranked[last] + ranked[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + ranked[last + 1], chosen + (last + 1,)))
        moves = [move[i] for i in chosen]
        if len({f for f, _ in moves}) == len(moves):      # one function cannot move both ways
            out.append(tuple(moves))
    return out


class Hashes:
    """Projections of all tables for one dimension, drawn from the seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.shape, self.width, self.dim = (tables, hashes), width, dim
        self.fold = rng.integers(1, 2 ** 62, (tables, hashes), dtype=np.int64) * 2 + 1

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell numbers, position inside the cell in widths), both (rows, tables, hashes)."""
        p = ((unit @ self.a + self.b) / self.width).reshape(len(unit), *self.shape)
        cell = np.floor(p)
        return cell.astype(np.int64), p - cell

    def bucket(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (cells * self.fold[table]).sum(axis=-1) + np.int64(self.dim * 2 + 1) * np.int64(table + 7919)
        x = h.view(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
                   .filter(F.col("v").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0))
                   .filter(good & F.exists("v", lambda x: x != 0)))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by dimension."""
    offsets = np.asarray(column.offsets)
    size = np.diff(offsets)
    values = np.asarray(column.values)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, values[offsets[rows][:, None] + np.arange(d)]))
    return out


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Scaled to length one; first by the largest component, so the squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; the same pair always gives the same bits."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def entries(vectors: DataFrame, probes: int, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(bucket, id, v): every vector under its bucket in each table, or under ``probes`` buckets if above 1."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for rows, v in _matrix(batch.column(1)):
                h = made.setdefault(v.shape[1], Hashes(v.shape[1], tables, hashes, width, seed))
                for at in range(0, len(rows), 2048):
                    part = rows[at:at + 2048]
                    cell, inside = h.cells(unit_vectors(v[at:at + 2048]))
                    bucket, owner = [], []
                    for t in range(tables):
                        if probes <= 1:
                            bucket.append(h.bucket(cell[:, t], t))
                            owner.append(part)
                            continue
                        for i, r in enumerate(part):
                            moves = probe_moves(inside[i, t], 1 - inside[i, t], probes)
                            c = np.repeat(cell[i, t][None], len(moves), 0)
                            for j, m in enumerate(moves):
                                for f, step in m:
                                    c[j, f] += step
                            bucket.append(np.unique(h.bucket(c, t)))
                            owner.append(np.full(len(bucket[-1]), r))
                    owner = np.concatenate(owner)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(bucket)), pa.array(ids[owner]), batch.column(1).take(pa.array(owner))],
                        names=["bucket", "id", "v"])
    return vectors.mapInArrow(run, "bucket long, id long, v array<double>")


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, id, score) of each query's k best ids, each with its best score, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    rough = unit_vectors(q) @ unit_vectors(v).T
    for i, own in enumerate(query_ids):
        row = np.where(ids == own, -np.inf, rough[i])
        if len(first) > k:
            best = np.maximum.reduceat(row, first) if len(first) < len(row) else row
            near = np.flatnonzero(row >= np.partition(best, len(first) - k)[len(first) - k] - 1e-9)
        else:
            near = np.arange(len(row))
        near = near[ids[near] != own]
        if not len(near):
            continue
        exact = cosine(np.repeat(q[i][None], len(near), 0), v[near])
        top = np.lexsort((ids[near], -exact))
        top = top[np.sort(np.unique(ids[near][top], return_index=True)[1])[:k]]
        yield np.full(len(top), own), ids[near][top], exact[top]


def search_blocks(index: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score): k best per query in each block of a bucket; both sides are (bucket, id, v)."""
    counts = index.groupBy("bucket").agg(F.count("*").alias("rows")) \
        .withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int")).drop("rows")
    wanted = queries.select("bucket").distinct()
    left = (index.join(counts.join(wanted, "bucket"), "bucket")
                 .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
                 .select("bucket", "block", "id", "v"))
    right = (queries.join(counts, "bucket")
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("bucket", "block", "id", "v"))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            va, vb = a.column("v").combine_chunks(), b.column("v").combine_chunks()
            ia, ib = np.asarray(a.column("id")), np.asarray(b.column("id"))
            by_dim = {v.shape[1]: (rows, v) for rows, v in _matrix(va)}
            for rows, q in _matrix(vb):
                if q.shape[1] in by_dim:
                    own, v = by_dim[q.shape[1]]
                    for at in range(0, len(rows), 512):
                        out += _best(ib[rows[at:at + 512]], q[at:at + 512], ia[own], v, k)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            tables: int = 6, hashes: int = 4, width: float = 1.2, probes: int = 48, seed: int = 11,
            block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first."""
    rows = usable(vectors, id_col, vector_col).distinct()
    same = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).select("id", "v")
    asked = usable(queries, id_col, vector_col)
    found = search_blocks(entries(index, 1, tables, hashes, width, seed),
                          entries(asked, probes, tables, hashes, width, seed), k, block_rows)
    found = pin(_top(found, k))
    # queries that found fewer than k look at all vectors, dealt into blocks by a hash of the id
    few = pin(asked.join(found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id"),
                         F.col("id") == F.col("query_id"), "left_anti"))
    if few.limit(1).count():
        n = max(1, -(-index.count() // block_rows))
        rest = search_blocks(index.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("bucket"), "id", "v"),
                             few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"), "id", "v"),
                             k, block_rows)
        found = found.select("query_id", "vec_id", "score").unionByName(rest)
    return _top(found.select("query_id", "vec_id", "score"), k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                 .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
