"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (about ``sample_rows`` vectors, at random):
the neighbour graph of the sample is computed by the tasks, cut into parts of
equal size by recursive bisection (each half keeps the nodes that diffusion
over the graph puts on one side, then pairs with the largest gain are
swapped), and a small classifier learns, from a vector, the share of its
neighbours in each part. How many parts a query visits is measured on sampled
vectors that were not trained on: the fewest that hold ``target`` of their
true neighbours.

Searching covers every row: the classifier puts each candidate into its most
probable part and sends each query to its most probable parts, which are
reranked by exact inner products in double precision. A part larger than
``block`` rows is cut by row hash into several blocks, on the query side too,
so no task holds more than one block of each. Each block returns its best
``k`` per query, and the best of these are the answer.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part, as queries or candidates; nor do rows with
a null id or with another length than the most frequent one; fewer than ``k``
candidates: all of them; equal scores rank by smaller id; a repeated row is a
candidate (and a query) of its own; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, thinned, written

by_value(__name__)

NEIGHBOURS = 20
SAMPLE_ROWS = 6144
CHECK_ROWS = 512
GRAPH_DEGREE = 12
MAX_PARTS = 128
HIDDEN_UNITS = 96
TARGET = 0.97
BLOCK_ROWS = 16384


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors stored as bytes of doubles, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def bisect(edges: np.ndarray, nodes: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``nodes`` with few edges between them."""
    n = nodes.size
    at = np.full(int(nodes.max()) + 1, -1)
    at[nodes] = np.arange(n)
    inside = edges[(edges < at.size).all(axis=1)]
    inside = at[inside]
    inside = inside[(inside >= 0).all(axis=1)]
    a, b = np.concatenate([inside, inside[:, ::-1]]).T
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.normal(size=n)
    for _ in range(rounds):
        x = (np.bincount(a, x[b], minlength=n) + x) / degree
        x = x - (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-12
    side = np.ones(n)
    side[np.argsort(x, kind="stable")[: n // 2]] = -1
    for _ in range(20):
        gain = -side * np.bincount(a, side[b], minlength=n)
        low, high = np.nonzero(side < 0)[0], np.nonzero(side > 0)[0]
        low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
        m = min(low.size, high.size, max(1, n // 50))
        swap = np.nonzero(gain[low[:m]] + gain[high[:m]] > 2)[0]
        if not swap.size:
            break
        side[low[swap]], side[high[swap]] = 1, -1
    return nodes[side < 0], nodes[side > 0]


def balanced_parts(edges: np.ndarray, n: int, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each of ``n`` nodes; part sizes differ by rounding only."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(edges, g, rng)]
    out = np.zeros(n, dtype=np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    """Most probable parts of a vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int = 1

    @property
    def parts(self) -> int:
        return self.b2.size

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")

    def best(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.logits(x), axis=1)


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, hidden: int = HIDDEN_UNITS, seed: int = 5) -> Router:
    """Cross entropy against the share of neighbours in each part."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    z, parts = x / scale, target.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m1, m2, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = epochs * max(1, -(-len(z) // 256))
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at:at + 256]
            h = z[rows] @ p[0] + p[1]
            act = np.maximum(h, 0)
            out = act @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            d = (out / out.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            rate = 0.004 * (1 - t / (steps + 1))
            for a, g, u, v in zip(p, (z[rows].T @ dh, dh.sum(0), act.T @ d, d.sum(0)), m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                a -= rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Router(*p, scale)


def nearest_in(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indices of the ``k`` largest inner products; ``own`` is left out."""
    k = min(k, len(x) - (own is not None))
    out = np.empty((len(queries), k), dtype=np.int64)
    for at in range(0, len(queries), 512):
        s = queries[at:at + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[at:at + 512]] = -np.inf
        out[at:at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _graph(rows: DataFrame, sample: np.ndarray, degree: int) -> np.ndarray:
    """Neighbour lists of the sample; ``rows`` holds the sample's positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            near = nearest_in(sample, sample[own], degree, own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.tolist(), pa.list_(pa.int64()))], ["id", "near"])

    got = rows.mapInArrow(run, "id long, near array<long>").orderBy("id").collect()
    return np.array([r["near"] for r in got])


def parts_for(rows: int) -> int:
    """About half the square root of the number of rows, a power of two."""
    return int(min(MAX_PARTS, 2 ** max(0, round(np.log2(np.sqrt(max(rows, 1)) / 2)))))


def fit_router(vectors: DataFrame, rows: int, dim: int, k: int = NEIGHBOURS, sample_rows: int = SAMPLE_ROWS,
               target: float = TARGET) -> Router:
    """Learn from about ``sample_rows + CHECK_ROWS`` rows of ``vectors``
    (``id, row, v``), drawn at random by a fixed seed."""
    spark = vectors.sparkSession
    one = Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0, 1)
    parts = parts_for(rows)
    if parts == 1:
        return one
    got = thinned(vectors, sample_rows + CHECK_ROWS, 47, rows).select("v").collect()
    x = np.unique(matrix(pa.array([r["v"] for r in got]), dim), axis=0)
    x = x[np.random.default_rng(1).permutation(len(x))]
    check, x = x[: len(x) // 10][:CHECK_ROWS], x[len(x) // 10:][:sample_rows]
    if len(x) < 4 * parts or not len(check):
        return one
    places = spark.range(0, len(x), 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = _graph(places, x, min(GRAPH_DEGREE, len(x) - 1))
    edges = np.stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], axis=1)
    label = balanced_parts(edges, len(x), parts)
    share = np.zeros((len(x), parts))
    for column in [np.arange(len(x))] * 3 + list(near.T):
        share[np.arange(len(x)), label[column]] += 1
    router = train_router(x, share / share.sum(axis=1, keepdims=True))
    home = router.best(x)
    rank = np.argsort(router.order(check), axis=1)
    need = np.take_along_axis(rank, home[nearest_in(x, check, min(k, len(x)))], axis=1)
    router.probes = int(np.searchsorted(np.cumsum(np.bincount(need.ravel(), minlength=parts)) / need.size, target)) + 1
    return router


def usable(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``id, row, v`` (bytes of doubles) of the rows that take part, stored,
    and the vector length."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.exists(v, lambda e: e != 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "row", "v"])

    same = rows.filter(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id())
    return written(same.mapInArrow(run, "id long, row long, v binary"), "ann-vectors"), dim


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS,
           sample_rows: int = SAMPLE_ROWS, target: float = TARGET, block: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (a
    condition on ``id``) holds, its ``k`` nearest other rows found."""
    vectors, dim = usable(table, id_col, vec_col)
    total, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    router = fit_router(vectors, total, dim, k, sample_rows, target)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.best(matrix(b.column("v"), dim)) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, "part"])

    placed = written(vectors.mapInArrow(home, "id long, row long, v binary, part int"), "ann-placed")
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row a part
    sizes = np.array([held.get(p, 0) for p in range(router.parts)])
    cuts = np.maximum(1, -(-sizes // block))
    sides = max(1, -(-(asked * router.probes // router.parts + 1) // block))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = router.order(matrix(b.column("v"), dim))
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(4 * k, sizes.sum()), axis=1) + 1
            visits = np.maximum(enough, router.probes)
            at, part, cut = [], [], []
            for i, n in enumerate(visits.tolist()):
                for p in order[i, :n].tolist():
                    c = int(cuts[p])
                    at += [i] * c
                    part += [p] * c
                    cut += range(c)
            t = pa.Table.from_batches([b]).take(pa.array(at, pa.int64()))
            t = t.append_column("part", pa.array(part, pa.int32())).append_column("cut", pa.array(cut, pa.int32()))
            yield from t.combine_chunks().to_batches()

    side = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(sides)).cast("int")
    queries = vectors.filter(is_query).mapInArrow(route, "id long, row long, v binary, part int, cut int").withColumn("side", side)
    splits = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("part") + 1)
    cut = F.pmod(F.xxhash64("row", F.lit(1)), splits).cast("int")
    rows = placed.withColumn("cut", cut).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, c = matrix(asked.column("v"), dim), matrix(held.column("v"), dim)
        q_row, c_row = asked.column("row").to_numpy(), held.column("row").to_numpy()
        q_id, c_id = asked.column("id").to_numpy(), held.column("id").to_numpy()
        out = []
        step = max(1, (1 << 22) // max(1, len(c)))
        for at in range(0, len(q) if len(c) else 0, step):
            s = q[at:at + step] @ c.T
            s[q_row[at:at + step][:, None] == c_row[None, :]] = -np.inf
            top = min(k, len(c))
            floor = np.partition(s, len(c) - top, axis=1)[:, len(c) - top]
            slack = 1e-9 * (1 + np.abs(floor))
            i, j = np.nonzero(s >= np.where(np.isfinite(floor), floor - slack, -np.finfo(float).max)[:, None])
            exact = np.concatenate([(q[at + i[n:n + 65536]] * c[j[n:n + 65536]]).sum(axis=1) for n in range(0, i.size, 65536)] or [np.zeros(0)])
            order = np.lexsort((c_row[j], c_id[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            starts = np.searchsorted(i, i)
            keep = np.arange(i.size) - starts < k
            out.append((at + i[keep], j[keep], exact[keep]))
        i, j, s = (np.concatenate([o[n] for o in out] or [np.zeros(0, dtype=np.int64)]) for n in range(3))
        i, j = i.astype(np.int64), j.astype(np.int64)
        return pa.table({"query_row": q_row[i], "query_id": q_id[i], "vec_id": c_id[j], "vec_row": c_row[j], "score": s.astype(np.float64)})

    keys = ["part", "cut", "side"]
    best = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        rerank, "query_row long, query_id long, vec_id long, vec_row long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ann_query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("id") % 20 == 0)
