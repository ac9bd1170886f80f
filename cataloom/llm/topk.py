"""Exact top-k inner products with pivot-table elimination.

Vectors become integers, floor(256 * x). The pivots are the origin and up to ``PIVOTS`` vectors of a sample, each as far as possible from
the span of those before it. Every vector's distances to all of them are computed once. What these distances allow together is the
largest lower bound on the distance of two vectors, and so the least upper bound on their product: they fix a vector's place in the
pivots' span and its distance from the span, and q.x is at most the product of the two places plus that of the two distances. A query
takes the candidates in the order of that bound and stops when no bound reaches its k-th best score: the result is exact, ties included.

Queries are dealt to blocks and candidates to stripes, both by row number; a task takes one block of queries and reads one stripe
chunk by chunk, and a query's k-th score goes from chunk to chunk. So a task holds one block and one chunk, nothing is broadcast but the
pivots, candidates are copied once a block and queries once a stripe. Pivots are fitted on ``SAMPLE`` vectors (those with the least hash);
the index holds every row.

Edge cases: vectors that are null or hold a null, NaN or infinite component, and rows without a vec_id, take no part. Shorter vectors
count as padded with zeros. Rows that share the query's vec_id are no candidates of it; a query row that comes twice is answered once,
candidates that come twice are ranked twice. Scores beyond a long are set to its limits. Without candidates a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.scratch import drop, written

#: Rows of a chunk of candidates and of a block of queries; most rows of a stripe; vectors among which pivots are chosen; pivots.
CHUNK, BLOCK, STRIPE, SAMPLE, PIVOTS = 4096, 8192, 131_072, 512, 48
#: Candidates that a query evaluates first; queries that are bounded at once.
FIRST, SIDE = 32, 256


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v array<long> of the rows that take part."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return embeddings.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, length = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(length) and (length == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The vectors farthest from the span of those chosen before, fewer than ``n`` if these span the sample."""
    rest = vectors.astype(np.float64) / max(1.0, float(np.abs(vectors.astype(np.float64)).max(initial=0)))
    chosen: list[int] = []
    first = 0.0
    while len(chosen) < min(n, len(rest)):
        square = (rest**2).sum(1)
        i = int(square.argmax())
        first = first or float(square[i])
        if square[i] <= 1e-8 * first:
            break
        chosen.append(i)
        way = rest[i] / np.sqrt(square[i])
        rest = rest - np.outer(rest @ way, way)
    return vectors[chosen]


def pivot_table(v: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """From the distances to the pivots: place in their span and distance from it, in units of the longest norm."""
    scale = np.sqrt(top) or 1.0
    x, p = v.astype(np.float64) / scale, pivots.astype(np.float64) / scale
    square, own = (x**2).sum(1), (p**2).sum(1)
    away = np.sqrt(np.maximum(square[:, None] + own - 2 * x @ p.T, 0))  # to the origin it is sqrt(square)
    products = (square[:, None] + own - away**2) / 2
    place = np.linalg.solve(np.linalg.cholesky(p @ p.T), products.T).T if len(p) else products
    return np.column_stack([place, np.sqrt(np.maximum(square - (place**2).sum(1), 0))]).astype(np.float32)


def _scores(x: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products; x and q come in a float type whose whole numbers reach far enough, else as Python's integers."""
    s = x @ q
    if s.dtype == object:
        return np.array([min(max(int(i), -(2**63)), 2**63 - 1) for i in s], np.int64)
    return s.astype(np.int64)


class Search:
    """The k best so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, top: float, k: int):
        # sums of |q_i x_i| stay under |q| |x| <= top, so every partial sum is a whole number that the type holds
        self.kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
        self.ids, self.q, self.table, self.top, self.k = ids, vectors.astype(self.kind), table, top, k
        self.best_ids, self.best = ([np.empty(0, np.int64) for _ in ids] for _ in range(2))
        self.evaluated = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> None:
        """Takes in a chunk of candidates."""
        x = vectors.astype(self.kind)
        slack = 1e-5 * self.top + 1  # above the rounding of the table and of the product
        for lo in range(0, len(self.ids), SIDE):
            most = (self.table[lo : lo + SIDE] @ table.T) * np.float64(self.top) + slack
            for i, row in enumerate(most, lo):
                self._query(i, row, ids, x)

    def _query(self, i: int, most: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        best_ids, best = self.best_ids[i], self.best[i]
        most[ids == self.ids[i]] = -np.inf
        rest = np.flatnonzero(most >= best[-1] if len(best) == self.k else most > -np.inf)
        take = FIRST
        while len(rest):
            if len(rest) > take:
                order = np.argpartition(-most[rest], take - 1)
                now, rest = rest[order[:take]], rest[order[take:]]
            else:
                now, rest = rest, rest[:0]
            self.evaluated += len(now)
            best_ids, best = np.concatenate([best_ids, ids[now]]), np.concatenate([best, _scores(x[now], self.q[i], self.top)])
            order = np.lexsort((best_ids, ~best))[: self.k]  # ~s falls as s rises, and every long has one
            best_ids, best = best_ids[order], best[order]
            if len(best) == self.k:
                rest = rest[most[rest] >= best[-1]]  # all others can't reach the k-th score
            take *= 4
        self.best_ids[i], self.best[i] = best_ids, best


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = 5, every: int = 50, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Queries: the given rows, or those whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    base, base_path = written(integer_vectors(embeddings).withColumn("n", F.monotonically_increasing_id()), "vectors")
    asked = integer_vectors(queries) if queries is not None else base.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows, width, top = base.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    n_asked, q_width, q_top = asked.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    width, top = max(width or 0, q_width or 0), float(max(top or 0, q_top or 0))
    sample = base.orderBy(F.xxhash64("vec_id", "n"), "n").limit(SAMPLE).toArrow()
    shared = spark.sparkContext.broadcast(choose_pivots(_matrix(sample.column("v"), width)))
    whole = np.int16 if top < 2**30 else np.int64
    blocks = max(1, -(-n_asked // block))
    stripes = max(1, min(-(-rows // chunk), max(2 * spark.sparkContext.defaultParallelism, -(-rows // STRIPE))))

    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            columns = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (v.astype(whole), pivot_table(v, shared.value, top))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("n"), *columns], names=["vec_id", "n", "v", "table"])

    def tabled(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "n", "v").mapInArrow(with_table, "vec_id long, n long, v binary, table binary")

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int):
        return F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")

    single = asked.dropDuplicates(["vec_id", "v"]).withColumn("n", F.xxhash64("vec_id", "v"))
    asks = tabled(single).select("*", own(blocks).alias("block"), spread(stripes).alias("stripe"), F.lit(0).alias("role"))
    candidates = tabled(base).select("*", own(stripes).alias("stripe"), spread(blocks).alias("block"), F.lit(1).alias("role"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
        search: Search | None = None

        def part(role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            table = pa.Table.from_batches(held[role])
            held[role] = []
            v, d = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("v", whole), ("table", np.float32)))
            return table.column("vec_id").to_numpy(), v.reshape(table.num_rows, -1), d.reshape(table.num_rows, -1)

        def flush() -> None:
            nonlocal search
            if held[0]:
                search = Search(*part(0), top, k)
            if held[1]:
                candidates = part(1)
                if search:
                    search.add(*candidates)

        def result() -> pa.RecordBatch:
            found = [len(b) for b in search.best] if search else []
            keys = [xxhash.xxh64_intdigest(q.astype(np.int64).tobytes()) >> 1 for q in search.q] if search else []
            columns = [np.repeat(search.ids, found), np.repeat(keys, found), np.concatenate(search.best_ids), np.concatenate(search.best)] if sum(found) else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("block", "stripe", "role")])
            cuts = np.flatnonzero((np.diff(where) != 0).any(0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                here = tuple(where[:2, lo].tolist())
                if here != at:
                    flush()
                    yield result()
                    at, search = here, None
                role = int(where[2, lo])
                for a in range(lo, hi, chunk):
                    held[role].append(batch.slice(a, min(chunk, hi - a)))
                    if role and sum(b.num_rows for b in held[1]) >= chunk:
                        flush()
        flush()
        yield result()

    order = ("block", "stripe", "role")
    dealt = asks.unionByName(candidates).repartition(*order[:2]).sortWithinPartitions(*order)
    found = dealt.select("vec_id", "v", "table", *order).mapInArrow(tile, "query_id long, query_key long, vec_id long, score long")
    found, _ = written(found, "found")
    drop(spark, base_path)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
