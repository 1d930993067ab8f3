"""Operator 3: exact top-k inner products by aggregation without random access.

The rows are dealt into blocks. A block keeps one list per component, sorted by value. For a query the list of a component with
a positive weight is read from its top, with a negative weight from its bottom: all lists step by step to the same depth. What is
read is added to the partial score of its row. An unread component adds at least what the list's far end gives and at most what
the value at the depth gives, so each row has a lower and an upper bound, and a row that no list has shown yet the upper bound
of an outsider. With L the k-th best lower bound (or the k-th best score of the blocks before), reading goes on while outsiders
could reach L. Then rows whose upper bound is below L are out, and when few are left their final scores are resolved. A query
for which that doesn't happen reads the lists to their ends, where the partial scores are the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import tidy
from tessella.storage import scratch

#: Rows of a block, queries that go to the executors in one pass, queries that read a block at once, and steps in which its lists are read.
BLOCK, QUERY_BLOCK, READERS, STEPS = 4096, 2048, 256, 32
_LONG = (1 << 63) - 1


def quantised(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows, floor(1024 x) of their components) of the vectors by length, without those that are null, empty or hold null
    or non-finite components."""
    size = np.diff(column.offsets.to_numpy()) * ~column.is_null().to_numpy(zero_copy_only=False)
    begin, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        with np.errstate(over="ignore"):
            x = np.floor(1024 * values[begin[rows][:, None] + np.arange(d)])
        ok = np.isfinite(x).all(axis=1)
        yield d, rows[ok], x[ok]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows and queries: doubles where these are exact, else Python's integers, held to long."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2.0**53:
        return (x @ q.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    bq = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape)
    out = [[max(-_LONG - 1, min(_LONG, int(sum(a * b for a, b in zip(r, s))))) for s in bq] for r in big]
    return np.array(out, np.int64).reshape(len(x), len(q))


class Reading:
    """Some queries that read a block's lists from their ends inwards."""

    def __init__(self, x: np.ndarray, order: np.ndarray, rank: np.ndarray, q: np.ndarray):
        """x: rows by components; order: rows by value, rank: place of each row in it, both by component; q: queries by components."""
        self.x, self.order, self.rank = x, order, rank
        self.plus, self.minus = np.maximum(q, 0), np.minimum(q, 0)
        self.partial, self.depth = np.zeros((len(x), len(q))), 0

    def read(self, depth: int) -> None:
        """Go on to the depth in all lists."""
        n = len(self.x)
        for d in range(self.x.shape[1]):
            for weights, rows in ((self.plus[:, d], self.order[n - depth : n - self.depth, d]), (self.minus[:, d], self.order[self.depth : depth, d])):
                if weights.any():
                    self.partial[rows] += self.x[rows, d][:, None] * weights
        self.depth = depth

    def _ends(self, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The values that are read last, from the top and from the bottom, where lists are read to the depth."""
        column, depth = np.arange(self.x.shape[1]), depth or self.depth
        return self.x[self.order[-depth], column], self.x[self.order[depth - 1], column]

    def outsider(self, depth: int = 0) -> np.ndarray:
        """The upper bound of a row that no list has shown down to the depth."""
        top, bottom = self._ends(depth)
        return self.plus @ top + self.minus @ bottom

    def _with_unread(self, for_plus: np.ndarray, for_minus: np.ndarray, which: np.ndarray) -> np.ndarray:
        n = len(self.x)
        above, below = self.rank < n - self.depth, self.rank >= self.depth
        return self.partial[:, which] + above.astype(float) @ (self.plus[which] * for_plus).T + below.astype(float) @ (self.minus[which] * for_minus).T

    def upper(self, which: np.ndarray) -> np.ndarray:
        return self._with_unread(*self._ends(), which)

    def lower(self, which: np.ndarray) -> np.ndarray:
        column = np.arange(self.x.shape[1])
        return self._with_unread(self.x[self.order[0], column], self.x[self.order[-1], column], which)

    def keep(self, which: np.ndarray) -> None:
        """Go on with some of the queries."""
        self.plus, self.minus, self.partial = self.plus[which], self.minus[which], self.partial[:, which]


class Lists:
    """The sorted lists of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(x))[:, None] * np.ones((1, x.shape[1]), np.int64), axis=0)
        #: Share of the lists that each query had read when it stopped.
        self.depths: list[float] = []

    def top(self, q_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the rows that can be among the k best; least: known k-th best scores, raised here."""
        out = []
        for i in range(0, len(q), READERS):
            part = np.arange(i, min(i + READERS, len(q)))
            for j, rows, s in self._read(q_ids, q, part, k, least):
                order = np.lexsort((self.ids[rows], -s.astype(object) if s.size and s.min() == -_LONG - 1 else -s))[:k]
                if len(order) == k:
                    least[j] = max(least[j], float(s[order[-1]]))
                out.append((int(q_ids[j]), self.ids[rows[order]], s[order]))
        return out

    def _read(self, q_ids: np.ndarray, q: np.ndarray, open_: np.ndarray, k: int, least: np.ndarray):
        """(place of the query, rows that are left, their scores)."""
        n = len(self.ids)
        own = self.ids[:, None] == q_ids[open_][None, :]
        if n and np.abs(self.x).max() * np.abs(q[open_]).max() * self.x.shape[1] >= 2.0**52:  # sums would not be exact in doubles
            scores = _exact(self.x, q[open_])
            for j, i in enumerate(open_):
                yield i, np.flatnonzero(~own[:, j]), scores[~own[:, j], j]
            return
        reading = Reading(self.x, self.order, self.rank, q[open_])
        fresh = ~np.isfinite(least[open_])  # no block before has given these a k-th best score: their lower bounds have to
        for step in range(1, STEPS + 1):
            depth = -(-n * step // STEPS)
            if not len(open_):
                break
            if depth < n and not fresh.any() and not (reading.outsider(depth) < least[open_]).any():
                continue  # outsiders of all queries can still qualify there: lists are read on without a look at bounds
            reading.read(depth)
            if depth == n:
                break
            if step % 4 == 0 and n - 1 > k and fresh.any():
                new = np.flatnonzero(fresh)
                lower = np.where(own[:, new], -np.inf, reading.lower(new))
                least[open_[new]] = np.maximum(least[open_[new]], np.partition(lower, n - k, axis=0)[n - k])
            at = np.flatnonzero(reading.outsider() < least[open_])
            if not len(at):
                continue
            alive = ~own[:, at] & (reading.upper(at) >= least[open_[at]])
            few = alive.sum(axis=0) <= max(4 * k, n // 64)
            for j in np.flatnonzero(few):
                rows = np.flatnonzero(alive[:, j])
                self.depths.append(depth / n)
                yield open_[at[j]], rows, _exact(self.x[rows], q[open_[at[j]]][None, :])[:, 0]
            if few.any():
                left = np.setdiff1d(np.arange(len(open_)), at[few])
                reading.keep(left)
                open_, own, fresh = open_[left], own[:, left], fresh[left]
        for j, i in enumerate(open_):  # all lists were read to their ends: the partial scores are the scores
            self.depths.append(1.0)
            yield i, np.flatnonzero(~own[:, j]), reading.partial[~own[:, j], j].astype(np.int64)


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query (same columns as df) the k rows with the highest integer inner
    products of floor(1024 x), ties to the smaller vec_id, all where there are fewer; rows with the query's id are left out.

    Vectors that are null or hold null or non-finite components (or whose 1024-fold is beyond a double) take no part, on either side, nor do null ids; only vectors of
    the query's length are compared. Rows that repeat an id are rows of their own; of queries that repeat an id the smallest
    vector that takes part is the query. Scores beyond a long are held to its range. Other columns are ignored; empty tables give an empty result.
    Queries go through the rows in blocks of QUERY_BLOCK, each a pass over the rows: what is sent to executors is bounded. Where
    there is more than one block, the results of each are written to the shared folder, so that the plan doesn't grow with them.
    """
    spark = df.sparkSession

    def vectors(t):
        return t.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    schema = "query_id long, vec_id long, score long"
    rows = vectors(df)

    def passed(block):
        sets: dict = {}
        for d, at, x in quantised(pa.array([v for _, v in block], pa.list_(pa.float64()))):
            sets[d] = (np.array([block[i][0] for i in at], np.int64), x)

        def run(batches):
            least = {d: np.full(len(x[0]), -np.inf) for d, x in sets.items()}
            found: dict = {}
            waiting: dict = {d: [] for d in sets}

            def search(d):
                ids, x = (np.concatenate(c) for c in zip(*waiting[d]))
                whole = len(ids) if len(ids) < BLOCK else len(ids) // BLOCK * BLOCK
                for a in range(0, whole, BLOCK):
                    for q, near, s in Lists(ids[a : a + BLOCK], x[a : a + BLOCK]).top(*sets[d], k, least[d]):
                        i, t = found.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        i, t = np.concatenate([i, near]), np.concatenate([t, s])
                        best = sorted(range(len(i)), key=lambda z: (-int(t[z]), int(i[z])))[:k]
                        found[q] = (i[best], t[best])
                waiting[d] = [(ids[whole:], x[whole:])] if whole < len(ids) else []

            for b in batches:
                ids = b.column(0).to_numpy()
                for d, at, x in quantised(b.column(1)):
                    if d in sets:
                        waiting[d].append((ids[at], x))
                        if sum(len(i) for i, _ in waiting[d]) >= BLOCK:
                            search(d)
            for d in sets:
                if waiting[d]:
                    search(d)
            if found:
                names = np.repeat(list(found), [len(i) for i, _ in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(np.concatenate([f[j] for f in found.values()]), pa.int64()) for j in (0, 1))], names=["query_id", "vec_id", "score"])

        return rows.mapInArrow(tidy(run), schema)

    path, block = None, []

    def put(block):
        nonlocal path
        path = path or scratch(spark, "top")
        passed(block).write.mode("append").parquet(path)

    asked = vectors(queries).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    for r in asked.groupBy("vec_id").agg(F.min("v").alias("v")).toLocalIterator():
        if len(block) == QUERY_BLOCK:
            put(block)
            block = []
        block.append((r.vec_id, list(r.v)))
    if path and block:
        put(block)
    out = spark.read.schema(schema).parquet(path) if path else passed(block) if block else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * r.c[i])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.c) = len(r.c)
  WHERE q.vec_id % 100 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM k WHERE "rank" <= 10
"""
