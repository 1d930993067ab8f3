"""Operator 7: benchmark decontamination by greedy string tiling.

Texts share a seed with a benchmark item where min_tile tokens in a row are the same. Where the item's tokens under
shared seeds could reach the threshold, tiles are laid as in running Karp-Rabin greedy string tiling: the longest common
stretch that overlaps no tile is marked again and again until none of min_tile tokens is left. The share of the item's
tokens under tiles decides, so an item whose sentences come in another order is found as well.
Each text is judged by itself in one pass over the corpus; nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_batches, _BASE, flat, mix, NOT_WORD, tidy, words

#: Bytes of benchmark text that go to the executors in one pass; larger benchmarks take several passes over the corpus.
BENCHMARK_BYTES = 16_000_000
_M = (1 << 61) - 1
#: Pairs of places that are compared at once.
_PAIRS = 1 << 20


def _hashes(tokens: list[int], s: int) -> list[int]:
    """Karp-Rabin hashes of all windows of s tokens."""
    if len(tokens) < s:
        return []
    top, h = pow(_BASE, s, _M), 0
    out = []
    for i, t in enumerate(tokens):
        h = (h * _BASE + t) % _M
        if i >= s:
            h = (h - tokens[i - s] * top) % _M
        if i >= s - 1:
            out.append(h)
    return out


def _free(marked: list[bool]) -> list[tuple[int, int]]:
    runs, i = [], 0
    while i < len(marked):
        if marked[i]:
            i += 1
            continue
        j = i
        while j < len(marked) and not marked[j]:
            j += 1
        runs.append((i, j))
        i = j
    return runs


def _windows(tokens: list, marked: list[bool], s: int) -> dict[int, list[int]]:
    """Where each hash of s unmarked tokens in a row stands."""
    out = defaultdict(list)
    for i, j in _free(marked):
        for p, h in enumerate(_hashes(tokens[i:j], s)):
            out[h].append(i + p)
    return out


def _before(tokens: list, marked: list[bool], none: int) -> np.ndarray:
    """The token before each place; none where it is marked or there is none."""
    return np.array([none, *(none if m else t for t, m in zip(tokens, marked))], np.int64)


def tiles(a: list[int], b: list[int], min_tile: int = 5, start: int = 20) -> list[tuple[int, int, int]]:
    """(position in a, position in b, length) of the greedy tiles of two token lists, longest first; ties to the
    smaller position in a, then in b. None stands in b where nothing may match."""
    codes: dict = {None: -3}
    a, b = ([codes.setdefault(t, len(codes)) for t in x] for x in (a, b))
    mark_a, mark_b, out = [False] * len(a), [x < 0 for x in b], []
    s = max(min_tile, min(start, len(a)))
    while True:
        table, other = _windows(a, mark_a, s), _windows(b, mark_b, s)
        before_a, before_b = _before(a, mark_a, -1), _before(b, mark_b, -2)
        found, again = [], 0
        for h in table.keys() & other.keys():
            xs, ys = np.array(table[h]), np.array(other[h])
            rows = max(1, _PAIRS // len(ys))
            for i in range(0, len(xs), rows):  # only a match that isn't part of one that begins before it counts
                first, second = np.nonzero(before_a[xs[i : i + rows], None] != before_b[ys][None, :])
                for x, y in zip(xs[i + first].tolist(), ys[second].tolist()):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and not mark_a[x + k] and not mark_b[y + k] and a[x + k] == b[y + k]:
                        k += 1
                    if k >= s:
                        found.append((k, x, y))
                        again = max(again, k)
        if again > 2 * s:
            s = again
            continue
        found = [(-k, x, y) for k, x, y in found]
        heapq.heapify(found)
        while found:
            k, x, y = heapq.heappop(found)
            k = -k
            if any(mark_a[x : x + k]) or any(mark_b[y : y + k]):
                run = 0  # occluded: what is left of it, if long enough, waits for its turn
                for d in range(k + 1):
                    if d < k and not mark_a[x + d] and not mark_b[y + d]:
                        run += 1
                        continue
                    if run >= s:
                        heapq.heappush(found, (-run, x + d - run, y + d - run))
                    run = 0
                continue
            mark_a[x : x + k] = [True] * k
            mark_b[y : y + k] = [True] * k
            out.append((x, y, k))
        if s > 2 * min_tile:
            s //= 2
        elif s > min_tile:
            s = min_tile
        else:
            return out


def _seeds(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-token windows from each token on, and which of them lie in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * np.uint64(_BASE) + h[i : i + n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(s), text[:n] == text[k - 1 :]


class Benchmark:
    """Tokens of items and an index of their seeds."""

    def __init__(self, items: list[tuple], min_tile: int, coverage: float):
        self.ids, self.min_tile, self.coverage = [i for i, _ in items], min_tile, coverage
        data, off = flat(pa.array([t for _, t in items], pa.string()))
        h, first = words(data, off, NOT_WORD)
        self.tokens = [h[first[i] : first[i + 1]].tolist() for i in range(len(items))]
        s, ok = _seeds(h, first, min_tile)
        at = np.flatnonzero(ok)
        item = np.searchsorted(first, at, "right") - 1
        order = np.argsort(s[at], kind="stable")
        self.seed, self.item, self.pos = s[at][order], item[order], (at - first[item])[order]

    def matches(self, data: np.ndarray, off: np.ndarray):
        """(row, item, covered, tiles, longest) for each text and item at or above the threshold."""
        k = self.min_tile
        h, first = words(data, off, NOT_WORD)
        s, ok = _seeds(h, first, k)
        if not len(self.seed) or not len(s):
            return
        lo = np.searchsorted(self.seed, s, "left")
        hit = np.flatnonzero(ok & (self.seed[np.minimum(lo, len(self.seed) - 1)] == s))
        rows = np.searchsorted(first, hit, "right") - 1
        texts, begin = np.unique(rows, return_index=True)
        for row, own_hits in zip(texts.tolist(), np.split(hit, begin[1:])):
            shared = defaultdict(lambda: (set(), set()))
            for p in own_hits.tolist():
                j = int(lo[p])
                while j < len(self.seed) and self.seed[j] == s[p]:
                    own, theirs = shared[int(self.item[j])]
                    own.update(range(int(self.pos[j]), int(self.pos[j]) + k))
                    theirs.update(range(p, p + k))
                    j += 1
            for item, (own, theirs) in sorted(shared.items()):
                a = self.tokens[item]
                if len(own) < self.coverage * len(a):
                    continue  # no tiling can cover more than the tokens under shared seeds
                b, last = [], None
                for p in sorted(theirs):
                    if last is not None and p != last + 1:
                        b.append(None)
                    b.append(int(h[p]))
                    last = p
                laid = tiles(a, b, k)
                covered = sum(t[2] for t in laid)
                if covered >= self.coverage * len(a):
                    yield row, item, covered / len(a), len(laid), max(t[2] for t in laid)


def _blocks(benchmark: DataFrame):
    """Items in blocks of at most BENCHMARK_BYTES of text, or one item."""
    held, size = [], 0
    for r in benchmark.toLocalIterator():
        n = len(r.text.encode())
        if held and size + n > BENCHMARK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def contaminated(df: DataFrame, benchmark: DataFrame, min_tile: int = 5, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile for each row of df and item of benchmark (item_id, text) whose
    tokens lie under tiles by the share coverage at least.

    Tokens are runs of letters, digits and non-ASCII characters, lower-cased. Null and empty texts match nothing; items of
    fewer than min_tile tokens are too short to tell and match nothing. Repeated rows give repeated results, clean
    texts none; other columns are ignored; an empty table on either side gives an empty result.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text IS NOT NULL AND text <> ''")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items):

        def run(batches, block=block):
            index = Benchmark(block, min_tile, coverage)
            for b in batches:
                ids = b.column(0)
                got = [(ids[r].as_py(), index.ids[i], c, n, m) for r, i, c, n, m in index.matches(*flat(b.column(1)))]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))],
                        names=["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                    )

        out = out.unionByName(docs.mapInArrow(tidy(run), schema))
    return out


def without_contaminated(df: DataFrame, benchmark: DataFrame, min_tile: int = 5, coverage: float = 0.6, text_col: str = "text") -> DataFrame:
    """The rows of df that no item contaminates, with all their columns; rows are judged where they are, nothing is joined."""
    arrow_batches(df.sparkSession)
    schema, lowered = df.schema, "__lowered_text"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text IS NOT NULL AND text <> ''")
    for block in _blocks(items):

        def run(batches, block=block):
            index = Benchmark(block, min_tile, coverage)
            for b in batches:
                last = b.num_columns - 1
                bad = {m[0] for m in index.matches(*flat(b.column(last)))}
                kept = b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b
                yield kept.select(list(range(last)))

        df = df.select("*", F.lower(F.col(text_col).cast("string")).alias(lowered)).mapInArrow(tidy(run), schema)
    return df
