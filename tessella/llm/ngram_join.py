"""Operator 5: exact n-gram Jaccard join as a blocked sparse matrix product.

The document by n-gram incidence matrix A is multiplied with its transpose only where a product can matter:

1. Documents with equal sets of shingles form a class; a class is one row of A.
2. Of each row only the prefix enters: with a set of n shingles, a partner at or above the threshold shares at
   least ceil(t n) of them, so it holds one of the first n - ceil(t n) + 1 in any order that all rows share. The
   order puts shingles that are known to be common last, then goes by hash. Which shingles count as common
   changes the work only, never the result.
3. Column blocks of the product are postings of one shingle. Their partial overlaps are accumulated by pair, and
   pairs whose sizes are too different, or whose overlap is too small for what can lie beyond the prefixes, are discarded. To keep copies of one text from giving all their pairs, a
   posting first gives products with its smallest row only; what these link becomes one label.
4. Rows of different labels that still meet in a posting are dealt to row blocks. Of two blocks that meet the full product is
   taken in one task, overlaps are compared with the threshold in integers, and only links leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_batches, filter_place, flat, id_filter, mix, passes, shingles, tidy, words
from tessella.operators.graph import connected_components
from tessella.storage import staged

#: Shingles counted as common at most (4 MB); bounds what is broadcast. More of them are simply not moved to the end.
COMMON_LIMIT = 500_000
#: Times that a shingle occurs among the texts of one flush before it is reported as maybe common, and in all.
COMMON_LOCAL, COMMON_TOTAL = 2, 8
#: Only hashes below this can be common: prefixes take about the lowest fifth, and what moves up after common ones.
COMMON_BELOW = np.uint64(int(0.35 * 2**64))
_FLUSH = 4_000_000
#: Shingles in a block of rows: 8 MB.
BLOCK_ITEMS = 1_000_000


def _batch_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*words(*flat(batch.column(1))), k)


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that many rows hold, ascending: a hint for the order, at most COMMON_LIMIT of them."""

    def count(batches):
        held, size = [], 0

        def flush():
            if not held:
                return
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COMMON_LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["s", "n"])

        for b in batches:
            s, at = _batch_sets(b, k)
            for i in range(len(at) - 1):
                u = s[at[i] : at[i + 1]]
                held.append(np.unique(u[u < COMMON_BELOW]))
                size += len(held[-1])
            if size > _FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()

    rows = (
        docs.mapInArrow(tidy(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TOTAL)
        .orderBy(F.desc("n"), "s").limit(COMMON_LIMIT).select("s").toPandas()
    )
    return np.sort(rows["s"].to_numpy(dtype=np.int64, copy=True).view(np.uint64))


def _rows_of(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n, two 64-bit sums that stand for the set, and the prefix."""

    def rows(batches):
        for b in batches:
            s, at = _batch_sets(b, k)
            n, x, y, prefix = [], [], [], []
            for i in range(len(at) - 1):
                u = np.unique(s[at[i] : at[i + 1]])
                m = len(u)
                n.append(m)
                x.append(int(mix(u).sum().view(np.int64)) if m else 0)
                y.append(int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if m else 0)
                keep = m - -(-percent * m // 100) + 1 if m else 0
                if m and len(common):
                    often = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u
                    u = np.concatenate([u[~often], u[often]])
                prefix.append(u[:keep].view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)),
                pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)),
            )
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), lists], names=["doc_id", "n", "x", "y", "prefix"])

    return docs.mapInArrow(tidy(rows), "doc_id long, n long, x long, y long, prefix array<long>")


def _sets(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """Sorted shingles of the documents that the filter lets pass, as little-endian bytes."""

    def sets(batches):
        for b in batches:
            keep = passes(bits, b.column(2), b.column(3))
            if not keep.any():
                continue
            b = b.filter(pa.array(keep))
            s, at = _batch_sets(b, k)
            out = [np.unique(s[at[i] : at[i + 1]]).tobytes() for i in range(len(at) - 1)]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 64), pa.array(out[i : i + 64], pa.binary())], names=["id", "items"])

    return docs.select("doc_id", "text", *filter_place("doc_id")).mapInArrow(tidy(sets), "id long, items binary")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    bits = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _sets(docs, k, bits)
    both = (
        pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    )

    def product(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i = np.searchsorted(y, x)
                inter = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidy(product), "a long, b long")


def _overlaps(items: np.ndarray, at: np.ndarray, rows: np.ndarray):
    """(row, its overlaps with all rows) of a cell: a sparse product by the postings of the cell's columns.

    items: the columns of one row after the other, at: where each row's begin."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.argsort(items, kind="stable")
    _, column, count = np.unique(items[order], return_inverse=True, return_counts=True)
    begin = np.concatenate([[0], np.cumsum(count)])
    posting = owner[order]
    of = np.empty(len(items), np.int64)
    of[order] = column
    for i in rows:
        cols = of[at[i] : at[i + 1]]
        cols = cols[count[cols] > 1]
        c = count[cols]
        if len(c):
            place = np.repeat(begin[cols] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            yield i, np.bincount(posting[place], minlength=n)


def _not_of_largest(label: np.ndarray) -> np.ndarray:
    """Rows whose label isn't the most frequent: each pair of different labels holds one."""
    values, root, size = np.unique(label, return_inverse=True, return_counts=True)
    return np.flatnonzero(root != int(size.argmax()))


def _by_cell(batches):
    """(cell, its columns) from rows that are sorted by their first two columns, the cell; numbers as arrays, sets as bytes."""
    now, held = None, []

    def columns():
        t = pa.Table.from_batches(held)
        return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in t.columns[2:]]

    for b in batches:
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else []
        for i, j in zip(begin, [*begin[1:], len(x)]):
            if (x[i], y[i]) != now and held:
                yield now, columns()
                held = []
            now = (x[i], y[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, columns()


def _block_products(postings: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between rows of postings (s, id, n, hub, c) with different labels c: enough of them to join all labels that
    any such links join.

    Rows are dealt to blocks: by the hub with which they share the most postings, and within a hub so that a block holds about
    BLOCK_ITEMS shingles. A cell is two blocks that meet in a posting under different labels. The product over prefixes
    tells which rows of a cell can have a partner there; only their full sets go to the cell, once each, and are multiplied.
    Pairs exist within a cell's task only."""
    best = postings.groupBy("id", "n", "hub").agg(F.count("*").alias("m")).groupBy("id", "n").agg(F.max(F.struct("m", (-F.col("hub")).alias("minus"))).alias("x"))
    best = best.select("id", "n", (-F.col("x.minus")).alias("hub"))
    deal = best.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).alias("parts"))
    blocks = best.join(deal, "hub").select("id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    rows = staged(postings.select("s", "id", "n", "c").join(blocks, "id"), "blocks")
    met = rows.groupBy("s", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    cells = (
        met.alias("l").join(met.alias("r"), "s").where("l.block <= r.block AND (l.low < l.high OR r.low < r.high OR l.low <> r.low)")
        .where("l.block < r.block OR l.low < l.high").select("s", F.col("l.block").alias("x"), F.col("r.block").alias("y"))
    )
    sides = cells.select("s", "x", "y", F.col("x").alias("block")).unionByName(cells.where("x <> y").select("s", "x", "y", F.col("y").alias("block")))
    there = rows.join(sides, ["s", "block"]).select("x", "y", "id", "s", "n", "c", "block")

    def candidates(batches):
        for (x, y), (ids, s, n, c, block) in _by_cell(batches):
            order = np.argsort(ids, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
            ids, n, c, block = ids[order][at], n[order][at], c[order][at], block[order][at]
            alive = np.zeros(len(ids), bool)
            for i, overlap in _overlaps(s[order], np.r_[at, len(order)], _not_of_largest(c)):
                most = np.maximum(n, n[i])
                able = overlap + -(-percent * most // 100) - 1 >= -(-percent * (n + n[i]) // (100 + percent))
                able &= (100 * np.minimum(n, n[i]) >= percent * most) & (c != c[i]) & (overlap > 0)
                if x != y:
                    able &= block != block[i]
                if able.any():
                    alive |= able
                    alive[i] = True
            if alive.any():
                m = int(alive.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, x)), pa.array(np.full(m, y)), pa.array(ids[alive]), pa.array(c[alive])], names=["x", "y", "id", "c"])

    sorted_ = there.repartition("x", "y").sortWithinPartitions("x", "y")
    members = staged(sorted_.mapInArrow(tidy(candidates), "x long, y long, id long, c long"), "cells")
    bits = id_filter(members.select("id").distinct())
    filled = members.join(_sets(docs, k, bits), "id").select("x", "y", "id", "c", "items")

    def product(batches):
        for _, (ids, c, raw) in _by_cell(batches):
            sets = [np.frombuffer(h, np.uint64) for h in raw]
            n = np.array([len(x) for x in sets])
            links = []
            for i, overlap in _overlaps(np.concatenate(sets), np.r_[0, np.cumsum(n)], _not_of_largest(c)):
                hit = np.flatnonzero((100 * overlap >= percent * (n[i] + n - overlap)) & (c != c[i]))
                _, one = np.unique(c[hit], return_index=True)
                links += [(int(ids[i]), int(ids[j])) for j in hit[one]]
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return filled.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(tidy(product), "a long, b long")


def _incidence(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, ...]:
    """All rows, those with an id, their sets, the classes of equal sets, and the postings that several classes share."""
    spark = df.sparkSession
    arrow_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    common = _common(known, k)
    rows = staged(_rows_of(known, k, percent, common), "rows")
    classes = rows.where("n > 0").groupBy("n", "x", "y").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"))
    classes = staged(classes, "classes")
    postings = classes.select("id", "n", F.explode("prefix").alias("s"))
    hubs = postings.groupBy("s").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = staged(postings.join(hubs, "s"), "shared")
    return docs, known, rows, classes, shared


def class_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links of the join. First a, b with a < b: each pair of classes that links, by the smallest doc_id of each. Then one row per
    row of df: doc_id, n_shingles, class_id (null where it has no set), n_links, the distinct doc_ids that it links with, copies too.

    No pair is left out because others already join its classes, so the first table has as many rows as there are links."""
    docs, known, rows, classes, shared = _incidence(df, id_col, text_col, k, percent)
    found = _block_products(shared.select("s", "id", "n", "hub", F.col("id").alias("c")), known, k, percent)
    links = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    of = rows.where("n > 0").join(classes.select("n", "x", "y", "id"), ["n", "x", "y"])
    held = staged(of.groupBy("id").agg(F.countDistinct("doc_id").alias("copies")), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(held.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("near"))
    per = held.join(near, "id", "left").select("id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    members = (
        rows.join(classes.select("n", "x", "y", "id"), ["n", "x", "y"], "left").join(per, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    blank = docs.where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return links, members.unionByName(blank)


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs outside space and \\t to \\r with A-Z lower-cased; a set holds the distinct k-word shingles, of a
    text with fewer words the whole sequence. Two rows link when 100 |intersection| >= percent |union|. A null or
    blank text has an empty set and no link. Rows with equal sets are one class, so copies cost one row. Rows that
    repeat a doc_id must repeat its text; a null doc_id takes no part and keeps a null component. An empty table
    gives an empty one; other columns are ignored. Set elements are 64-bit hashes.
    """
    docs, known, rows, classes, shared = _incidence(df, id_col, text_col, k, percent)
    size = classes.select("id", "n")

    # Beyond its prefix a row of n has ceil(t n) - 1 shingles, so a pair shares at most its overlap within the prefixes
    # and the larger of these numbers; it needs ceil(t / (1 + t) (n + m)).
    needed = f"CAST(ceil({percent} * (n + m) / {100 + percent}) AS BIGINT)"
    beyond = f"CAST(ceil({percent} * greatest(n, m) / 100) AS BIGINT) - 1"
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    stars = (
        shared.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b"), "n").agg(F.count("*").alias("overlap"))
        .join(size.select(F.col("id").alias("b"), F.col("n").alias("m")), "b")
    )
    # a hub stands for some of its pair's shared postings only: half of the bound is enough to try the pair here
    stars = staged(stars.where(fits).where(f"2 * overlap + {beyond} >= {needed}").select("a", "b"), "stars")
    links = staged(_verified(stars, known, k, percent), "links")
    label = staged(connected_components(links, "a", "b"), "label")
    labelled = shared.join(label, "id", "left").select("s", "id", "n", "hub", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    open_ = staged(labelled.join(mixed, "s"), "open")
    links = links.unionByName(_block_products(open_, known, k, percent))
    label = staged(connected_components(links, "a", "b"), "label")
    members = (
        rows.join(classes.select("n", "x", "y", "id"), ["n", "x", "y"], "left").join(label, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("component_id"))
    )
    return members.unionByName(docs.where("doc_id IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
