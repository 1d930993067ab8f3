"""Image pairs and descriptor matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a block of descriptors, distances that are held at once, and pairs of descriptors that are compared one by one at once.
BLOCK, CELLS, PAIRS = 1 << 20, 1 << 21, 1 << 14


def exhaustive_pairs(images: DataFrame, id_col: str = "image") -> DataFrame:
    """All (i, j), i < j: the quadratic result is what is asked for; image tables are small."""
    a, b = images.select(F.col(id_col).alias("i")), images.select(F.col(id_col).alias("j"))
    return a.join(b, F.col("i") < F.col("j"))


def sequential_pairs(images: DataFrame, window: int, id_col: str = "image") -> DataFrame:
    """(i, j) at most window positions apart in id order: offsets are exploded and joined by equality, not by a band."""
    pos = images.select(F.col(id_col).alias("id"), (F.row_number().over(Window.orderBy(id_col)) - 1).alias("pos"))
    near = pos.select(F.col("id").alias("i"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.col("pos") + d)).alias("pos"))
    return near.join(pos.select(F.col("id").alias("j"), "pos"), "pos").select("i", "j")


def symmetrised(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").distinct()


class _Nearest:
    """The nearest and the second nearest of all columns for each row, and the nearest row for each column, of descriptors that
    come some columns at a time. Distances are told by a matrix product where its rounding can't matter, and by sums of squared
    differences, one after the other, where it can; ties go to the lower keypoint. A column that is there again counts twice."""

    def __init__(self, kp: np.ndarray, v: np.ndarray):
        order = np.argsort(kp)
        self.kp, self.v = kp[order], v[order]
        self.norm = (self.v * self.v).sum(axis=1)
        self.best, self.second, self.to = np.full(len(kp), np.inf), np.full(len(kp), np.inf), np.full(len(kp), -1)
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.exact = self._exact(v)
        self.short = self.v.astype(self.exact or float, copy=False)

    @staticmethod
    def _exact(v: np.ndarray) -> type | None:
        """The shorter type in which products of these numbers are exact, as they are whole and small; none if they aren't."""
        if not (np.isfinite(v).all() and (v == np.rint(v)).all()):
            return None
        most = 16.0 * v.shape[1] * np.abs(v).max(initial=0) ** 2
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else None

    def add(self, kp: np.ndarray, v: np.ndarray, again: np.ndarray) -> None:
        step, order = max(1, CELLS // len(self.kp)), np.argsort(kp)
        for i in range(0, len(kp), step):
            some = order[i : i + step]
            self._tile(kp[some], v[some], again[some])

    def _tile(self, kp: np.ndarray, v: np.ndarray, again: np.ndarray) -> None:
        norm, types = (v * v).sum(axis=1), (self.exact, self._exact(v))
        exact = None not in types
        kind = np.result_type(*types) if exact else np.dtype(float)
        d = (self.short if self.short.dtype == kind else self.v) @ v.astype(kind).T
        d *= -2
        d += self.norm[:, None].astype(kind)
        d += norm[None, :].astype(kind)
        if exact:  # equal distances, of which bits have many, are not listed: rows and columns are in order of keypoints, so the first is the lowest
            every, c, r = np.arange(len(d)), d.argmin(axis=1), d.argmin(axis=0)
            self.columns.append((kp, r, d[r, np.arange(len(kp))].astype(float)))
            e = d[every, c].astype(float)
            d[every, c] = np.inf
            return self._update(every, kp[c], e, np.where(again[c], e, d.min(axis=1)))
        slack = (v.shape[1] + 8) * 4 * np.finfo(float).eps * (self.norm + norm.max())
        if np.isfinite(d).all():
            if self.columns:
                limit = self.second
            else:
                limit = np.partition(d, 1, axis=1)[:, 1] + slack if len(kp) > 1 else self.second
            near = d <= (limit + slack)[:, None]
            near |= d <= d.min(axis=0) + 2 * slack.max()
            row, col = np.nonzero(near)
        else:
            row, col = (a.ravel() for a in np.indices(d.shape))
        d = np.concatenate([np.cumsum((self.v[row[i : i + PAIRS]] - v[col[i : i + PAIRS]]) ** 2, axis=1)[:, -1] for i in range(0, len(row), PAIRS)])

        order = np.lexsort((kp[col], d, row))
        r, c, e = row[order], col[order], d[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        follows = np.r_[r[1:] == r[:-1], False]
        after = np.where(again[c], e, np.where(follows, np.r_[e[1:], np.inf], np.inf))[first]
        self._update(r[first], kp[c[first]], e[first], after)

        order = np.lexsort((self.kp[row], d, col))
        first = order[np.r_[True, col[order][1:] != col[order][:-1]]]
        self.columns.append((kp[col[first]], row[first], d[first]))

    def _update(self, r: np.ndarray, to: np.ndarray, e: np.ndarray, after: np.ndarray) -> None:
        """For rows r: a tile's nearest keypoint, its distance and the second distance."""
        better = (e < self.best[r]) | ((e == self.best[r]) & (to < self.to[r]))
        self.second[r] = np.where(better, np.minimum(self.best[r], after), np.minimum(self.second[r], e))
        self.best[r], self.to[r] = np.where(better, e, self.best[r]), np.where(better, to, self.to[r])

    def rows(self, factor: float) -> tuple[np.ndarray, ...]:
        """For each column: its keypoint, the nearest row's, their distance, and whether that row's nearest is this column and passes the ratio test."""
        k2, row, d = (np.concatenate(a) for a in zip(*self.columns))
        return k2, self.kp[row], d, (self.to[row] == k2) & (self.best[row] < factor * self.second[row])


def match_float_products(pairs: DataFrame, keypoints: DataFrame, ratio: float = 0.8, linear: bool = False, bits: bool = False) -> DataFrame:
    """Mutual nearest neighbours under squared L2 with best < ratio^2 * second (linear: best < ratio * second, as for bits, whose squared L2 is the
    Hamming distance); a single candidate has no second. Keypoints without a descriptor are no candidates. bits: descriptors are 64-bit words, which stay words
    until a worker has them and are numbers there only, batch by batch.

    An image's distinct descriptors are dealt to blocks of about BLOCK numbers. A task holds one block of the first image, reads all of the second image
    some at a time, and so settles the block's nearest neighbours; the nearest of the second image's descriptors is the least over the blocks."""
    k = keypoints.where("desc IS NOT NULL").select(F.col("image").cast("long").alias("image"), F.col("kp").cast("long").alias("kp"), F.col("desc").cast("array<long>" if bits else "array<double>").alias("v"))
    whole = F.min(F.forall("v", F.isnotnull)) if bits else F.lit(True)  # after the grouping, as a filter of v would have it computed twice
    k = k.groupBy("image", "v").agg(F.min("kp").alias("kp"), (F.count("*") > 1).alias("again"), whole.alias("whole")).where("whole").drop("whole")  # of equal descriptors the lowest keypoint wins all ties
    count = k.groupBy("image").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("v")) * (64 if bits else 1) / BLOCK)).cast("int").alias("blocks"))
    k = k.join(count, "image").withColumn("block", F.pmod(F.xxhash64("kp"), F.col("blocks")).cast("int")).drop("blocks")
    one, two = (count.select(F.col("image").alias(f"image{i}"), F.col("blocks").alias(f"blocks{i}")) for i in (1, 2))
    units = pairs.select(F.col("i").cast("long").alias("image1"), F.col("j").cast("long").alias("image2")).distinct().join(one, "image1").join(two, "image2")
    units = units.select("image1", "image2", "blocks1", "blocks2", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)).alias("part"))
    unit = ["image1", "image2", "part"]
    rows = units.select(*unit, "blocks1", F.lit(1).alias("side"), F.col("image1").alias("image"), F.col("part").alias("block")).unionByName(
        units.select(*unit, "blocks1", F.lit(2).alias("side"), F.col("image2").alias("image"), F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("block")))
    rows = rows.join(k, ["image", "block"]).select(*unit, "side", "blocks1", "kp", "again", "v").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit).sortWithinPartitions(*unit, "side")

    factor = ratio if linear else ratio * ratio

    def run(batches):
        now, first, near, blocks = None, [], None, 1

        def settled():
            k2, k1, d, ok = near.rows(factor)
            some = ok if blocks == 1 else np.ones(len(ok), bool)  # the nearest of one block is the nearest of all
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now[0])), pa.array(np.full(n, now[1])), pa.array(k2[some]), pa.array(d[some]), pa.array(k1[some]), pa.array(ok[some])],
                                             names=["image1", "image2", "k2", "d", "k1", "ok"])

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(i).to_numpy() for i in range(4)])
            kp, again = b.column(5).to_numpy(), b.column(6).to_numpy(zero_copy_only=False)
            v = b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            v = np.unpackbits(v.view(np.uint8), axis=1).astype(float) if bits else v
            edges = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0), True])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                key, side = tuple(ids[:3, i].tolist()), ids[3, i]
                if key != now:
                    if near:
                        yield from settled()
                    now, first, near, blocks = key, [], None, int(b.column(4)[i].as_py())
                if side == 1:
                    first.append((kp[i:j], v[i:j].copy()))
                else:
                    near = near or _Nearest(*(np.concatenate(a) for a in zip(*first)))
                    near.add(kp[i:j], v[i:j], again[i:j])
        if near:
            yield from settled()

    found = rows.mapInArrow(run, "image1 long, image2 long, k2 long, d double, k1 long, ok boolean")
    least = found.groupBy("image1", "image2", "k2").agg(F.min(F.struct("d", "k1", "ok")).alias("m")).where("m.ok")
    return least.select("image1", "image2", F.col("m.k1").alias("k1"), "k2")


def strongest(keypoints: DataFrame, most: int) -> DataFrame:
    """The most keypoints with the highest response per image, ties to the lower index."""
    w = Window.partitionBy("image").orderBy(F.desc("response"), "kp")
    return keypoints.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
