"""Bag-of-words retrieval: histograms, TF-IDF and similarity by an inverted index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vocabulary
from tessella.storage import staged


def histogram(words: DataFrame) -> DataFrame:
    """(image, word) rows -> image, word, tf."""
    return words.groupBy("image", "word").agg(F.count("*").alias("tf"))


def document_frequency(hist: DataFrame) -> DataFrame:
    """word, df, idf from the histogram, which holds a row for each image and word."""
    n = hist.agg(F.count_distinct("image")).first()[0]
    return hist.groupBy("word").agg(F.count("image").alias("df")).withColumn("idf", F.log(F.lit(float(max(n, 1))) / F.col("df")))


def tfidf(hist: DataFrame) -> DataFrame:
    """image, word, weight with vectors of length one; an image whose weights are all zero keeps them."""
    total = hist.groupBy("image").agg(F.greatest(F.sum("tf"), F.lit(1)).alias("total"))
    w = hist.join(document_frequency(hist), "word").join(total, "image").select("image", "word", (F.col("tf") / F.col("total") * F.col("idf")).alias("w"))
    norm = w.groupBy("image").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "image").select("image", "word", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("weight"))


def most_similar(words: DataFrame, top: int, stop_share: float = 0.8) -> DataFrame:
    """image, other, score, rank: the top images by cosine over shared words that at most ceil(stop_share n) images hold."""
    hist = staged(histogram(words), "histogram")
    n = hist.agg(F.count_distinct("image")).first()[0]
    t = staged(tfidf(hist), "weights")
    common = t.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") <= math.ceil(stop_share * n)).select("word")
    t = t.join(common, "word")
    a, b = t.select("word", "image", F.col("weight").alias("w1")), t.select("word", F.col("image").alias("other"), F.col("weight").alias("w2"))
    score = a.join(b, "word").where("image <> other").groupBy("image", "other").agg(F.round(F.sum(F.col("w1") * F.col("w2")), 9).alias("score"))
    w = Window.partitionBy("image").orderBy(F.desc("score"), "other")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def strided(keypoints: DataFrame, stride: int) -> DataFrame:
    """Every stride-th keypoint of each image, in their order."""
    place = F.row_number().over(Window.partitionBy("image").orderBy("kp")) - 1
    return keypoints.withColumn("_n", place).where(F.col("_n") % stride == 0).drop("_n")


def worded(keypoints: DataFrame, nodes: list[dict]) -> DataFrame:
    """image, kp, word by descent through the tree, whose size the training bounds."""

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"image": b.image, "kp": b.kp, "word": vocabulary.words(nodes, np.array(b.desc.tolist(), float))})

    return keypoints.select("image", "kp", "desc").mapInPandas(run, "image long, kp long, word long")


def vocabulary_pairs(keypoints: DataFrame, neighbours: int = 10, branching: int = vocabulary.BRANCHING, depth: int = vocabulary.DEPTH) -> DataFrame | None:
    """keypoints (image, kp, desc) -> candidate pairs (i, j), i < j: each image with its most similar ones by visual words.

    The tree is trained on at most vocabulary.SAMPLE descriptors (every n-th of an image), the words cover all of them. None where
    descriptors are missing or of several lengths, as for markers: pair exhaustively then."""
    sizes = keypoints.agg(F.count("*").alias("n"), F.count("desc").alias("d"), F.min(F.size("desc")).alias("a"), F.max(F.size("desc")).alias("b")).first()
    if not sizes.n or sizes.d < sizes.n or sizes.a != sizes.b:
        return None
    stride = max(1, -(-sizes.n // vocabulary.SAMPLE))
    rows = strided(keypoints.select("image", "kp", "desc"), stride).orderBy("image", "kp").limit(vocabulary.SAMPLE).select("desc").collect()
    nodes = vocabulary.train(np.array([r.desc for r in rows], float), branching, depth)
    found = most_similar(worded(keypoints, nodes).select("image", "word"), neighbours)
    return found.select(F.least("image", "other").alias("i"), F.greatest("image", "other").alias("j")).distinct()


def unpacked(codes: Column) -> Column:
    """Bits of 64-bit words as an array of doubles, the lowest first."""
    return F.flatten(F.transform(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1)).cast("double"))))
