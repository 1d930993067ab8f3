"""Tracks: keypoints of several images joined through their matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import connected_components


def _node(image, kp):
    """image in the upper 31 bits, keypoint in the lower 32."""
    return F.shiftleft(F.col(image).cast("long"), 32) + F.col(kp).cast("long")


def tracks(matches: DataFrame, exclusive: bool = True) -> DataFrame:
    """matches (image1, k1, image2, k2) -> track (smallest node), image_id, kp.

    exclusive: a match that would bring two keypoints of one image together is skipped, in order of pair and keypoints. That order matters only
    within a component of the match graph, so each component that holds an image twice is a group of its own; all others are tracks
    already. Null ends give nothing, repeated matches count once."""
    edges = matches.select(_node("image1", "k1").alias("src"), _node("image2", "k2").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    found = connected_components(edges)
    named = found.withColumn("image_id", F.shiftright("id", 32)).withColumn("kp", F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    if not exclusive:
        return named.select(F.col("component").alias("track"), "image_id", "kp")
    clash = named.groupBy("component", "image_id").count().where("count > 1").select("component").distinct()
    clean = named.join(clash, "component", "left_anti").select(F.col("component").alias("track"), "image_id", "kp")
    part = edges.join(found.join(clash, "component", "left_semi"), edges.src == found.id).select("component", "src", "dst")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        home, members = {}, {}
        for node in pd.unique(g[["src", "dst"]].to_numpy().ravel()):
            home[node], members[node] = node, {int(node) >> 32: node}
        order = g.assign(a=g.src.to_numpy() >> 32, b=g.dst.to_numpy() >> 32).sort_values(["a", "b", "src", "dst"])
        for s, d in zip(order.src, order.dst):
            s, d = home[s], home[d]
            if s == d or members[s].keys() & members[d].keys():
                continue
            if len(members[s]) < len(members[d]):
                s, d = d, s
            for n in members[d].values():
                home[n] = s
            members[s].update(members.pop(d))
        rows = [(int(min(m.values())), i, int(n) & 0xFFFFFFFF) for m in members.values() if len(m) > 1 for i, n in m.items()]
        return pd.DataFrame(rows, columns=["track", "image_id", "kp"])

    return clean.unionByName(part.groupBy("component").applyInPandas(run, "track long, image_id long, kp int"))
