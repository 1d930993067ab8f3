"""Queries over the test tables, each with its SQL.

How tables stand for the data model: embeddings are descriptors (image = label, kp by vec_id), lineitem are observations
(image = l_suppkey % 20, point = l_partkey) and markers, part gives points, supplier gives cameras and poses,
documents give words, pages paths, events JSON and captures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import bundle, kernels, markers
from tessella.functions import geometry as G
from tessella.operators import features, graph, matching, reconstruct, retrieval, viewgraph
from tessella.sources import colmap, dataset
from tessella.storage import staged

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def table(s, d, name) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- keypoints, pairs, matches ---------------------------------------------------------------------------------------
KP = "kp AS (SELECT CAST(label AS BIGINT) AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS kp, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
IMAGES = "images AS (SELECT DISTINCT CAST(label AS BIGINT) AS image FROM embeddings)"
PAIRS = "pairs AS (SELECT a.image AS i, b.image AS j FROM images a JOIN images b ON a.image < b.image)"


def keypoints(s, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(s, d, "embeddings").select(F.col("label").cast("long").alias("image"), (F.row_number().over(w) - 1).cast("long").alias("kp"), F.col("embedding").cast("array<double>").alias("desc"))


def images(s, d):
    return table(s, d, "embeddings").select(F.col("label").cast("long").alias("image")).distinct()


def all_pairs(s, d):
    return matching.exhaustive_pairs(images(s, d))


@query(f"WITH {IMAGES}, {PAIRS} SELECT i, j FROM pairs")
def pairs_exhaustive(s, d):
    return all_pairs(s, d)


SEQ = "p AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), seq AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON b.n > a.n AND b.n <= a.n + 10)"


def _sequence(s, d):
    return matching.sequential_pairs(table(s, d, "supplier"), 10, "s_suppkey")


@query(f"WITH {SEQ} SELECT i, j FROM seq")
def pairs_sequential_window(s, d):
    return _sequence(s, d)


@query(f"WITH {SEQ} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, j FROM seq UNION ALL SELECT j, i FROM seq)")
def pairs_symmetrised_distinct(s, d):
    return matching.symmetrised(viewgraph.both_directions(_sequence(s, d)))


def _match_sql(distance, ratio, code=""):
    return f"""WITH {KP}{code}, {IMAGES}, {PAIRS},
dist AS (SELECT i, j, a.kp AS k1, b.kp AS k2, {distance} AS d FROM pairs JOIN kp a ON a.image = i JOIN kp b ON b.image = j),
f AS (SELECT *, row_number() OVER (PARTITION BY i, j, k1 ORDER BY d, k2) AS r, lead(d) OVER (PARTITION BY i, j, k1 ORDER BY d, k2) AS second FROM dist),
g AS (SELECT *, row_number() OVER (PARTITION BY i, j, k2 ORDER BY d, k1) AS q FROM dist)
SELECT f.i AS image1, f.j AS image2, f.k1, f.k2 FROM f JOIN g ON f.i = g.i AND f.j = g.j AND f.k1 = g.k1 AND f.k2 = g.k2
WHERE r = 1 AND q = 1 AND (second IS NULL OR f.d < {ratio} * second)"""


L2 = "list_sum(list_transform(range(1, len(a.v) + 1), lambda t: (a.v[t] - b.v[t]) * (a.v[t] - b.v[t])))"


@query(_match_sql(L2, 0.95 * 0.95))
def match_float_mnn_ratio(s, d):
    return matching.match_float_products(all_pairs(s, d), keypoints(s, d), 0.95)


NO_DESC = {"desc_f": "array<double>", "desc_b": "array<long>", "desc_m": "struct<capture_id:long,marker_id:int,corner_index:int>"}


def _described(kp, **given):
    """Keypoints as the engine takes them: image_id, kp and one of the three descriptors."""
    return kp.select(F.col("image").alias("image_id"), "kp", *(given[n].cast(t).alias(n) if n in given else F.lit(None).cast(t).alias(n) for n, t in NO_DESC.items()))


def _code():
    return F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda a, i: a * 2 + F.when(F.get("desc", i) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))


@query(_match_sql("bit_count(xor(a.c, b.c))", 0.95).replace(KP, KP.replace("kp AS (", "k0 AS (", 1) + ", kp AS (SELECT image, kp, CAST(list_sum(list_transform(range(1, 63), lambda i: CASE WHEN v[i] > 0 THEN CAST(pow(2, 62 - i) AS BIGINT) ELSE 0 END)) AS BIGINT) AS c FROM k0)"))
def match_binary_hamming(s, d):
    return reconstruct.putative(all_pairs(s, d), _described(keypoints(s, d), desc_b=F.array(_code())), 0.95)


MARK = "m AS (SELECT l_suppkey % 6 AS image, l_linenumber % 3 AS capture, l_partkey % 50 AS marker, l_orderkey % 4 AS corner, min(l_orderkey * 10 + l_linenumber) AS kp FROM lineitem GROUP BY ALL)"


@query(f"WITH {MARK}, r AS (SELECT capture, marker, corner, min(kp) AS k2 FROM m WHERE image = 1 GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS image1, CAST(1 AS BIGINT) AS image2, CAST(m.kp AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2 FROM m JOIN r USING (capture, marker, corner) WHERE image = 0")
def match_marker_identity(s, d):
    m = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("image"), (F.col("l_linenumber") % 3).alias("capture"), (F.col("l_partkey") % 50).alias("marker"), (F.col("l_orderkey") % 4).alias("corner")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("kp"))
    return reconstruct.putative(s.createDataFrame([(0, 1)], "i long, j long"), _described(m, desc_m=F.struct("capture", "marker", "corner")))


@query(f"WITH {KP}, r AS (SELECT image, kp, v[1] AS response, row_number() OVER (PARTITION BY image ORDER BY v[1] DESC, kp) AS n FROM kp) SELECT image, kp, response FROM r WHERE n <= 10")
def topk_keypoints_per_image(s, d):
    return matching.strongest(keypoints(s, d).select("image", "kp", F.get("desc", F.lit(0)).alias("response")), 10)


def _centroids(s, d):
    return [list(r.desc) for r in keypoints(s, d).where("kp < 2").orderBy("image", "kp").select("desc").collect()]


WORD = f"{KP}, c AS (SELECT v, row_number() OVER (ORDER BY image, kp) - 1 AS w FROM kp WHERE kp < 2), dist AS (SELECT a.image, a.kp, b.w, {L2} AS d FROM kp a, c b), words AS (SELECT image, kp, arg_min(w, (d, w)) AS word FROM dist GROUP BY image, kp)"
WORD = WORD.replace("arg_min(w, (d, w))", "first(w ORDER BY d, w)")


def _words(s, d):
    c = np.array(_centroids(s, d))
    nodes = [{"centres": c, "children": list(range(1, len(c) + 1))}, *({"word": i} for i in range(len(c)))]  # a tree of one level
    return retrieval.worded(keypoints(s, d), nodes).withColumn("word", F.col("word").cast("int"))


@query(f"WITH {WORD} SELECT image, kp, CAST(word AS INTEGER) AS word FROM words")
def nearest_centroid_assign(s, d):
    return _words(s, d)


# --- retrieval -------------------------------------------------------------------------------------------------------
TEXT = "words AS (SELECT doc_id AS image, unnest(string_split(text, ' ')) AS word FROM documents)"
HIST = "h AS (SELECT image, word, count(*) AS tf FROM words GROUP BY ALL), n AS (SELECT count(DISTINCT image) AS n FROM words), df AS (SELECT word, count(DISTINCT image) AS df, ln((SELECT n FROM n) / count(DISTINCT image)) AS idf FROM words GROUP BY word)"
TFIDF = f"{HIST}, t0 AS (SELECT h.image, h.word, h.tf / greatest(sum(h.tf) OVER (PARTITION BY h.image), 1) * idf AS w FROM h JOIN df USING (word)), t AS (SELECT image, word, CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY image)) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY image)) ELSE w END AS weight FROM t0)"


def _text_words(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("image"), F.explode(F.split("text", " ")).alias("word"))


def _text_histogram(s, d):
    return staged(retrieval.histogram(_text_words(s, d)), "histogram")


@query(f"WITH {TEXT}, {HIST} SELECT image, word, tf FROM h")
def word_histogram(s, d):
    return retrieval.histogram(_text_words(s, d))


@query(f"WITH {TEXT}, {HIST} SELECT word, df, round(idf, 6) AS idf FROM df")
def document_frequency(s, d):
    return retrieval.document_frequency(_text_histogram(s, d)).select("word", "df", r6(F.col("idf"), "idf"))


@query(f"WITH {TEXT}, {TFIDF} SELECT image, word, round(weight, 6) AS weight FROM t")
def tfidf_normalised(s, d):
    return retrieval.tfidf(_text_histogram(s, d)).select("image", "word", r6(F.col("weight"), "weight"))


@query(f"""WITH {WORD}, {TFIDF}, u AS (SELECT * FROM t WHERE word IN (SELECT word FROM t GROUP BY word HAVING count(*) <= ceil(0.8 * (SELECT n FROM n)))),
s AS (SELECT a.image, b.image AS other, round(sum(a.weight * b.weight), 9) AS score FROM u a JOIN u b ON a.word = b.word AND a.image <> b.image GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, other) AS rank FROM s)
SELECT image, other, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def retrieval_topn(s, d):
    return retrieval.most_similar(_words(s, d), 5).select("image", "other", r6(F.col("score"), "score"), F.col("rank").cast("int").alias("rank"))


# --- cameras and poses -----------------------------------------------------------------------------------------------
CAMERAS = {
    "SIMPLE_PINHOLE": [800.0, 320.0, 240.0], "PINHOLE": [800.0, 810.0, 320.0, 240.0], "SIMPLE_RADIAL": [800.0, 320.0, 240.0, 0.1],
    "RADIAL": [800.0, 320.0, 240.0, 0.1, -0.02], "OPENCV": [800.0, 810.0, 320.0, 240.0, 0.1, -0.02, 0.001, -0.002],
    "OPENCV_FISHEYE": [800.0, 810.0, 320.0, 240.0, 0.1, -0.02, 0.003, -0.001],
}
CAM_SQL = "cam AS (SELECT model, CAST(p AS DOUBLE[]) AS p FROM (VALUES " + ", ".join(f"('{m}', {p})" for m, p in CAMERAS.items()) + ") AS c(model, p))"
PTS = "pts AS (SELECT p_partkey AS id, (p_partkey % 21 - 10) / 10.0::DOUBLE AS x, (p_partkey % 17 - 8) / 10.0::DOUBLE AS y, (2 + p_partkey % 5)::DOUBLE AS z FROM part)"


def _cameras(s):
    return s.createDataFrame(list(CAMERAS.items()), "model string, p array<double>")


def _points(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("id"), ((k % 21 - 10) / 10.0).alias("x"), ((k % 17 - 8) / 10.0).alias("y"), (2 + k % 5).cast("double").alias("z"))


@query(f"""WITH {CAM_SQL}, {PTS}, a AS (SELECT id, model, p, x / z AS a, y / z AS b, greatest(sqrt((x * x + y * y) / (z * z)), 1e-12) AS r FROM pts, cam),
q AS (SELECT *, a * a + b * b AS s, atan(r) AS t FROM a)
SELECT id, model,
 round(CASE model WHEN 'SIMPLE_PINHOLE' THEN p[1] * a + p[2] WHEN 'PINHOLE' THEN p[1] * a + p[3] WHEN 'SIMPLE_RADIAL' THEN p[1] * a * (1 + p[4] * s) + p[2]
  WHEN 'RADIAL' THEN p[1] * a * (1 + p[4] * s + p[5] * s * s) + p[2] WHEN 'OPENCV' THEN p[1] * (a * (1 + p[5] * s + p[6] * s * s) + 2 * p[7] * a * b + p[8] * (s + 2 * a * a)) + p[3]
  ELSE p[1] * a * t * (1 + p[5] * t ** 2 + p[6] * t ** 4 + p[7] * t ** 6 + p[8] * t ** 8) / r + p[3] END, 5) AS u,
 round(CASE model WHEN 'SIMPLE_PINHOLE' THEN p[1] * b + p[3] WHEN 'PINHOLE' THEN p[2] * b + p[4] WHEN 'SIMPLE_RADIAL' THEN p[1] * b * (1 + p[4] * s) + p[3]
  WHEN 'RADIAL' THEN p[1] * b * (1 + p[4] * s + p[5] * s * s) + p[3] WHEN 'OPENCV' THEN p[2] * (b * (1 + p[5] * s + p[6] * s * s) + p[7] * (s + 2 * b * b) + 2 * p[8] * a * b) + p[4]
  ELSE p[2] * b * t * (1 + p[5] * t ** 2 + p[6] * t ** 4 + p[7] * t ** 6 + p[8] * t ** 8) / r + p[4] END, 5) AS v FROM q""")
def camera_project(s, d):
    both = _points(s, d).join(F.broadcast(_cameras(s)), F.lit(True))  # six cameras

    def run(frames):
        for f in frames:
            for model, g in f.groupby("model"):
                pixel = bundle.project(model, np.array(g.p.iloc[0]), g[["x", "y", "z"]].to_numpy(), False)
                yield pd.DataFrame({"id": g.id, "model": model, "u": pixel[:, 0], "v": pixel[:, 1]})

    return both.mapInPandas(run, "id long, model string, u double, v double").select("id", "model", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(f"""WITH {CAM_SQL} SELECT model, CAST(list_position(['SIMPLE_PINHOLE','PINHOLE','SIMPLE_RADIAL','RADIAL','OPENCV','OPENCV_FISHEYE'], model) - 1 AS INTEGER) AS model_id,
p[1] AS fx, CASE WHEN model IN ('PINHOLE','OPENCV','OPENCV_FISHEYE') THEN p[2] ELSE p[1] END AS fy, CASE WHEN model IN ('PINHOLE','OPENCV','OPENCV_FISHEYE') THEN p[3] ELSE p[2] END AS cx,
CASE WHEN model IN ('PINHOLE','OPENCV','OPENCV_FISHEYE') THEN p[4] ELSE p[3] END AS cy,
CASE model WHEN 'SIMPLE_RADIAL' THEN [p[4],0,0,0,0,0] WHEN 'RADIAL' THEN [p[4],p[5],0,0,0,0] WHEN 'OPENCV' THEN [p[5],p[6],p[7],p[8],0,0] WHEN 'OPENCV_FISHEYE' THEN [p[5],p[6],0,0,p[7],p[8]] ELSE [0.0,0,0,0,0,0]::DOUBLE[] END AS slots,
TRUE AS valid FROM cam""")
def camera_params(s, d):
    m, p = F.col("model"), F.col("p")
    (fx, fy), (cx, cy) = G.focal_lengths(m, p), G.principal_point(m, p)
    return _cameras(s).select("model", G.model_id(m).alias("model_id"), fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy"), G.opencv_distortion(m, p).alias("slots"), G.params_valid(m, p).alias("valid"))


SIZES = "sz AS (SELECT s_suppkey AS id, 640 + s_suppkey % 3 * 320 AS w, 480 + s_suppkey % 5 * 240 AS h FROM supplier)"


@query(f"WITH {SIZES} SELECT id, round([greatest(w, h) * 1.2][1], 6)::DOUBLE AS f, w / 2.0::DOUBLE AS cx, h / 2.0::DOUBLE AS cy FROM sz")
def default_camera_guess(s, d):
    k = F.col("s_suppkey")
    p = G.default_params("SIMPLE_RADIAL", 640 + k % 3 * 320, 480 + k % 5 * 240)
    return table(s, d, "supplier").select(k.alias("id"), r6(F.get(p, F.lit(0)), "f"), F.get(p, F.lit(1)).alias("cx"), F.get(p, F.lit(2)).alias("cy"))


POSE = """pose AS (SELECT s_suppkey AS id, cos(s_suppkey * 0.05) AS w, 0.6 * sin(s_suppkey * 0.05) AS x, 0.0::DOUBLE AS y, 0.8 * sin(s_suppkey * 0.05) AS z,
 s_suppkey % 7 * 0.5::DOUBLE AS tx, s_suppkey % 5 * 0.25::DOUBLE AS ty, 3.0::DOUBLE AS tz FROM supplier),
rot AS (SELECT *, 1-2*(y*y+z*z) AS r0, 2*(x*y-w*z) AS r1, 2*(x*z+w*y) AS r2, 2*(x*y+w*z) AS r3, 1-2*(x*x+z*z) AS r4, 2*(y*z-w*x) AS r5, 2*(x*z-w*y) AS r6, 2*(y*z+w*x) AS r7, 1-2*(x*x+y*y) AS r8 FROM pose),
cen AS (SELECT *, -(r0*tx+r3*ty+r6*tz) AS c0, -(r1*tx+r4*ty+r7*tz) AS c1, -(r2*tx+r5*ty+r8*tz) AS c2 FROM rot)"""


def _poses(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("id"), F.cos(k * 0.05).alias("w"), (F.sin(k * 0.05) * 0.6).alias("x"), F.lit(0.0).alias("y"), (F.sin(k * 0.05) * 0.8).alias("z"),
                                          (k % 7 * 0.5).alias("tx"), (k % 5 * 0.25).alias("ty"), F.lit(3.0).alias("tz"))


def _qt():
    """Quaternion and translation columns of _poses."""
    return [F.col(c) for c in "wxyz"], [F.col(c) for c in ("tx", "ty", "tz")]


@query(f"WITH {POSE} SELECT id, round(r0*.3+r1*.2+r2*.7+tx, 6) AS px, round(r3*.3+r4*.2+r5*.7+ty, 6) AS py, round(r6*.3+r7*.2+r8*.7+tz, 6) AS pz FROM rot")
def pose_transform(s, d):
    return _poses(s, d).select("id", *(r6(c, n) for c, n in zip(G.transform(*_qt(), [F.lit(0.3), F.lit(0.2), F.lit(0.7)]), ("px", "py", "pz"))))


@query(f"WITH {POSE} SELECT id, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM cen")
def camera_center(s, d):
    return _poses(s, d).select("id", *(r6(c, f"c{i}") for i, c in enumerate(G.camera_center(*_qt()))))


@query(f"WITH {POSE} SELECT id, " + ", ".join(f"round({v}, 6) AS m{i}" for i, v in enumerate(["r0", "-r3", "-r6", "c0", "r1", "-r4", "-r7", "c1", "r2", "-r5", "-r8", "c2"])) + " FROM cen")
def nerf_c2w_matrix(s, d):
    m = G.nerf_c2w(*_qt())
    return _poses(s, d).select("id", *(r6(m[i // 4][i % 4], f"m{i}") for i in range(12)))


@query(f"""WITH {PTS} SELECT id, round((x * 100 - 5) / 800, 6) AS nx, round((y * 100 - 7) / 810, 6) AS ny,
round(CASE WHEN z > 1e-9 THEN sqrt((x/z - 0.1) ** 2 + (y/z + 0.05) ** 2) END, 6) AS err,
round(acos(least(1, greatest(-1, (x*(x-1) + y*y + z*z) / (sqrt(x*x+y*y+z*z) * sqrt((x-1)**2+y*y+z*z))))), 6) AS angle FROM pts""")
def reprojection_measures(s, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return _points(s, d).select("id", r6((x * 100 - 5) / 800, "nx"), r6((y * 100 - 7) / 810, "ny"), r6(G.reprojection_error_normalized((x, y, z), F.lit(0.1), F.lit(-0.05)), "err"),
                                r6(G.triangulation_angle([F.lit(0.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)], [x, y, z]), "angle"))


@query(f"""WITH {PTS}, l AS (SELECT id, x, y, x/z + 0.1 AS x2, y/z AS y2 FROM pts), m AS (SELECT id, -y + 0.3 AS a0, x - 0.2 AS a1, 0.2*y - 0.3*x AS a2, -0.3 + y2 AS b0, 0.2 - x2 AS b1, x2, y2 FROM l)
SELECT id, CASE WHEN a0*a0+a1*a1+b0*b0+b1*b1 < 1e-12 THEN 1.7976931348623157e308 ELSE round((x2*a0+y2*a1+a2)**2 / (a0*a0+a1*a1+b0*b0+b1*b1), 6) END AS sampson FROM m""")
def sampson_distance(s, d):
    def run(frames):
        for f in frames:
            x, y, z = f[["x", "y", "z"]].to_numpy().T
            yield pd.DataFrame({"id": f.id, "sampson": kernels.sampson(np.array([[0, -1, 0.3], [1, 0, -0.2], [-0.3, 0.2, 0]]), np.c_[x, y], np.c_[x / z + 0.1, y / z])})

    return _points(s, d).mapInPandas(run, "id long, sampson double").select("id", r6(F.col("sampson"), "sampson"))


# --- errors and weights ----------------------------------------------------------------------------------------------
OBS = "o AS (SELECT DISTINCT l_suppkey % 20 AS image, l_partkey AS point FROM lineitem)"


def observations(s, d):
    return table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), F.col("l_partkey").alias("point"))


@query("SELECT l_linenumber, round(sum(CASE WHEN r <= 2 THEN 1 ELSE 2 / r END), 3) AS huber, round(sum(1 / (1 + (r / 2) ** 2)), 3) AS cauchy, round(sum(r * r * CASE WHEN r <= 2 THEN 1 ELSE 2 / r END), 2) AS cost FROM (SELECT l_linenumber, l_quantity / 10 AS r FROM lineitem) GROUP BY ALL")
def robust_weights_and_cost(s, d):
    def run(frames):
        for f in frames:
            e = np.c_[f.r, np.zeros(len(f))]
            for n, g in f.groupby("n"):
                own = e[f.n.to_numpy() == n]
                yield pd.DataFrame({"n": [n], "huber": bundle.weights(own, "huber", 2.0).sum(), "cauchy": bundle.weights(own, "cauchy", 2.0).sum(), "cost": bundle.total_cost(own, np.ones(len(own), bool), "huber", 2.0)})

    rows = table(s, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") / 10).cast("double").alias("r"))
    sums = rows.mapInPandas(run, "n long, huber double, cauchy double, cost double").groupBy(F.col("n").alias("l_linenumber"))
    return sums.agg(F.round(F.sum("huber"), 3).alias("huber"), F.round(F.sum("cauchy"), 3).alias("cauchy"), F.round(F.sum("cost"), 2).alias("cost"))


@query("SELECT round(coalesce(sum(e * n) / sum(n), 0), 4) AS mean_error FROM (SELECT l_partkey, avg(l_discount) AS e, count(*) AS n FROM lineitem GROUP BY 1)")
def mean_reprojection_weighted(s, d):
    p = table(s, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("error"), F.count("*").alias("track"))
    return viewgraph.mean_error_weighted(p).select(F.round("mean_error", 4).alias("mean_error"))


@query("SELECT o_custkey AS camera, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_median_depth(s, d):
    return viewgraph.medians(table(s, d, "orders"), "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "camera")


CENTRES = "image * 0.3::DOUBLE AS cx, image % 3 * 0.5::DOUBLE AS cy, -1 - image % 4 * 0.25::DOUBLE AS cz"


@query(f"""WITH {OBS}, {PTS}, v AS (SELECT point, image, cx - x AS a, cy - y AS b, cz - z AS c FROM (SELECT point, image, x, y, z, {CENTRES} FROM o JOIN pts ON id = point)),
u AS (SELECT point, image, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM v)
SELECT l.point, count(DISTINCT l.image) AS n, round(max(degrees(acos(least(1, greatest(-1, l.a * r.a + l.b * r.b + l.c * r.c))))), 4) AS widest FROM u l JOIN u r ON l.point = r.point AND l.image <> r.image GROUP BY 1""")
def max_view_angle_per_track(s, d):
    i = F.col("image")
    views = observations(s, d).distinct().join(_points(s, d).withColumnRenamed("id", "point"), "point")
    centred = views.withColumns({"cx": i * 0.3, "cy": i % 3 * 0.5, "cz": -1 - i % 4 * 0.25})
    return viewgraph.max_view_angle(reconstruct.rays_of(centred)).select("point", "n", F.round("widest", 4).alias("widest"))


# --- view graph ------------------------------------------------------------------------------------------------------
@query(f"WITH {OBS}, c AS (SELECT a.image, b.image AS other, count(*) AS shared FROM o a JOIN o b ON a.point = b.point AND a.image <> b.image GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image ORDER BY shared DESC, other) AS INTEGER) AS rank FROM c) SELECT image, other, shared, rank FROM r WHERE rank <= 6")
def covisibility_top6(s, d):
    return viewgraph.covisible(observations(s, d))


@query(f"WITH {OBS} SELECT image, count(*) AS points FROM o WHERE image % 2 = 1 AND point IN (SELECT point FROM o WHERE image % 2 = 0) GROUP BY image ORDER BY points DESC, image LIMIT 1")
def next_best_view(s, d):
    o = observations(s, d)
    return viewgraph.next_best_view(o, o.where("image % 2 = 0").select("image").distinct())


EDGE = "e AS (SELECT DISTINCT least(o_custkey, o_orderkey % 997) AS i, greatest(o_custkey, o_orderkey % 997) AS j FROM orders WHERE o_custkey <> o_orderkey % 997)"


def _edges(s, d):
    a, b = F.col("o_custkey"), F.col("o_orderkey") % 997
    return table(s, d, "orders").where(a != b).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).distinct()


@query(f"WITH {EDGE}, g AS (SELECT i, j, (i * 7 + j * 3) % 11 AS angle FROM e), t AS (SELECT x.i AS a, x.j AS b, y.j AS c, CAST(abs(x.angle + y.angle - z.angle) <= 4 AS INTEGER) AS ok FROM g x JOIN g y ON y.i = x.j JOIN g z ON z.i = x.i AND z.j = y.j), v AS (SELECT a AS i, b AS j, ok FROM t UNION ALL SELECT b, c, ok FROM t UNION ALL SELECT a, c, ok FROM t), n AS (SELECT i, j, max(ok) AS good FROM v GROUP BY ALL) SELECT g.i AS image1, g.j AS image2, CASE WHEN good = 1 THEN 0 WHEN good IS NULL THEN 1 END AS rank FROM g LEFT JOIN n ON g.i = n.i AND g.j = n.j")
def triplet_votes(s, d):
    """Rotations about one axis, so that the loop of a triangle turns by the sum of its angles."""
    a, o = F.radians((F.col("i") * 7 + F.col("j") * 3) % 11), F.lit(0.0)
    r = F.array(F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a), o, o, o, F.lit(1.0))
    return reconstruct.triplet_ranks(_edges(s, d).select(F.col("i").alias("image1"), F.col("j").alias("image2"), r.alias("rotation")), 4.5).drop("rotation")


@query(f"WITH {EDGE} SELECT i AS image, count(*) AS degree FROM (SELECT i, j FROM e UNION ALL SELECT j, i FROM e) GROUP BY 1")
def node_degree(s, d):
    return viewgraph.degree(_edges(s, d)).withColumnRenamed("i", "image")


SPLIT = "f AS (SELECT DISTINCT least(s_suppkey, s_suppkey * 3 % 101) AS i, greatest(s_suppkey, s_suppkey * 3 % 101) AS j FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey <> s_suppkey * 3 % 101), b AS (SELECT i, j FROM f UNION ALL SELECT j, i FROM f)"
CC = f"WITH RECURSIVE {SPLIT}, c(id, root) AS (SELECT i, i FROM b UNION SELECT b.j, c.root FROM c JOIN b ON b.i = c.id), comp AS (SELECT id, min(root) AS component FROM c GROUP BY id)"


def _components(s, d):
    k = F.col("s_suppkey")
    return graph.connected_components(table(s, d, "supplier").where("s_suppkey % 4 <> 0").select(k.alias("i"), (k * 3 % 101).alias("j")), "i", "j")


@query(f"{CC} SELECT CAST(id AS BIGINT) AS id, CAST(component AS BIGINT) AS component FROM comp")
def connected_components(s, d):
    return _components(s, d)


@query(f"{CC} SELECT CAST(id AS BIGINT) AS image_id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component DESC LIMIT 1)")
def largest_component(s, d):
    k = F.col("s_suppkey")
    return reconstruct.largest_component(table(s, d, "supplier").where("s_suppkey % 4 <> 0").select(k.alias("image1"), (k * 3 % 101).alias("image2")))


@query("WITH p AS (SELECT s_nationkey AS i, s_suppkey % 40 + 25 AS j, s_suppkey % 13 AS inliers, s_suppkey AS pos FROM supplier) SELECT i, j, inliers, pos FROM p WHERE (i % 2 = 0) <> (j % 2 = 0) AND NOT (i = 2 AND j = 31) ORDER BY inliers DESC, pos DESC LIMIT 1")
def bridge_candidate(s, d):
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.col("s_nationkey").alias("i"), (k % 40 + 25).alias("j"), (k % 13).alias("inliers"), k.alias("pos"))
    even = s.range(0, 100, 2).select(F.col("id").alias("image"))
    return viewgraph.bridge_candidate(p, even, s.createDataFrame([(2, 31)], "i long, j long"))


# --- captures, ids, paths --------------------------------------------------------------------------------------------
@query("SELECT user_id % 4 AS camera, hour(ts) AS slot, printf('cam%03d/slot%03d', user_id % 4, hour(ts)) AS name, row_number() OVER (PARTITION BY user_id % 4, hour(ts) ORDER BY user_id, event_id) - 1 AS new_kp, user_id AS capture, event_id AS kp FROM events")
def merge_captures(s, d):
    k = table(s, d, "events").select((F.col("user_id") % 4).alias("camera"), F.hour("ts").cast("long").alias("slot"), F.col("user_id").alias("capture"), F.col("event_id").alias("kp"))
    return viewgraph.merged_captures(k)


@query("SELECT concat('cam', s_nationkey, '/', s_name, '.jpg') AS name, CAST(0 AS BIGINT) AS capture_id, CAST(s_nationkey AS BIGINT) AS camera_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1 AS image_index FROM supplier")
def image_index_by_camera(s, d):
    return dataset.discover(table(s, d, "supplier").select(F.concat(F.lit("cam"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_name"), F.lit(".jpg")).alias("name")))[0]


@query("SELECT c_name AS name, CAST(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_name)) AS BIGINT) AS id FROM customer")
def allocate_ids(s, d):
    c = table(s, d, "customer")
    return viewgraph.allocated(c.select(F.col("c_name").alias("name")), c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))


@query(f"WITH {KP} SELECT image, kp FROM kp WHERE kp % 7 = 0")
def stride_sample(s, d):
    return retrieval.strided(keypoints(s, d), 7).select("image", "kp")


GLOBS = [(0, "*1", 1, False), (1, "*2?", 2, True), (2, "*", 3, True)]
GLOB_SQL = "g(pos, pattern, camera, refine) AS (VALUES (0, '%1', 1, FALSE), (1, '%2_', 2, TRUE), (2, '%', 3, TRUE))"


def _globs(s):
    return F.broadcast(s.createDataFrame(GLOBS, "pos int, pattern string, camera int, refine boolean"))  # a declared list


@query(f"WITH {GLOB_SQL} SELECT s_name AS name, first(camera ORDER BY pos) AS camera FROM supplier JOIN g ON s_name LIKE pattern GROUP BY 1")
def glob_camera_assignment(s, d):
    m = table(s, d, "supplier").join(_globs(s), F.rlike("s_name", G.glob_regex(F.col("pattern"))))
    return m.groupBy(F.col("s_name").alias("name")).agg(F.min_by("camera", "pos").alias("camera"))


@query(f"WITH {GLOB_SQL} SELECT DISTINCT s_nationkey AS camera FROM supplier JOIN g ON s_name LIKE pattern WHERE NOT refine")
def glob_pinned_cameras(s, d):
    return table(s, d, "supplier").join(_globs(s), F.rlike("s_name", G.glob_regex(F.col("pattern"))) & ~F.col("refine"), "left_semi").select(F.col("s_nationkey").alias("camera")).distinct()


NAMED = "poses AS (SELECT printf('Customer#%09d', o_custkey) AS name, min(o_orderkey) AS pose FROM orders GROUP BY 1)"


def _placed(s, d):
    poses = table(s, d, "orders").groupBy(F.format_string("Customer#%09d", "o_custkey").alias("name")).agg(F.min("o_orderkey").alias("pose"))
    return viewgraph.placed(poses, table(s, d, "customer").where("c_nationkey < 20").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("image_id")))


@query(f"WITH {NAMED} SELECT c_custkey AS image_id, pose FROM poses JOIN customer ON c_name = name WHERE c_nationkey < 20")
def known_pose_join(s, d):
    return _placed(s, d)[0].select("image_id", "pose")


@query(f"WITH {NAMED} SELECT name FROM poses WHERE name NOT IN (SELECT c_name FROM customer WHERE c_nationkey < 20)")
def unknown_pose_anti(s, d):
    return _placed(s, d)[1]


@query("SELECT p_partkey AS id, p_size + 100 AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def upsert_keypoints(s, d):
    p = table(s, d, "part")
    return viewgraph.upserted(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).alias("v")), ["id"])


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '([0-9]+)$', 1), '') AS BIGINT) AS trailing, CAST(nullif(regexp_extract(lower('Camera' || page_id || '_x'), '^cam(?:era)?([0-9]+)', 1), '') AS BIGINT) AS leading, lower(regexp_extract(replace(url, '.html', '.JPG'), '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png') AS image FROM pages")
def path_functions(s, d):
    return table(s, d, "pages").select("page_id", G.trailing_number(F.col("url")).alias("trailing"), G.leading_camera_number(F.concat(F.lit("Camera"), F.col("page_id").cast("string"), F.lit("_x"))).alias("leading"),
                                       G.is_image_file(F.replace(F.col("url"), F.lit(".html"), F.lit(".JPG"))).alias("image"))


def _line_matches(s, d):
    return table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("image1"), (F.col("l_linenumber") + 20).alias("image2"), F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"))


@query("SELECT count(*) AS verified, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey % 20, l_linenumber)")
def stage_report_counts(s, d):
    return viewgraph.pair_counts(_line_matches(s, d).groupBy("image1", "image2").agg(F.collect_list(F.struct("k1", "k2")).alias("inliers")))


@query("SELECT l_suppkey % 20 AS image1, l_linenumber + 20 AS image2 FROM lineitem GROUP BY ALL HAVING count(*) >= 40")
def verify_gate_counts(s, d):
    return viewgraph.enough_matches(_line_matches(s, d), 40)


@query("SELECT concat_ws('_', l_linenumber, l_suppkey % 20 % 5, l_suppkey % 20, l_partkey, l_orderkey % 4) AS feature_id, l_suppkey % 20 AS image_id, concat('i', l_suppkey % 20) AS image_name, printf('%.3f', l_quantity) AS x, printf('%.3f', l_discount) AS y FROM lineitem")
def marker_corner_rows(s, d):
    i = F.col("l_suppkey") % 20
    kp = table(s, d, "lineitem").select(i.alias("image_id"), F.struct(F.col("l_linenumber").alias("capture_id"), F.col("l_partkey").alias("marker_id"), (F.col("l_orderkey") % 4).alias("corner_index")).alias("desc_m"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    images = s.range(20).select(F.col("id").alias("image_id"), (F.col("id") % 5).alias("physical"), F.col("id").alias("image_index"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("name"))
    return features.corner_rows(kp, images)


@query(f"WITH {PTS} SELECT id AS kp, round((100 * x - 320) / 800, 6) AS nx, round((100 * y - 240) / 810, 6) AS ny, 805.0::DOUBLE AS f FROM pts")
def normalised_keypoints(s, d):
    kp = _points(s, d).select(F.lit(1).alias("image_id"), F.col("id").alias("kp"), (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    cams = s.createDataFrame([(7, "PINHOLE", CAMERAS["PINHOLE"])], "camera_id long, model string, params array<double>")
    return reconstruct.normalised(kp, s.createDataFrame([(1, 7)], "image_id long, camera_id long"), cams).select("kp", r6(F.col("nx"), "nx"), r6(F.col("ny"), "ny"), "f")


# --- text formats ----------------------------------------------------------------------------------------------------
@query("SELECT s_suppkey AS id, printf('%d PINHOLE %d %d %.10f %.10f %.10f %.10f', s_suppkey, 640, 480, s_suppkey + 500.25, s_suppkey + 501.5, 320.0, 240.0) AS line FROM supplier")
def colmap_cameras_lines(s, d):
    k = F.col("s_suppkey")
    c = table(s, d, "supplier").select(k.alias("camera_id"), F.lit("PINHOLE").alias("model"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(k + 500.25, k + 501.5, F.lit(320.0), F.lit(240.0)).alias("params"))
    return colmap.camera_lines(c)


@query("SELECT p_partkey AS id, printf('%d %.10f %.10f %.10f 180 180 180 %.6f %d %d %d %d', p_partkey, p_retailprice, p_size + 0.5, 2.0, p_size / 8.0, p_size, 1, p_size + 1, 2) AS line FROM part")
def colmap_points_lines(s, d):
    g, z = F.lit(180), F.col("p_size")
    p = table(s, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("x"), (z + 0.5).alias("y"), F.lit(2.0).alias("z"), g.alias("r"), g.alias("g"), g.alias("b"), (z / 8.0).alias("error"),
                                   F.array(F.struct(z.cast("long").alias("image_id"), F.lit(1).alias("kp")), F.struct((z + 1).cast("long").alias("image_id"), F.lit(2).alias("kp"))).alias("track"))
    return colmap.point_lines(p)


@query("SELECT p_partkey AS id, round(abs((0 * 3 - p_size * 0) + (p_size * 2 - p_size * 3) * 0 + p_size * (p_size % 7 + 1) * 2) / 2.0::DOUBLE, 6) AS area FROM part")
def polygon_area(s, d):
    w, h, o = F.col("p_size").cast("double"), (F.col("p_size") % 7 + 1).cast("double"), F.lit(0.0)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f.id, "area": [abs(markers.area(np.array([a, b]).T)) for a, b in zip(f["xs"], f["ys"])]})

    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(o, w, w, o).alias("xs"), F.array(o, o, h, h).alias("ys"))
    return p.mapInPandas(run, "id long, area double").select("id", r6(F.col("area"), "area"))


def _rotated(c):
    return "(" + " | ".join(f"((({c} >> {r * 4 + k}) & 1) << {k * 4 + 3 - r})" for r in range(4) for k in range(4)) + ")"


@query(f"WITH a AS (SELECT p_partkey AS id, CAST(p_partkey * 40503 % 65536 AS INTEGER) AS c0 FROM part), b AS (SELECT id, c0, {_rotated('c0')} AS c1 FROM a), c AS (SELECT *, {_rotated('c1')} AS c2 FROM b), d AS (SELECT *, {_rotated('c2')} AS c3 FROM c) SELECT id, CAST(least(bit_count(xor(c0, 21930)), bit_count(xor(c1, 21930)), bit_count(xor(c2, 21930)), bit_count(xor(c3, 21930))) AS INTEGER) AS hamming FROM d")
def dictionary_rotations_match(s, d):
    c = [(F.col("p_partkey") * 40503 % 65536).cast("int")]
    t = table(s, d, "part").select(F.col("p_partkey").alias("id"), c[0].alias("c0"))
    for i in range(3):
        t = t.withColumn(f"c{i + 1}", G.rotate_code(F.col(f"c{i}")))
    return t.select("id", F.least(*(F.bit_count(F.col(f"c{i}").bitwiseXOR(F.lit(21930))) for i in range(4))).alias("hamming"))
