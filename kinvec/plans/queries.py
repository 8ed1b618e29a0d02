"""The registered queries of the vector-identity library, each with its DuckDB SQL.

Gallery: embeddings with even vec_id; probes: odd ones; identity: label.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, vectors
from ..operators import enrolment, identity, metrics, ordered, scoring, slots, tracking
from ..sources import protocol, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.25


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six_places(c: Column) -> Column:
    """c rounded as DuckDB does it: c * 1e6 to the nearest whole number, halves away from zero, over 1e6."""
    y = c * 1e6
    whole = F.when(F.abs(y - F.rint(y)) == 0.5, y + F.signum(y) * 0.5).otherwise(F.rint(y))
    return F.when(F.abs(y) == float("inf"), c).otherwise(whole / 1e6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six_places(F.col(n)) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- vectors

_PAIR = "SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 16"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocol's pairs: every vector with those of the next 16 ids, an equi-join, so a fixed number for each."""
    e = _table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), F.col("label").alias("la"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 16)).alias("b_id"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    return a.join(b, "b_id").select("a_id", "b_id", "a", "b", (F.col("la") == F.col("lb")).alias("same"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir).select("a_id", "b_id", "same", vectors.dot(F.col("a"), F.col("b")).alias("score")), "score")


_SCORED = f"SELECT a_id, b_id, same, round(list_dot_product(a, b), 6) AS score FROM ({_PAIR})"


@query("SELECT vec_id, len(embedding) AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norm(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return rounded(longs(e.select("vec_id", F.size("embedding").alias("dimension"), vectors.norm(F.col("embedding")).alias("norm")), "dimension"), "norm")


@query("SELECT vec_id, round(list_dot_product(n, n), 6) AS unit, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: 3 * x / sqrt(9 * list_dot_product(e, e))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def vec_normalise(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    n = e.select("vec_id", vectors.normalise(F.transform(vectors.doubles(F.col("embedding")), lambda x: x * 3)).alias("n"))
    return rounded(n.select("vec_id", vectors.dot(F.col("n"), F.col("n")).alias("unit"), F.get("n", F.lit(0)).alias("first")), "unit", "first")


@query(_SCORED)
def vec_cosine_pairs(spark, sf_dir):
    return _scored(spark, sf_dir)


_MEANS = """SELECT label, list(t / l ORDER BY pos) AS m FROM (
  SELECT label, pos, t, sqrt(sum(t * t) OVER (PARTITION BY label)) AS l FROM (
    SELECT label, pos, sum(x) AS t FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos)) GROUP BY label"""


@query(f"SELECT label, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT label, unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM ({_MEANS}))")
def vec_mean_by_label(spark, sf_dir):
    m = vectors.mean_by(_table(spark, sf_dir, "embeddings"), "label")
    return rounded(longs(m.select("label", F.posexplode("mean").alias("pos", "x")), "pos"), "x")


# ---- geometry

_FACE = "SELECT vec_id // 4 AS image_id, vec_id % 4 AS det_idx, vec_id, (vec_id * 37) % 90 - 5.4 AS x, (vec_id * 53) % 70 + 0.25 AS y, 20.0 + (vec_id * 29) % 90 AS w, 20.0 + (vec_id * 31) % 90 AS h, (vec_id * 7) % 80 + 0.53 AS s, (vec_id * 13) % 100 / 100 AS score FROM embeddings"
_FACE = f"SELECT image_id, det_idx, vec_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, s::DOUBLE AS s, score::DOUBLE AS score FROM ({_FACE})"
_IOU = "CASE WHEN least({a}.x + {a}.w, {b}.x + {b}.w) <= greatest({a}.x, {b}.x) OR least({a}.y + {a}.h, {b}.y + {b}.h) <= greatest({a}.y, {b}.y) THEN 0.0 ELSE (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / ({a}.w * {a}.h + {b}.w * {b}.h - (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))) END"


def _faces(spark, sf_dir):
    """Four boxes a picture of 100 x 100, made of the ids of all embeddings."""
    i = F.col("vec_id")
    number = lambda c: c.cast("double")
    box = F.struct(number(i * 37 % 90 - 5.4).alias("x"), number(i * 53 % 70 + 0.25).alias("y"), number(20.0 + i * 29 % 90).alias("width"), number(20.0 + i * 31 % 90).alias("height"))
    return _table(spark, sf_dir, "embeddings").select(
        F.floor(i / 4).cast("long").alias("image_id"), (i % 4).alias("det_idx"), "vec_id", box.alias("box"), number(i * 7 % 80 + 0.53).alias("s"), number(i * 13 % 100 / 100).alias("score"),
        F.lit(100).alias("image_width"), F.lit(100).alias("image_height"),
    )


@query(f"SELECT a.vec_id, a.w * a.h AS area, a.x + a.w AS right_edge, a.y + a.h AS bottom_edge, round({_IOU.format(a='a', b='b')}, 6) AS iou FROM ({_FACE}) a JOIN ({_FACE}) b ON b.image_id = a.image_id AND b.det_idx = (a.det_idx + 1) % 4")
def box_area_iou(spark, sf_dir):
    f = _faces(spark, sf_dir)
    b = f.select("image_id", ((F.col("det_idx") + 3) % 4).alias("det_idx"), F.col("box").alias("next"))
    t = f.join(b, ["image_id", "det_idx"])
    return rounded(t.select("vec_id", geometry.area(F.col("box")).alias("area"), geometry.right(F.col("box")).alias("right_edge"), geometry.bottom(F.col("box")).alias("bottom_edge"), geometry.iou(F.col("box"), F.col("next")).alias("iou")), "iou", "right_edge", "bottom_edge")


@query(f"SELECT image_id, det_idx, x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round((x + w / 2 - 50) * (x + w / 2 - 50) + (y + h / 2 - 50) * (y + h / 2 - 50), 9), det_idx) AS r FROM ({_FACE})) WHERE r = 1")
def centre_most_face(spark, sf_dir):
    return geometry.centre_most(_faces(spark, sf_dir)).select("image_id", "det_idx", F.col("box.x").alias("x"))


_EYES = "x + 10 + vec_id % 7 AS lx, y + 12 AS ly, x + w - 10 AS rx, y + 12.137 + vec_id % 30 AS ry"
_VERDICT = f"""SELECT *, CASE WHEN w < 60 OR h < 60 THEN printf('face too small: %.0fx%.0f, minimum is 60', w, h)
  WHEN CASE WHEN abs(lx - rx) < 1 THEN 1e300 ELSE abs(ly - ry) / abs(lx - rx) END > 0.35 THEN printf('extreme pose or roll: eye tilt ratio %.2f', abs(ly - ry) / abs(lx - rx))
  WHEN s < 40 THEN printf('too blurry: sharpness %.1f below 40.0', s) END AS reason FROM (SELECT *, {_EYES} FROM ({_FACE}))"""


def _pointed(spark, sf_dir):
    f, i = _faces(spark, sf_dir), F.col("vec_id")
    left = F.struct((F.col("box.x") + 10 + i % 7).alias("x"), (F.col("box.y") + 12).alias("y"))
    right = F.struct((F.col("box.x") + F.col("box.width") - 10).alias("x"), (F.col("box.y") + 12.137 + i % 30).alias("y"))
    return f.withColumn("points", F.struct(left.alias("left_eye"), right.alias("right_eye"))).withColumnRenamed("s", "sharpness")


@query(f"SELECT vec_id, reason IS NULL AS accepted, CASE WHEN reason IS NULL THEN s END AS sharpness, reason FROM ({_VERDICT})")
def face_verdict(spark, sf_dir):
    v = geometry.assess(F.col("box"), F.col("points.left_eye"), F.col("points.right_eye"), F.col("sharpness"))
    return _pointed(spark, sf_dir).select("vec_id", v.alias("v")).select("vec_id", "v.accepted", "v.sharpness", "v.reason")


@query(f"SELECT image_id, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round((x + w / 2 - 50) * (x + w / 2 - 50) + (y + h / 2 - 50) * (y + h / 2 - 50), 9), det_idx) AS r FROM ({_VERDICT})) WHERE r = 1 AND reason IS NULL")
def usable_faces(spark, sf_dir):
    return enrolment.usable(_pointed(spark, sf_dir)).select("image_id", "det_idx")


@query(f"SELECT vec_id, x0, y0, x0 + least(100 - x0, trunc(w)::INT) AS x1, y0 + least(100 - y0, trunc(h)::INT) AS y1 FROM (SELECT vec_id, w, h, greatest(0, trunc(x)::INT) AS x0, greatest(0, trunc(y)::INT) AS y0 FROM ({_FACE}))")
def face_crop(spark, sf_dir):
    c = geometry.crop(F.col("box"), F.col("image_width"), F.col("image_height"))
    return _faces(spark, sf_dir).select("vec_id", c.alias("c")).select("vec_id", "c.*")


@query(f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_idx) AS r FROM ({_FACE})),
k AS (SELECT image_id, r, [det_idx] AS kept FROM d WHERE r = 1
  UNION ALL SELECT d.image_id, d.r, CASE WHEN EXISTS (SELECT 1 FROM d o WHERE o.image_id = d.image_id AND list_contains(k.kept, o.det_idx) AND {_IOU.format(a='o', b='d')} > 0.3) THEN k.kept ELSE list_append(k.kept, d.det_idx) END
  FROM k JOIN d ON d.image_id = k.image_id AND d.r = k.r + 1)
SELECT image_id, unnest(kept) AS det_idx FROM (SELECT image_id, arg_max(kept, r) AS kept FROM k GROUP BY image_id)""")
def suppressed_faces(spark, sf_dir):
    return geometry.suppressed(_faces(spark, sf_dir)).select("image_id", "det_idx")


_TEMPLATE = ", ".join(f"({j}, {x}, {y})" for j, (x, y) in enumerate(geometry.TEMPLATE))


@query(f"""WITH p AS (SELECT vec_id, u::DOUBLE AS u, v::DOUBLE AS v, u * 1.5 + (vec_id * (j + 1)) % 7 - 0.3 * v AS x, v * 1.5 + (vec_id * (j + 2)) % 5 + 0.3 * u AS y FROM embeddings, (VALUES {_TEMPLATE}) t(j, u, v)),
c AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, u - avg(u) OVER w AS du, v - avg(v) OVER w AS dv FROM p WINDOW w AS (PARTITION BY vec_id)),
m AS (SELECT vec_id, sum(dx * du + dy * dv) / sum(dx * dx + dy * dy) AS a, sum(dx * dv - dy * du) / sum(dx * dx + dy * dy) AS b, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM c GROUP BY vec_id)
SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 6) AS tx, round(mv - b * mx - a * my, 6) AS ty FROM m""")
def face_similarity(spark, sf_dir):
    i = F.col("vec_id")
    points = [c for j, (u, v) in enumerate(geometry.TEMPLATE) for c in (F.lit(u * 1.5 - 0.3 * v) + i * (j + 1) % 7, F.lit(v * 1.5 + 0.3 * u) + i * (j + 2) % 5)]
    m = _table(spark, sf_dir, "embeddings").select("vec_id", geometry.similarity(F.array(*points)).alias("m"))
    at = lambda k: F.get("m", F.lit(k))
    return rounded(m.select("vec_id", at(0).alias("a"), at(3).alias("b"), at(2).alias("tx"), at(5).alias("ty")), "a", "b", "tx", "ty")


@query("SELECT c_custkey, 512 AS dimension, 1.0::DOUBLE AS norm, true AS again FROM customer")
def synthetic_units(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", vectors.unit(F.col("c_custkey")).alias("v"))
    return rounded(c.select("c_custkey", F.size("v").alias("dimension"), vectors.norm(F.col("v")).alias("norm"), (F.col("v") == vectors.unit(F.col("c_custkey"))).alias("again")), "norm")


@query("SELECT o_orderkey, round(o_totalprice * 1000 / 7, 6) AS avg_ns, round(7e9 / (o_totalprice * 1000), 6) AS per_second, round(1000 * (o_totalprice * 1000 / 7 / 1e6) / 1000 / 12, 6) AS seconds FROM orders")
def timed_costs(spark, sf_dir):
    m = vectors.measurement(F.col("o_totalprice").cast("double") * 1000, F.lit(7))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m"))
    return rounded(o.select("o_orderkey", "m.avg_ns", "m.per_second", vectors.projected_cost(F.lit(1000), F.col("m.avg_ms"), F.lit(12)).alias("seconds")), "avg_ns", "per_second", "seconds")


# ---- probe and gallery

_SCORES = "SELECT p.vec_id AS probe_id, p.label AS own, g.label AS gallery_id, round(max(list_dot_product(p.embedding::DOUBLE[], g.embedding::DOUBLE[])), 6) AS score FROM embeddings p, embeddings g WHERE p.vec_id % 2 = 1 AND g.vec_id % 2 = 0 GROUP BY ALL"


def _scores(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    probes = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("probe_id"), F.col("label").alias("own"), F.col("embedding").alias("v"))
    gallery = e.where("vec_id % 2 = 0").select(F.col("label").alias("gallery_id"), F.col("embedding").alias("v"))
    return rounded(scoring.best_scores(probes, gallery), "score")


def _ranked(mode: str) -> str:
    if mode == "raw":
        used = f"SELECT *, score AS used FROM ({_SCORES})"
    else:
        by = "probe_id" if mode == "probe_z" else "gallery_id"
        used = f"SELECT *, CASE WHEN coalesce(sd, 0) <> 0 THEN (score - m) / sd ELSE score END AS used FROM (SELECT *, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd FROM ({_SCORES}) WINDOW w AS (PARTITION BY {by}))"
    return f"""SELECT probe_id, own, max(score) FILTER (gallery_id = own) AS own_score, coalesce(max(place) FILTER (gallery_id = own), 0) AS own_rank, count(*) AS candidates,
  max(score) FILTER (gallery_id = own) >= {THRESHOLD} AS matched, coalesce(max(place) FILTER (gallery_id = own), 0) = 1 AS rank1,
  max(score) FILTER (gallery_id <> own) AS best_other, arg_max(gallery_id, (score, -gallery_id)) FILTER (gallery_id <> own) AS best_other_id
FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(used, 9) DESC, gallery_id) AS place FROM ({used})) GROUP BY probe_id, own"""


_RANKED = _ranked("raw")


def _rank(spark, sf_dir, mode="raw"):
    return scoring.rank(_scores(spark, sf_dir), THRESHOLD, mode)


@query(_SCORES)
def probe_gallery_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"SELECT probe_id, gallery_id, score FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, gallery_id) AS r FROM ({_SCORES})) WHERE r = 1")
def probe_best_gallery(spark, sf_dir):
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("gallery_id").alias("g")))
    return _scores(spark, sf_dir).groupBy("probe_id").agg(best.alias("b")).select("probe_id", F.col("b.g").alias("gallery_id"), (-F.col("b.s")).alias("score"))


@query(_RANKED)
def rank_raw(spark, sf_dir):
    return _rank(spark, sf_dir)


@query(_ranked("probe_z"))
def rank_probe_z(spark, sf_dir):
    return _rank(spark, sf_dir, "probe_z")


@query(_ranked("gallery_z"))
def rank_gallery_z(spark, sf_dir):
    return _rank(spark, sf_dir, "gallery_z")


@query(f"SELECT matched, count(*) AS n FROM ({_RANKED}) GROUP BY matched")
def match_decision(spark, sf_dir):
    return _rank(spark, sf_dir).groupBy("matched").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k, count(*) FILTER (own_rank <= k) AS hits, count(*) AS n, round(count(*) FILTER (own_rank <= k) / count(*), 6) AS rate FROM ({_RANKED}), (SELECT unnest([1, 2, 3, 5, 10]) AS k) WHERE own_rank > 0 GROUP BY k")
def topk_cmc(spark, sf_dir):
    return rounded(scoring.cumulative_match(_rank(spark, sf_dir)), "rate")


_RATES = "count(*) AS n, round(avg(matched::INT), 6) AS match_rate, round(avg(rank1::INT), 6) AS rank1_rate, round(avg(own_score), 6) AS mean_own, round(avg(best_other), 6) AS mean_other"


@query(f"SELECT own, {_RATES} FROM ({_RANKED}) GROUP BY own")
def report_by_identity(spark, sf_dir):
    return rounded(scoring.report_by_identity(_rank(spark, sf_dir)), "match_rate", "rank1_rate", "mean_own", "mean_other")


@query(f"SELECT {_RATES} FROM ({_RANKED})")
def report_total(spark, sf_dir):
    return rounded(scoring.report_total(_rank(spark, sf_dir)), "match_rate", "rank1_rate", "mean_own", "mean_other")


_TARGETED = f"SELECT *, CASE WHEN probe_id % 3 <> 0 THEN probe_id % 10 END AS target FROM ({_RANKED})"
_UPPER = "coalesce((list({x} ORDER BY {x}) FILTER ({when}))[count(*) FILTER ({when}) // 2 + 1], 0)"


def _targeted(spark, sf_dir):
    """Ranked probes, a target for two in three of them."""
    return _rank(spark, sf_dir).withColumn("target", F.when(F.col("probe_id") % 3 != 0, F.col("probe_id") % 10))


@query(f"""SELECT probes, misranked, won_by_target, round(coalesce(won_by_target / nullif(misranked, 0), 0), 6) AS share, round(CASE WHEN ids > 1 THEN 1 / (ids - 1) ELSE 0 END, 6) AS chance, near_misses, round(median_deficit, 6) AS median_deficit, round(median_margin, 6) AS median_margin
FROM (SELECT count(*) AS probes, count(DISTINCT own) AS ids, count(*) FILTER (NOT rank1 AND target IS NOT NULL) AS misranked, count(*) FILTER (NOT rank1 AND best_other_id = target) AS won_by_target,
  count(*) FILTER (NOT rank1 AND target IS NOT NULL AND best_other - own_score < 0.02) AS near_misses,
  {_UPPER.format(x='(best_other - own_score)', when='NOT rank1 AND target IS NOT NULL')} AS median_deficit, {_UPPER.format(x='(own_score - best_other)', when='rank1 AND target IS NOT NULL')} AS median_margin FROM ({_TARGETED}))""")
def diagnostics(spark, sf_dir):
    return rounded(scoring.diagnostics(_targeted(spark, sf_dir)), "share", "chance", "median_deficit", "median_margin")


@query(f"""SELECT known, outranks, round(outranks / known, 6) AS outrank_share, round(coalesce(won / nullif(wrong, 0), 0), 6) AS error_share, round(CASE WHEN ids > 1 THEN 1 / (ids - 1) ELSE 0 END, 6) AS chance, round(median_gap, 6) AS median_gap, tight
FROM (SELECT count(target) AS known, count(DISTINCT own) AS ids, count(*) FILTER (best_other_id = target AND best_other > own_score) AS outranks, count(*) FILTER (NOT rank1 AND target IS NOT NULL) AS wrong,
  count(*) FILTER (NOT rank1 AND best_other_id = target) AS won, count(*) FILTER (target IS NOT NULL AND abs(own_score - best_other) < 0.05) AS tight, {_UPPER.format(x='abs(own_score - best_other)', when='target IS NOT NULL')} AS median_gap FROM ({_TARGETED}))""")
def leakage_report(spark, sf_dir):
    return rounded(scoring.leakage(_targeted(spark, sf_dir)), "outrank_share", "error_share", "chance", "median_gap")


@query(f"""SELECT max(candidates) AS candidates, count(*) AS n, (list(own_rank ORDER BY own_rank))[count(*) // 2 + 1] AS median_rank, round(avg(own_rank), 6) AS mean_rank, count(*) FILTER (own_rank > 1) AS missed,
  round(coalesce(count(*) FILTER (own_rank = 2) / nullif(count(*) FILTER (own_rank > 1), 0), 0), 6) AS second FROM ({_RANKED}) WHERE own_rank > 0""")
def cumulative_summary(spark, sf_dir):
    return rounded(scoring.cumulative_summary(_rank(spark, sf_dir)), "mean_rank", "second")


_VIDEOS = "SELECT vec_id // 4 AS probe_id, min(label) AS own FROM embeddings GROUP BY 1"


@query(f"""WITH v AS (SELECT * FROM ({_VIDEOS}) WHERE own < 8), t AS (SELECT vec_id // 4 AS probe_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1 AND vec_id // 4 % 5 <> 0), g AS (SELECT label AS gallery_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0 AND label < 8)
SELECT v.probe_id, v.own, g.gallery_id, round(coalesce(max(list_dot_product(t.v, g.v)), -9), 6) AS score FROM v CROSS JOIN g LEFT JOIN t ON t.probe_id = v.probe_id GROUP BY ALL""")
def collected_scores(spark, sf_dir):
    """Videos of four vectors; identities 8 and 9 have no gallery, every fifth video no track (-9 for -infinity)."""
    e = _table(spark, sf_dir, "embeddings")
    video = F.floor(F.col("vec_id") / 4).cast("long")
    videos = e.groupBy(video.alias("probe_id")).agg(F.min("label").alias("own"))
    tracks = e.where((F.col("vec_id") % 2 == 1) & (video % 5 != 0)).select(video.alias("probe_id"), F.col("embedding").alias("v"))
    gallery = e.where("vec_id % 2 = 0 and label < 8").select(F.col("label").alias("gallery_id"), F.col("embedding").alias("v"))
    out = scoring.collected(videos, tracks, gallery)
    return rounded(out.withColumn("score", F.when(F.col("score") == scoring.NO_SCORE, -9.0).otherwise(F.col("score"))), "score")


@query(f"SELECT count(*) AS n, (list(own_score ORDER BY own_score))[count(*) // 2 + 1] AS upper_median FROM ({_RANKED})")
def upper_median(spark, sf_dir):
    return longs(ordered.upper_median(_rank(spark, sf_dir), "own_score"), "n")


@query(f"SELECT p.same, count(*) AS pairs, count(*) FILTER (p.a_id % 7 = 0 OR p.b_id % 7 = 0) AS skipped FROM ({_PAIR}) p GROUP BY p.same")
def unscorable_pairs(spark, sf_dir):
    """Pairs of which a side has no vector (ids that 7 divides, here) are skipped and counted."""
    p = _pairs(spark, sf_dir).select("a_id", "b_id", "same")
    have = _table(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    scored = metrics.scored_pairs(p, have, vectors.dot)
    return scored.groupBy("same").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score").isNull()).alias("skipped"))


# ---- metrics

_ROC = f"""SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS far, 0.0::DOUBLE AS tar UNION ALL
SELECT score, sum(i) OVER w / sum(i) OVER (), sum(g) OVER w / sum(g) OVER () FROM (SELECT score, count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM ({_SCORED}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


def _roc(spark, sf_dir):
    return metrics.roc(metrics.validated(_scored(spark, sf_dir)))


@query(f"SELECT threshold, round(far, 6) AS far, round(tar, 6) AS tar FROM ({_ROC}) WHERE threshold < 1e9")
def roc_points(spark, sf_dir):
    return rounded(_roc(spark, sf_dir).where("threshold < 1e9"), "far", "tar")


@query(f"SELECT round(sum((far - f0) * (tar + t0) / 2), 6) AS auc FROM (SELECT *, lag(far) OVER w AS f0, lag(tar) OVER w AS t0 FROM ({_ROC}) WINDOW w AS (ORDER BY far, threshold DESC))")
def auc(spark, sf_dir):
    return rounded(metrics.auc(_roc(spark, sf_dir)), "auc")


@query(f"SELECT round((far + 1 - tar) / 2, 6) AS eer, threshold FROM ({_ROC}) ORDER BY abs(far - (1 - tar)), threshold DESC LIMIT 1")
def eer(spark, sf_dir):
    return rounded(metrics.equal_error_rate(_roc(spark, sf_dir)), "eer")


@query(f"SELECT round(tar, 6) AS tar, threshold FROM ({_ROC}) WHERE far <= 0.01 ORDER BY tar DESC, threshold DESC LIMIT 1")
def tar_at_far(spark, sf_dir):
    pairs = _scored(spark, sf_dir)
    return rounded(metrics.tar_at_far(metrics.roc(pairs), 0.01, pairs.where("not same").count()), "tar")


_CUM = f"SELECT score, sum(g) OVER w + sum(i) OVER () - sum(i) OVER w AS correct, sum(g + i) OVER () AS n FROM (SELECT score, count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM ({_SCORED}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"


@query(f"SELECT score AS threshold, round(correct / n, 6) AS accuracy FROM ({_CUM}) ORDER BY correct DESC, score DESC LIMIT 1")
def best_global_threshold(spark, sf_dir):
    return rounded(metrics.best_global_threshold(_scored(spark, sf_dir)), "accuracy")


_FOLDS = f"""WITH s AS (SELECT (row_number() OVER (ORDER BY a_id, b_id) - 1) AS idx, same, score FROM ({_SCORED}) QUALIFY idx < 6000),
p AS (SELECT idx // 600 AS fold, same, score FROM s),
t AS (SELECT f.fold, p.score, count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM (SELECT unnest(range(10)) AS fold) f JOIN p ON p.fold <> f.fold GROUP BY f.fold, p.score),
c AS (SELECT fold, score, sum(g) OVER w + sum(i) OVER (PARTITION BY fold) - sum(i) OVER w AS correct FROM t WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
b AS (SELECT fold, score FROM c QUALIFY row_number() OVER (PARTITION BY fold ORDER BY correct DESC, score DESC) = 1)
SELECT b.fold::INT AS fold, b.score AS threshold, round(count(*) FILTER ((p.score >= b.score) = p.same) / 600, 6) AS accuracy FROM b JOIN p USING (fold) GROUP BY b.fold, b.score"""


@query(_FOLDS)
def ten_fold_cv(spark, sf_dir):
    return rounded(metrics.ten_fold(_first_6000(spark, sf_dir)), "accuracy")


def _first_6000(spark, sf_dir):
    """The protocol is of exactly 6000 numbered pairs."""
    first = _scored(spark, sf_dir).orderBy("a_id", "b_id").limit(6000)
    return ordered.positions(first, "a_id", "b_id").withColumnRenamed("pos", "pair_idx")


@query(f"SELECT round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy) / sqrt(count(*)), 6) AS stderr FROM ({_FOLDS})")
def ten_fold_summary(spark, sf_dir):
    return rounded(metrics.ten_fold_summary(metrics.ten_fold(_first_6000(spark, sf_dir))), "mean", "stderr")


@query(f"""SELECT g AS genuine, i AS impostors, 0::BIGINT AS skipped, a.auc, e.eer, e.threshold AS eer_threshold FROM (SELECT count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM ({_SCORED})),
(SELECT round(sum((far - f0) * (tar + t0) / 2), 6) AS auc FROM (SELECT *, lag(far) OVER w AS f0, lag(tar) OVER w AS t0 FROM ({_ROC}) WINDOW w AS (ORDER BY far, threshold DESC))) a,
(SELECT round((far + 1 - tar) / 2, 6) AS eer, threshold FROM ({_ROC}) ORDER BY abs(far - (1 - tar)), threshold DESC LIMIT 1) e""")
def verification_report(spark, sf_dir):
    r = metrics.verification(_scored(spark, sf_dir), ())
    row = [(r["genuine"], r["impostors"], r["skipped"], r["auc"], r["eer"], r["eer_threshold"])]
    return rounded(spark.createDataFrame(row, "genuine long, impostors long, skipped long, auc double, eer double, eer_threshold double"), "auc", "eer")


# ---- sets

_SETS = "SELECT label * 1000000 + vec_id // 6 AS set_id, vec_id AS idx, embedding::DOUBLE[] AS e FROM embeddings"


def _sets(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select((F.col("label").cast("long") * 1000000 + F.floor(F.col("vec_id") / 6)).cast("long").alias("set_id"), F.col("vec_id").alias("idx"), "embedding")


_CONSIST = f"""WITH s AS ({_SETS}),
m AS (SELECT set_id, list(t / l ORDER BY pos) AS m FROM (SELECT set_id, pos, t, sqrt(sum(t * t) OVER (PARTITION BY set_id)) AS l FROM (SELECT set_id, pos, sum(x) AS t FROM (SELECT set_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM s) GROUP BY set_id, pos)) GROUP BY set_id),
c AS (SELECT set_id, count(*) AS n, count(*) FILTER (list_dot_product(s.e, m.m) < 0.35) AS o FROM s JOIN m USING (set_id) GROUP BY set_id),
w AS (SELECT a.set_id, min(list_dot_product(a.e, b.e)) AS min_similarity FROM s a JOIN s b ON a.set_id = b.set_id AND a.idx < b.idx GROUP BY a.set_id)
SELECT set_id, n, CASE WHEN n > 1 THEN o ELSE 0 END AS outliers, round(min_similarity, 6) AS min_similarity,
  CASE WHEN n > 1 AND (o > 0 OR min_similarity < 0.175) THEN 'Mixed' ELSE 'Consistent' END AS verdict FROM c LEFT JOIN w USING (set_id)"""


@query(_CONSIST)
def identity_consistency(spark, sf_dir):
    return rounded(identity.consistency(_sets(spark, sf_dir)), "min_similarity")


_DECIDE = f"""SELECT set_id, n, CASE WHEN n < 3 THEN 'RejectedTooFewPhotos' WHEN verdict = 'Mixed' THEN 'RejectedMixedIdentity' ELSE 'Accepted' END AS outcome,
  CASE WHEN n < 3 THEN n || ' usable photographs, at least 3 required' WHEN verdict = 'Mixed' THEN CASE outliers WHEN 0 THEN 'the photographs do not all show the same person' WHEN 1 THEN '1 photograph shows a different person' ELSE outliers || ' photographs show a different person' END || printf(' (lowest similarity %.3f)', min_similarity) END AS reason FROM ({_CONSIST})"""


@query(_DECIDE)
def enrolment_decision(spark, sf_dir):
    # as printf of the SQL: the similarity at 6 places, then the binary value of that at 3, which Java's formats do not show
    printf = F.udf(lambda x: None if x is None else f"{x:.3f}", "string")
    return identity.decide(_sets(spark, sf_dir), shown=lambda s: printf(six_places(s)))


@query(f"SELECT outcome, count(*) AS sets, sum(n)::BIGINT AS photos FROM ({_DECIDE}) GROUP BY outcome")
def enrolment_outcome_counts(spark, sf_dir):
    return identity.decide(_sets(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("photos"))


def _picked(sets: str) -> str:
    """(set_id, pick, idx): farthest points, five of each set, by a recursion over all similarities of a set."""
    return f"""WITH RECURSIVE s AS ({sets}), c AS (SELECT set_id, count(*) AS n FROM s GROUP BY set_id),
v AS (SELECT a.set_id, a.idx AS a, b.idx AS b, list_dot_product(a.e, b.e) AS v FROM s a JOIN s b USING (set_id)),
m AS (SELECT set_id, list(t / l ORDER BY pos) AS m FROM (SELECT set_id, pos, t, sqrt(sum(t * t) OVER (PARTITION BY set_id)) AS l FROM (SELECT set_id, pos, sum(x) AS t FROM (SELECT set_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM s) GROUP BY set_id, pos)) GROUP BY set_id),
p AS (SELECT set_id, 1 AS k, [arg_min(idx, (round(list_dot_product(e, m), 12), idx))] AS picks FROM s JOIN m USING (set_id) JOIN c USING (set_id) WHERE n > 5 GROUP BY set_id
  UNION ALL SELECT set_id, k + 1, list_append(picks, arg_min(a, (round(w, 12), a))) FROM (SELECT p.set_id, p.k, p.picks, v.a, max(v.v) AS w FROM p JOIN v ON v.set_id = p.set_id AND list_contains(p.picks, v.b) AND NOT list_contains(p.picks, v.a) WHERE p.k < 5 GROUP BY ALL) GROUP BY set_id, k, picks),
o AS (SELECT set_id, picks FROM p WHERE k = 5 UNION ALL SELECT set_id, list(idx ORDER BY idx) FROM s JOIN c USING (set_id) WHERE n <= 5 GROUP BY set_id)
SELECT set_id, (generate_subscripts(picks, 1) - 1)::INT AS pick, unnest(picks) AS idx FROM o"""


@query(_picked("SELECT label::BIGINT AS set_id, vec_id AS idx, embedding::DOUBLE[] AS e FROM embeddings"))
def gallery_selection(spark, sf_dir):
    """Farthest points of each label."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("set_id"), F.col("vec_id").alias("idx"), "embedding")
    return identity.select(e)


@query(f"SELECT set_id, pick, idx FROM ({_picked(_SETS)}) JOIN (SELECT set_id FROM ({_DECIDE}) WHERE outcome = 'Accepted') USING (set_id)")
def enrolled_gallery(spark, sf_dir):
    return identity.enrolled(_sets(spark, sf_dir)).select("set_id", "pick", "idx")


# ---- names, sessions, tracks

_NAMES = "SELECT event_id, 'id' || user_id || '_id' || (user_id + 1) || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0') || CASE WHEN event_id % 3 = 0 THEN '.mp4' WHEN event_id % 3 = 1 THEN '' ELSE '_x.mp4' END AS name FROM events"


def _names(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    tail = F.when(F.col("event_id") % 3 == 0, ".mp4").when(F.col("event_id") % 3 == 1, "").otherwise("_x.mp4")
    return e.select("event_id", F.concat(F.lit("id"), "user_id", F.lit("_id"), F.col("user_id") + 1, F.lit("_"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), tail).alias("name"))


@query(f"SELECT event_id, nullif(regexp_extract(name, '^([^_]*)_([^_]*)_([^_]+?)([.]mp4)?$', 1), '') AS target, split_part(name, '_', 2) AS impersonated FROM ({_NAMES})")
def parse_target(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("event_id", protocol.target_of(F.col("name")).alias("target"), protocol.impersonated(F.col("name")).alias("impersonated"))


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session""")
def track_gap_sessions(spark, sf_dir):
    return tracking.gap_sessions(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600, "event_id")


@query()
def tracks(spark, sf_dir):
    """Tracks over detections made of embeddings: a video a label, two boxes a frame; sequential, tested against expectations."""
    e = _table(spark, sf_dir, "embeddings")
    d = e.select(F.concat(F.lit("v"), "label").alias("video"), (F.floor(F.col("vec_id") / 2) * 0.5).cast("double").alias("ts"), (F.col("vec_id") % 2).cast("int").alias("det_idx"), (F.col("vec_id") % 2 * 100.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(50.0).alias("height"), "embedding")
    return tracking.track(d)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 1e6 / 86400) ORDER BY epoch_us(ts), event_id) AS r FROM events) WHERE r = 1")
def sampled_frames(spark, sf_dir):
    """The first event of each user and day, as the first frame of each interval of a video."""
    e = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frames = e.groupBy(F.col("user_id").alias("video"), (at / 1e6).alias("ts")).agg(F.min("event_id").alias("event_id"))
    return tracking.sampled(frames, 86400.0).select("event_id", F.col("video").alias("user_id"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY d) AS k FROM (SELECT DISTINCT user_id, floor(epoch_us(ts) / 1e6 / 86400) AS d FROM events)) WHERE k <= 3 GROUP BY user_id")
def first_frames(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").alias("video"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return tracking.first_frames(frames, 3, 86400.0).groupBy(F.col("video").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


# ---- packed slots

_GROUPS = "SELECT vec_id // 16 AS g, vec_id % 16 AS idx, embedding::DOUBLE[] AS v FROM embeddings"


def _packed(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return slots.pack(e.select(F.floor(F.col("vec_id") / 16).cast("long").alias("g"), (F.col("vec_id") % 16).alias("idx"), F.col("embedding").alias("v")), "g", 64)


@query(f"SELECT g, count(*) AS n, 1024 AS slots, round(sum(list_sum(v)), 6) AS total FROM ({_GROUPS}) GROUP BY g")
def pack_gallery(spark, sf_dir):
    p = _packed(spark, sf_dir)
    return rounded(longs(p.select("g", "n", F.size("slots").cast("int").alias("slots"), F.aggregate("slots", F.lit(0.0), lambda s, x: s + x).alias("total")), "n"), "total")


@query(f"SELECT g, idx, round(list_dot_product(v, q.q), 6) AS score FROM ({_GROUPS}), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) q")
def batched_block_scores(spark, sf_dir):
    q = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    p = _packed(spark, sf_dir).crossJoin(F.broadcast(q))  # one row
    s = p.select("g", F.posexplode(slots.scores(p, F.col("q"), 64)).alias("idx", "score"))
    return rounded(longs(s, "idx"), "score")


@query(f"SELECT g, idx, round(list_dot_product(v, v), 6) AS own, round(list_dot_product(v, q.q), 6) AS score FROM ({_GROUPS}), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1) q")
def rotated_sums(spark, sf_dir):
    """Each block's sum of squares by rotations, and packed queries against one vector in every block."""
    q = _table(spark, sf_dir, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("q"))
    batches = slots.batch(_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id").select(F.col("batch").alias("g"), "idx", "v")
    p = slots.pack(batches, "g", 64).crossJoin(F.broadcast(q))  # one row
    squares = slots.rotate_and_sum(F.zip_with("slots", "slots", lambda x, y: x * y), 64)
    s = p.select("g", squares.alias("squares"), F.posexplode(slots.batch_scores(p, F.col("q"), 64)).alias("idx", "score"))
    return rounded(longs(s.select("g", "idx", F.get("squares", F.col("idx") * 64).alias("own"), "score"), "idx"), "own", "score")


# ---- protocol files and splits


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations")
def positional_order(spark, sf_dir):
    from pyspark.sql import Window

    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("pos"))


_LINES = "SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 50 = 0 THEN '  ' WHEN o_orderkey % 49 = 0 THEN '10	300' WHEN o_orderkey % 2 = 0 THEN 'Name_' || o_custkey || '	' || (o_orderkey % 12000) || ' 7' ELSE ' Name_' || o_custkey || '	3	Other_' || (o_orderkey % 10) || '	' || (o_orderkey % 9) END AS value FROM orders"


@query(f"""SELECT (row_number() OVER (ORDER BY line_no) - 1) AS pair_idx, f[1] || '/' || f[1] || printf('_%04d.jpg', f[2]::INT) AS image_a,
  CASE WHEN len(f) = 3 THEN f[1] || '/' || f[1] || printf('_%04d.jpg', f[3]::INT) ELSE f[3] || '/' || f[3] || printf('_%04d.jpg', f[4]::INT) END AS image_b, len(f) = 3 AS same
FROM (SELECT line_no, regexp_split_to_array(trim(value, E' \t'), '\s+') AS f FROM ({_LINES}) WHERE trim(value, E' \t') <> '') WHERE len(f) <> 2""")
def parse_pairs(spark, sf_dir):
    """Lines of a pair file, made of orders: blank ones, headers, genuine and impostor pairs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    genuine = F.concat(F.lit("Name_"), c, F.lit("\t"), (k % 12000).cast("string"), F.lit(" 7"))
    impostor = F.concat(F.lit(" Name_"), c, F.lit("\t3\tOther_"), (k % 10).cast("string"), F.lit("\t"), (k % 9).cast("string"))
    value = F.when(k % 50 == 0, "  ").when(k % 49 == 0, "10\t300").when(k % 2 == 0, genuine).otherwise(impostor)
    return protocol.parse_pairs(_table(spark, sf_dir, "orders").select(k.alias("line_no"), value.alias("value")))


_LISTED = "SELECT CASE WHEN event_id % 4 = 0 THEN 'fake' ELSE 'real' END AS kind, CASE WHEN event_id % 4 = 0 THEN name ELSE 'id' || user_id || '_' || lpad((event_id % 40)::VARCHAR, 4, '0') || '.mp4' END AS name FROM (SELECT *, 'id' || user_id || '_id' || (user_id + 1) || '_' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '.mp4' AS name FROM events) WHERE event_id % 5 < 2"
_REALS = "SELECT DISTINCT 'id' || user_id AS identity, 'id' || user_id || '_' || lpad((event_id % 40)::VARCHAR, 4, '0') || '.mp4' AS name FROM events"


@query(f"""WITH l AS (SELECT DISTINCT kind, name FROM ({_LISTED})), p AS (SELECT split_part(name, '_', 2) AS identity, name FROM l WHERE kind = 'fake'),
g AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY name) AS r FROM ({_REALS}) WHERE name NOT IN (SELECT name FROM l WHERE kind = 'real') AND identity IN (SELECT identity FROM p))
SELECT 'probe' AS part, identity, name FROM p UNION ALL SELECT 'gallery', identity, name FROM g WHERE r <= 4""")
def prepared_split(spark, sf_dir):
    """A test split's probes and gallery videos, from lists made of events."""
    e = _table(spark, sf_dir, "events")
    four = lambda c: F.lpad(c.cast("string"), 4, "0")
    fake = F.concat(F.lit("Celeb-synthesis/id"), "user_id", F.lit("_id"), F.col("user_id") + 1, F.lit("_"), four(F.col("event_id") % 10000), F.lit(".mp4"))
    real = F.concat(F.lit("id"), "user_id", F.lit("_"), four(F.col("event_id") % 40), F.lit(".mp4"))
    lines = e.where("event_id % 5 < 2").select(F.concat(F.lit("1 "), F.when(F.col("event_id") % 4 == 0, fake).otherwise(F.concat(F.lit("Celeb-real/"), real))).alias("value"))
    probes, gallery = protocol.prepared(e.select(fake.alias("name")).limit(0), e.select(real.alias("name")).distinct(), protocol.split_list(lines).distinct())
    return probes.select(F.lit("probe").alias("part"), "identity", "name").union(gallery.select(F.lit("gallery").alias("part"), "identity", "name"))


@query("""WITH g AS (SELECT user_id::VARCHAR AS identity, event_id FROM events WHERE event_id % 3 = 0), f AS (SELECT user_id::VARCHAR AS identity, event_id FROM events WHERE event_id % 7 = 1)
SELECT identity, count(*) FILTER (k = 'g') AS images, count(*) FILTER (k = 'f') AS fakes FROM (SELECT *, 'g' AS k FROM g UNION ALL SELECT *, 'f' FROM f) WHERE identity IN (SELECT identity FROM g) AND identity IN (SELECT identity FROM f) GROUP BY identity""")
def discovered(spark, sf_dir):
    """Identities that have both pictures and fakes, from listings made of events."""
    e = _table(spark, sf_dir, "events")
    path = lambda folder, end: F.concat(F.lit("file:/data/"), "user_id", F.lit(f"/{folder}/"), "event_id", F.lit(end)).alias("path")
    gallery, fakes = protocol.paired(e.where("event_id % 3 = 0").select(path("gallery", ".JPG")), e.where("event_id % 7 = 1").select(path("fake", ".mp4")))
    count = lambda df, name: df.groupBy("identity").agg(F.count(F.lit(1)).alias(name))
    return count(gallery, "images").join(count(fakes, "fakes"), "identity")


@query(f"SELECT probe_id, 'g=' || gallery_id AS gallery_id, score FROM ({_SCORES})")
def score_cells_roundtrip(spark, sf_dir):
    s = _scores(spark, sf_dir).select("probe_id", F.col("own").cast("string").alias("identity"), F.concat(F.lit("v"), "probe_id").alias("video"), F.concat(F.lit("g="), "gallery_id").alias("gallery_id"), F.col("gallery_id").alias("gallery_pos"), "score")
    return protocol.read_score_lines(protocol.score_lines(s)).select("probe_id", "gallery_id", "score")


@query(f"SELECT name FROM ({_NAMES}) WHERE event_id % 5 <> 0 AND name NOT IN (SELECT name FROM ({_NAMES}) WHERE event_id % 5 = 0)")
def split_anti_join(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.where("event_id % 5 <> 0").join(n.where("event_id % 5 = 0"), "name", "left_anti").select("name")


_CRC = f"""SELECT name, 4294967295 - list_reduce(list_concat([0::BIGINT], list_transform(range(1, len(line) + 1), lambda i: ascii(line[i])::BIGINT), CASE WHEN len(line) > 255 THEN [len(line) % 256, len(line) // 256] ELSE [len(line)] END),
  lambda c, b: xor((c & 16777215) * 256, {protocol._crc_table()}[xor(c >> 24, b) + 1]::BIGINT)) AS key FROM (SELECT name, '20260818:' || name AS line FROM (SELECT DISTINCT name FROM ({_NAMES})))"""


@query(f"SELECT name, key FROM ({_CRC}) ORDER BY key, name LIMIT 500")
def deterministic_sample(spark, sf_dir):
    return protocol.deterministic_sample(_names(spark, sf_dir).select("name").distinct(), "20260818", 500)


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 4")
def first_n_per_identity(spark, sf_dir):
    return protocol.first_per(_table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 4)


# ---- store


@query("SELECT o_custkey AS id, max(o_totalprice) FILTER (o_orderkey % 2 = 0) AS newest, count(*) FILTER (o_orderkey % 2 = 0) > 0 AS updated FROM orders GROUP BY o_custkey")
def upsert_keys(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    old = o.groupBy(F.col("o_custkey").alias("id")).agg(F.lit(None).cast(o.schema["o_totalprice"].dataType).alias("newest"), F.lit(False).alias("updated"), F.lit(0).alias("created_at"))
    new = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("newest"), F.lit(True).alias("updated"), F.lit(1).alias("created_at"))
    return store.upsert(old, new, "id").select("id", "newest", "updated")


@query("SELECT c_custkey, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 GROUP BY c_custkey")
def cascade_delete(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    left = store.cascade_delete({"enrolled_user": users, "key_material": rows}, users.where("id % 3 = 0"))
    return left["enrolled_user"].join(left["key_material"], F.col("id") == F.col("user_id"), "left").groupBy(F.col("id").alias("c_custkey")).agg(F.count("o_orderkey").alias("children"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def audit_counts(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def audit_for_user(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return store.audit_for(e, 7).select(F.col("id").alias("event_id"), "user_id", "event_type")
