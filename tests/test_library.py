import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinvec.functions import geometry, vectors
from kinvec.operators import identity, metrics, ordered, reports, scoring, slots, tracking
from kinvec.operators.tracking import Tracker
from kinvec.plans import queries
from kinvec.sources import protocol, store


def pairs(spark, rows):
    return spark.createDataFrame(rows, "score double, same boolean")


SEPARABLE = [(0.9, True), (0.8, True), (0.7, True), (0.3, False), (0.2, False), (0.1, False)]


def test_vectors(spark):
    r = spark.sql("SELECT array(3f, 4f) AS a, array(1f, 0f) AS b, array(0f, 0f) AS z").select(vectors.normalise(F.col("a")).alias("n"), vectors.dot(F.col("a"), F.col("b")).alias("d")).first()
    assert np.allclose(r["n"], [0.6, 0.8]) and r["d"] == 3
    with pytest.raises(Exception, match="zero or empty"):
        spark.sql("SELECT array(0f, 0f) AS z").select(vectors.normalise(F.col("z"))).collect()
    with pytest.raises(Exception, match="dimension"):
        spark.sql("SELECT array(1f) AS a, array(1f, 0f) AS b").select(vectors.dot(F.col("a"), F.col("b"))).collect()


def test_metrics(spark):
    points = metrics.roc(pairs(spark, SEPARABLE))
    assert metrics.auc(points).first()[0] == 1 and metrics.equal_error_rate(points).first()["eer"] == 0
    r = metrics.tar_at_far(points, 0.0, 3).first()
    assert r["tar"] == 1 and 0.3 < r["threshold"] <= 0.7
    assert metrics.auc(metrics.roc(pairs(spark, [(-s, b) for s, b in SEPARABLE]))).first()[0] == 0
    assert metrics.roc(pairs(spark, [(0.5, True), (0.5, False)])).count() == 2
    same = metrics.roc(pairs(spark, [(0.5, True), (0.5, True), (0.5, False), (0.5, False)]))
    assert metrics.auc(same).first()[0] == 0.5 and metrics.equal_error_rate(same).first()["eer"] == 0.5
    over = metrics.roc(pairs(spark, [(0.9, True), (0.5, True), (0.4, True), (0.6, False), (0.2, False), (0.1, False)]))
    assert abs(metrics.tar_at_far(over, 0.0, 3).first()["tar"] - 1 / 3) < 1e-12
    with pytest.raises(ValueError, match="finer than"):
        metrics.tar_at_far(points, 0.1, 3)
    with pytest.raises(ValueError):
        metrics.validated(pairs(spark, [(0.5, True)]))


def test_running_sums_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    x = np.unique(np.round(rng.normal(size=3000), 3))
    n = rng.integers(1, 9, len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), n.tolist(), strict=True)), "x double, n long").repartition(7)
    for down in (False, True):
        got = {r["x"]: r["s"] for r in ordered.running(df, "x", {"s": "n"}, down).collect()}
        want = np.cumsum(n[::-1])[::-1] if down else np.cumsum(n)
        assert [got[v] for v in x.tolist()] == want.tolist()
    assert [r["pos"] for r in ordered.positions(df, "x").orderBy("x").collect()] == list(range(len(x)))
    values = np.repeat(x, n)
    assert tuple(ordered.upper_median(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()) == (len(values), np.sort(values)[len(values) // 2])
    none = df.where("false")
    assert ordered.positions(none, "x").count() == 0 and tuple(ordered.upper_median(none, "x").first()) == (0, 0.0)


def test_scores_in_blocks(spark):
    rng = np.random.default_rng(6)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=5))
    p = [(i, f"i{i % 3}", unit()) for i in range(23) for _ in range(1 + i % 2)]
    g = [(f"i{i % 4}", unit()) for i in range(31)]
    want = {}
    for i, _, v in p:
        for j, w in g:
            want[i, j] = max(want.get((i, j), -2), float(np.dot(v, w)))
    a, b = spark.createDataFrame(p, "probe_id int, own string, v array<double>"), spark.createDataFrame(g, "gallery_id string, v array<double>")
    for blocks in ((4, 6), (1024, 2048)):
        got = {(r["probe_id"], r["gallery_id"]): r["score"] for r in scoring.best_scores(a, b, *blocks).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(Exception, match="dimension mismatch"):
        scoring.best_scores(a, spark.createDataFrame([("x", [1.0])], "gallery_id string, v array<double>")).collect()
    assert scoring.best_scores(a, b.where("false")).count() == 0


def results(spark, rows):
    return spark.createDataFrame(rows, "own string, target string, rank1 boolean, own_score double, best_other double, best_other_id string, own_rank long, candidates long, matched boolean")


def test_errors_and_leakage(spark):
    rows = [
        ("a", "t", False, 0.50, 0.51, "t", 2, 3, True), ("a", "t", False, 0.40, 0.60, "b", 3, 3, True), ("b", "a", True, 0.70, 0.66, "a", 1, 3, True),
        ("c", None, False, 0.10, 0.90, "a", 2, 3, False), ("c", None, True, 0.90, 0.10, "a", 1, 3, True),
    ]
    d = scoring.diagnostics(results(spark, rows)).first()
    assert (d["probes"], d["misranked"], d["won_by_target"], d["share"], d["chance"], d["near_misses"]) == (5, 2, 1, 0.5, 0.5, 1)
    assert abs(d["median_deficit"] - 0.2) < 1e-12 and abs(d["median_margin"] - 0.04) < 1e-12
    r = scoring.leakage(results(spark, rows)).first()
    assert (r["known"], r["outranks"], r["error_share"], r["chance"], r["tight"]) == (3, 1, 0.5, 0.5, 2) and abs(r["median_gap"] - 0.04) < 1e-12
    one = scoring.diagnostics(results(spark, [("a", "t", True, 0.9, 0.1, "b", 1, 2, True)])).first()
    assert one["chance"] == 0 and one["share"] == 0 and one["median_deficit"] == 0
    c = scoring.cumulative_summary(results(spark, rows)).first()
    assert (c["candidates"], c["n"], c["median_rank"], c["mean_rank"], c["missed"], c["second"]) == (3, 5, 2, 1.8, 3, 2 / 3)
    text = reports.identification_text(results(spark, rows))
    assert "misranked         : 2" in text and "top 1" in text
    assert "no probes with a known target" in reports.identification_text(results(spark, rows[3:]))
    with pytest.raises(ValueError):
        reports.identification_text(results(spark, []))


def test_verification_text(spark):
    text = reports.verification_text(pairs(spark, SEPARABLE), (1e-3,))
    assert "1.0000" in text and "too few impostors" in text
    assert "warning" in reports.verification_text(pairs(spark, [(0.5, True)]))
    skipped = pairs(spark, [*SEPARABLE, (None, True)])
    assert metrics.verification(skipped, (0.5,))["skipped"] == 1


def test_gallery_z(spark):
    rows = [(1, "B", "A", 0.60), (1, "B", "B", 0.55), (2, "B", "A", 0.61), (2, "B", "B", 0.50), (3, "B", "A", 0.59), (3, "B", "B", 0.45)]
    df = spark.createDataFrame(rows, "probe_id int, own string, gallery_id string, score double").withColumn("gallery_id", F.col("gallery_id"))
    ranks = lambda mode: [r["own_rank"] for r in _rank(df, mode)]
    assert ranks("raw") == [2, 2, 2] and ranks("gallery-z") == [1, 2, 1]
    assert [r["matched"] for r in _rank(df, "gallery-z")] == [True, True, True]
    with pytest.raises(ValueError):
        scoring.parse_mode("other")


def _rank(df, mode):
    ids = df.select("probe_id", F.when(F.col("own") == "A", 0).otherwise(1).alias("own"), F.when(F.col("gallery_id") == "A", 0).otherwise(1).alias("gallery_id"), "score")
    return scoring.rank(ids, 0.25, mode).orderBy("probe_id").collect()


def test_selection():
    e = np.eye(4)
    assert identity.farthest_points(e[:3], 5) == [0, 1, 2]
    picked = identity.farthest_points(np.vstack([e[0], e[0], e[0], e[1], e[2]]), 3)
    assert len(picked) == 3 and {3, 4} <= set(picked)
    with pytest.raises(ValueError):
        identity.farthest_points(e, 0)


def test_tracker():
    v, t = np.array([1.0, 0.0]), Tracker()
    for i in range(6):
        t.frame(i * 0.5, [((float(i), 0.0, 50.0, 50.0), v)])
    (one,) = t.finished()
    assert one["n"] == 6 and one["t1"] - one["t0"] == 2.5
    t = Tracker()
    for ts in (0.0, 1.5, 3.01):  # a gap of exactly 1.5 goes on
        t.frame(ts, [((0.0, 0.0, 50.0, 50.0), v)])
    assert [x["n"] for x in t.finished()] == [2, 1]


def test_equal_times_and_zero_means(spark):
    rows = [("v", 0.0, k, 0, 0.0, 0.0, 50.0, 50.0, [1.0, 0.0]) for k in (0, 1)] + [("v", 9.0, 0, 0, 0.0, 0.0, 50.0, 50.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "video string, ts double, frame int, det_idx int, x double, y double, width double, height double, embedding array<double>")
    got = [(r["track_id"], r["n_obs"], r["t0"], r["duration"]) for r in tracking.track(df).orderBy("track_id").collect()]
    assert got == [(0, 2, 0.0, 0.0), (1, 1, 9.0, 0.0)]  # two frames of one time are one after the other; a gap is a new piece
    both = [("v", 0.5 * k, 0, 0, 0.0, 0.0, 50.0, 50.0, [0.0, 0.0]) for k in (0, 1)]
    with pytest.raises(Exception, match="zero"):
        tracking.track(spark.createDataFrame(both, df.schema)).collect()


def test_pieces_at_gaps_are_one_run(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0.0
    for _ in range(120):
        at += float(rng.choice([0.5, 0.5, 1.0, 1.5, 1.6, 3.0]))
        for d in range(int(rng.integers(0, 3))):
            v = rng.normal(size=3)
            rows.append(("v", at, d, float(rng.integers(0, 40)), 0.0, 50.0, 50.0, (v / np.linalg.norm(v)).tolist()))
    own = Tracker()
    for ts in sorted({r[1] for r in rows}):
        own.frame(ts, [(tuple(r[3:7]), np.array(r[7])) for r in rows if r[1] == ts])
    want = [(t["id"], t["n"], t["t0"], t["t1"]) for t in own.finished()]
    df = spark.createDataFrame(rows, "video string, ts double, det_idx int, x double, y double, width double, height double, embedding array<double>")
    assert [(r["track_id"], r["n_obs"], r["t0"], r["t1"]) for r in tracking.track(df).orderBy("track_id").collect()] == want


def test_rotations():
    assert slots.rotation_steps(512) == [256, 128, 64, 32, 16, 8, 4, 2, 1] and slots.rotation_steps(1) == []
    with pytest.raises(ValueError):
        slots.rotation_steps(12)


def test_slots(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(3)], "g int, idx int, v array<double>")
    p = slots.pack(df, "g", 2, 4)
    r = p.select("slots", slots.scores(p, F.array(F.lit(2.0), F.lit(1.0)), 2, 4).alias("s")).first()
    assert r["s"] == [1.0, 3.0, 5.0] and len(r["slots"]) == 8
    with pytest.raises(Exception, match="fit"):
        slots.pack(df, "g", 2, 2).collect()


def test_protocol(spark):
    bad = spark.createDataFrame([(0, "a\t1\t4\tb\t9\t9")], "line_no int, value string")
    with pytest.raises(Exception, match="malformed"):
        protocol.parse_pairs(bad).collect()
    odd = spark.createDataFrame([(0, "a\t1\tx")], "line_no int, value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        protocol.parse_pairs(odd).collect()
    long_ = spark.createDataFrame([(3, "b\t1\t12345"), (1, "9 9"), (2, "a 1 c 2")], "line_no int, value string")
    got = [tuple(r) for r in protocol.parse_pairs(long_).orderBy("pair_idx").collect()]
    assert got == [(0, "a/a_0001.jpg", "c/c_0002.jpg", False), (1, "b/b_0001.jpg", "b/b_12345.jpg", True)]
    sums = spark.createDataFrame([("123456789",), ("",), ("x" * 300,), ("é",)], "v string").select(protocol.cksum(F.col("v"))).collect()
    assert [r[0] for r in sums[:2]] == [930766865, 4294967295]

    def plain(raw):
        crc = 0
        n = len(raw)
        for b in raw + n.to_bytes((n.bit_length() + 7) // 8, "little"):
            for k in range(7, -1, -1):
                crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31 ^ b >> k) & 1 else 0)) & 0xFFFFFFFF
        return 0xFFFFFFFF - crc

    assert [r[0] for r in sums] == [plain(v.encode()) for v in ("123456789", "", "x" * 300, "é")]
    names = spark.createDataFrame([("a_b_0001.mp4",), ("a_b",), ("a_b_c.avi",), ("__x",)], "v string")
    assert [r[0] for r in names.select(protocol.target_of(F.col("v"))).collect()] == ["a", None, "a", None]


def test_store(spark):
    a = spark.createDataFrame([("u", 1)], "id string, created_at int")
    with pytest.raises(ValueError, match="duplicate"):
        store.insert(a, a, "id")
    for name, schema in store.SCHEMAS.items():
        if name == "enrolment_audit":
            store.check_audit(spark.createDataFrame([], schema).schema)
    assert "secret" not in " ".join(store.SCHEMAS.values())
    with pytest.raises(Exception, match="unknown enrolment outcome"):
        store.checked_outcome(spark.createDataFrame([("odd",)], "outcome string")).collect()


def test_geometry(spark):
    box = lambda x, y, w, h: F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x", x), ("y", y), ("width", w), ("height", h))])
    r = spark.range(1).select(geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("i"), geometry.crop(box(-5, -5, 20, 20), F.lit(10), F.lit(10)).alias("c")).first()
    assert abs(r["i"] - 1 / 3) < 1e-12 and tuple(r["c"]) == (0, 0, 10, 10)
    # each figure is cut by itself: a box that begins outside keeps its width
    crops = spark.range(1).select(geometry.crop(box(-5, 1.6, 8, 2.6), F.lit(10), F.lit(10)).alias("a"), geometry.crop(box(6, 6, 20, 20), F.lit(10), F.lit(10)).alias("b")).first()
    assert tuple(crops["a"]) == (0, 1, 8, 3) and tuple(crops["b"]) == (6, 6, 10, 10)
    with pytest.raises(Exception, match="outside the image"):
        spark.range(1).select(geometry.crop(box(12, 0, 5, 5), F.lit(10), F.lit(10))).collect()


def test_quality_reasons(spark):
    rows = [(59.0, 80.0, 0.0, 30.0, 0.0, 90.0), (80.0, 90.0, 0.0, 30.0, 20.0, 90.0), (80.0, 90.0, 0.0, 0.5, 0.0, 90.0), (80.0, 90.0, 0.0, 30.0, 5.0, 12.34), (60.0, 60.0, 0.0, 40.0, 14.0, 40.0)]
    df = spark.createDataFrame(rows, "w double, h double, lx double, rx double, ry double, s double")
    point = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    v = geometry.assess(F.struct(F.col("w").alias("width"), F.col("h").alias("height")), point("lx", F.lit(0.0)), point("rx", F.col("ry")), F.col("s"))
    got = [tuple(r[0]) for r in df.select(v).collect()]
    assert got[0] == (False, None, "face too small: 59x80, minimum is 60")
    assert got[1] == (False, None, "extreme pose or roll: eye tilt ratio 0.67")
    assert not got[2][0] and got[2][2].startswith("extreme pose")
    assert got[3] == (False, None, "too blurry: sharpness 12.3 below 40.0")
    assert got[4] == (True, 40.0, None)


def test_similarity_is_the_least_squares_one(spark):
    rng = np.random.default_rng(4)
    target = np.array(geometry.TEMPLATE)
    for _ in range(3):
        angle, scale = rng.uniform(-3, 3), rng.uniform(0.3, 4)
        turn = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        points = target @ turn.T + rng.uniform(-50, 50, 2) + rng.normal(0, 0.5, (5, 2))
        a, b = points - points.mean(0), target - target.mean(0)
        u, d, vt = np.linalg.svd(b.T @ a / 5)
        sign = np.diag([1, np.sign(np.linalg.det(u @ vt))])
        own = u @ sign @ vt * (d @ np.diag(sign)) / a.var(0).sum()
        want = np.column_stack([own, target.mean(0) - own @ points.mean(0)])
        got = spark.range(1).select(geometry.similarity(F.array(*[F.lit(float(x)) for x in points.ravel()]))).first()[0]
        assert np.allclose(np.array(got).reshape(2, 3), want)
    with pytest.raises(Exception, match="one place"):
        spark.range(1).select(geometry.similarity(F.array(*[F.lit(1.0)] * 10))).collect()


def test_rates_that_end_in_a_half(spark, tmp_path):
    """Prices whose rate lies at half a millionth, against the query's own SQL; a run of no time."""
    prices = [133921.81, 248596.12, 352524.17, 448000.0, 64000.0, 1.0, 0.01]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "sf/orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/sf/orders.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["timed_costs"]).fetchall())
    assert sorted(map(tuple, queries.timed_costs(spark, str(tmp_path / "sf")).collect())) == want
    m = spark.range(1).select(vectors.measurement(F.lit(0), F.lit(7)).alias("m")).first()["m"]
    assert m["per_second"] == float("inf")
    halves = spark.createDataFrame([(i, s * (k + 0.5) / 1e6) for i, (s, k) in enumerate((s, k) for s in (1, -1) for k in range(2000))], "i long, x double")
    con.register("h", halves.toPandas())
    assert sorted(map(tuple, queries.rounded(halves, "x").collect())) == sorted(con.execute("SELECT i, round(x, 6) FROM h").fetchall())


def test_similarities_at_half_a_thousandth(spark, tmp_path):
    """Sets of which the lowest similarity lies at or just below a half, against the query's own SQL."""
    rows = []
    for k in range(-990, 174):
        for j, c in enumerate((k / 1000 + 0.0005, k / 1000 + 0.0005 - 3e-7)):
            base = ((k + 990) * 2 + j) * 6
            rows += [(base + i, [float(x) for x in v], 0) for i, v in enumerate(((1, 0), (1, 0), (c, (1 - c * c) ** 0.5)))]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "sf/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/sf/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["enrolment_decision"]).fetchall())
    assert len(want) == 2328 and sorted(map(tuple, queries.enrolment_decision(spark, str(tmp_path / "sf")).collect())) == want
