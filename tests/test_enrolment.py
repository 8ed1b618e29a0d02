"""Vault, store, pictures, enrolment and streaming, on small cases."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinvec.functions import geometry, images
from kinvec.operators import enrolment, identity, models
from kinvec.sources import protocol
from kinvec.sources.store import Conflict, Store, jdbc_options
from kinvec.sources.vault import Vault
from kinvec.streaming import tracks as streams

NOW = "2026-01-01 00:00:00"


def test_vault(spark, tmp_path):
    folder = str(tmp_path / "vault")
    with Vault(spark, folder) as v:
        plain = bytearray(b"abcd")
        path = v.store("one.png", plain)
        assert plain == bytes(4) and os.path.getsize(path) == 12 + 4 + 16 and b"abcd" not in open(path, "rb").read()
        v.store("two", b"x" * 1000)
        assert v.read("one.png") == b"abcd" and v.read("two") == b"x" * 1000 and v.names() == ["one.png", "two"]
        assert open(v.store("one.png", b"abcd"), "rb").read() != open(v.store("other", b"abcd"), "rb").read()
        for name in ("../x", "a/b", "", "..", "a b"):
            with pytest.raises(ValueError, match="not a name"):
                v.store(name, b"x")
        with Vault(spark, str(tmp_path / "second")) as other:
            os.replace(path, other.path_for("one.png"))
            with pytest.raises(ValueError, match="decrypted"):
                other.read("one.png")
            open(other.path_for("short"), "wb").write(b"123")
            with pytest.raises(ValueError, match="cut short"):
                other.read("short")
    assert not os.path.exists(folder)
    v.shred()
    with pytest.raises(RuntimeError, match="shredded"):
        v.read("two")
    with pytest.raises(RuntimeError, match="shredded"):
        v.store("two", b"")
    with pytest.raises(ZeroDivisionError), Vault(spark, folder) as v:
        v.store("x", b"x")
        1 / 0  # noqa: B018
    assert not os.path.exists(folder)


def users(spark, *ids):
    return spark.createDataFrame([(i, i.upper()) for i in ids], "id string, display_name string").withColumn("enrolled_at", F.lit(NOW).cast("timestamp"))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.migrate() == 1 and store.migrate() == 1
    store.insert_users(users(spark, "u", "w"))
    with pytest.raises(ValueError, match="duplicate"):
        store.insert_users(users(spark, "u"))
    keys = lambda *rows: spark.createDataFrame(rows, "user_id string, public_key binary, galois_keys binary").withColumn("created_at", F.current_timestamp())
    store.put_keys(keys(("u", b"p1", b"g1")))
    first = store.table("key_material").first()["created_at"]
    store.put_keys(keys(("u", b"p2", b"g2")))
    assert store.get_keys("u").collect() == [(b"p2", b"g2")] and store.get_keys("x").collect() == []
    assert store.table("key_material").first()["created_at"] == first
    with pytest.raises(Exception, match="unknown user"):
        store.put_keys(keys(("x", b"p", b"g")))
    gallery = lambda u, c, n: spark.createDataFrame([(u, c, n)], "user_id string, ciphertext binary, vector_count int").withColumn("created_at", F.current_timestamp())
    store.put_galleries(gallery("u", b"c", 3))
    assert store.get_gallery("u").collect() == [(b"c", 3)]
    for bad in (("u", b"", 3), ("u", b"c", 0), ("u", b"c", 17)):
        with pytest.raises(Exception, match="vector_count"):
            store.put_galleries(gallery(*bad))
    audit = lambda *rows: spark.createDataFrame(rows, "user_id string, photos_offered int, photos_usable int, outcome string, reason string").withColumn("occurred_at", F.current_timestamp())
    store.record(audit(("u", 3, 3, "Accepted", None)))
    store.record(audit(("u", 2, 1, "RejectedTooFewPhotos", "few"), ("w", 5, 4, "RejectedMixedIdentity", "two")))
    assert [(r["outcome"], r["reason"]) for r in store.for_user("u").collect()] == [("Accepted", None), ("RejectedTooFewPhotos", "few")]
    with pytest.raises(Exception, match="unknown enrolment outcome"):
        store.record(audit(("u", 1, 1, "accepted", None)))
    with pytest.raises(ValueError, match="may not hold"):
        store.record(audit(("u", 1, 1, "Accepted", None)).withColumn("v", F.array(F.lit(1.0))))
    # all or nothing
    with pytest.raises(Exception, match="vector_count"), store.transaction():
        store.insert_users(users(spark, "z"))
        store.put_galleries(gallery("z", b"c", 99))
    assert store.table("enrolled_user").where("id = 'z'").count() == 0
    other = Store(spark, store.path)
    with pytest.raises(Conflict), store.transaction():
        store.insert_users(users(spark, "z"))
        other.insert_users(users(spark, "y"))
    assert {r["id"] for r in store.table("enrolled_user").collect()} == {"u", "w", "y"}
    store.delete_users(users(spark, "u"))
    assert store.get_keys("u").count() == store.get_gallery("u").count() == store.for_user("u").count() == 0 and store.for_user("w").count() == 1
    assert jdbc_options("jdbc:postgresql://h/d", "a", "b")["numPartitions"] == "4"
    with pytest.raises(ValueError):
        jdbc_options("h/d", "a", "b")


def png(x: np.ndarray, rule: int) -> bytes:
    """A PNG of x (blue, green, red), every line by one filter."""
    own = x[:, :, ::-1].astype(np.int64)
    h, w, _ = own.shape
    p = np.zeros((h + 1, w + 1, 3), np.int64)
    p[1:, 1:] = own
    a, b, c = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    q = a + b - c
    da, db, dc = abs(q - a), abs(q - b), abs(q - c)
    guess = [0 * a, a, b, (a + b) // 2, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))][rule]
    lines = np.concatenate([np.full((h, 1), rule), ((own - guess) % 256).reshape(h, -1)], axis=1).astype(np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def ppm(x: np.ndarray) -> bytes:
    return f"P6\n# a picture\n{x.shape[1]} {x.shape[0]}\n255\n".encode() + np.ascontiguousarray(x[:, :, ::-1]).tobytes()


def bmp(x: np.ndarray) -> bytes:
    h, w, _ = x.shape
    pad = -w * 3 % 4
    body = b"".join(line.tobytes() + bytes(pad) for line in x[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def picture(seed: int, h: int = 90, w: int = 83) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_pictures(spark, tmp_path):
    x = picture(1)
    for raw in (*[png(x, r) for r in range(5)], ppm(x), bmp(x)):
        assert (images.decode(raw) == x).all()
    for bad in (b"", b"none", png(x, 0)[:200], ppm(x)[:50], b"\xff\xd8\xff"):
        with pytest.raises(ValueError, match="decoded"):
            images.decode(bad)
    g = images.grey(x)
    padded = np.pad(g, 1, mode="reflect")
    want = [padded[i, j + 1] + padded[i + 2, j + 1] + padded[i + 1, j] + padded[i + 1, j + 2] - 4 * g[i, j] for i in range(90) for j in range(83)]
    assert abs(images.sharpness(x) - np.var(want)) < 1e-6 and images.sharpness(np.full((9, 9, 3), 7, np.uint8)) == 0
    assert (images.warped(x, [1, 0, 0, 0, 1, 0], 80) == x[:80, :80]).all()
    assert (images.warped(x, [1, 0, 5, 0, 1, 3], 60)[3:, 5:] == x[:57, :55]).all()
    (tmp_path / "a.png").write_bytes(png(x, 4))
    r = images.read(spark, str(tmp_path)).select("picture.*", images.sharpness_of(F.col("picture"), F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(83).alias("x1"), F.lit(90).alias("y1"))).alias("s")).first()
    assert (r["width"], r["height"]) == (83, 90) and abs(r["s"] - images.sharpness(x)) < 1e-6
    with pytest.raises(Exception):
        images.read(spark, str(tmp_path / "none")).collect()


def plugs():
    """A detector of one face that fills the picture, with a worse one over it, and an embedder; made here so that they travel by value."""

    template = geometry.TEMPLATE

    def detector():
        def find(p):
            h, w = p.shape[:2]
            points = [x * w / 112 for point in template for x in point]  # the whole of a square picture
            return [(0, 0, w, h, 0.9, *points), (1, 1, w, h, 0.5, *points)] if p.any() else []

        return find

    def embedder():
        return lambda face: face.reshape(8, 14, 8, 14, 3).mean(axis=(1, 3)).ravel()[:64] - 127.5

    return detector, embedder


def test_enrolment(spark, tmp_path):
    detector, embedder = plugs()
    base = picture(3, 100, 100)
    shots = {f"p{i}": base if i < 4 else 255 - base for i in range(6)}
    rows = [(k, png(v, 2)) for k, v in shots.items()] + [("blank", ppm(np.zeros((70, 70, 3), np.uint8))), ("small", ppm(picture(5, 40, 40))), ("grey", ppm(np.full((90, 90, 3), 99, np.uint8)))]
    pictures = spark.createDataFrame(rows, "image_id string, content binary").select("image_id", images.decoded(F.col("content")).alias("picture"))
    faces = models.detect_and_embed(pictures, detector, embedder)
    assert faces.count() == 8  # one a picture, none of the blank one
    good = enrolment.usable(faces, pictures).persist()
    assert {r["image_id"] for r in good.collect()} == set(shots)
    photographs = spark.createDataFrame([("u", p) for p in ("p0", "p1", "p2", "blank", "small")] + [("w", "p0"), ("w", "p1"), ("w", "p4"), ("x", "p3"), ("x", "grey"), ("y", "blank")], "user_id string, image_id string")
    store = Store(spark, str(tmp_path / "store"))
    store.migrate()
    keys = spark.createDataFrame([(i, b"p", b"g") for i in "uwxy"], "user_id string, public_key binary, galois_keys binary")
    seal = lambda slots: F.aes_encrypt(F.to_json(slots).cast("binary"), F.lit("0123456789abcdef"))
    enrolment.enrol_and_store(store, users(spark, *"uwxy"), photographs, good, keys, seal, 64)
    got = {r["user_id"]: (r["photos_offered"], r["photos_usable"], r["outcome"], r["reason"]) for r in store.table("enrolment_audit").collect()}
    assert got["u"] == (5, 3, "Accepted", None)
    assert got["w"][:3] == (3, 3, "RejectedMixedIdentity") and "(lowest similarity -" in got["w"][3]
    assert got["x"] == (2, 1, "RejectedTooFewPhotos", "1 usable photographs, at least 3 required")
    assert got["y"] == (1, 0, "RejectedTooFewPhotos", "0 usable photographs, at least 3 required")
    assert {r["user_id"] for r in store.table("key_material").collect()} == {"u"} == {r["user_id"] for r in store.table("encrypted_gallery").collect()}
    assert store.get_gallery("u").first()["vector_count"] == 3 and set(identity.OUTCOMES) >= {x[2] for x in got.values()}
    pairs = spark.createDataFrame([("p0", "p1", True), ("p0", "p4", False), ("p0", "blank", False)], "image_a string, image_b string, same boolean")
    score = {r["image_b"]: r["score"] for r in enrolment.pictures_trial(pairs, pictures, detector, embedder).collect()}
    assert abs(score["p1"] - 1) < 1e-9 and score["p4"] < 0 and score["blank"] is None


def test_models():
    with pytest.raises(FileNotFoundError, match="missing"):
        models.OnnxModel("/nowhere/model.onnx")


def test_files(spark, tmp_path, monkeypatch):
    for name in ("a/gallery/1.JPG", "a/gallery/2.png", "a/gallery/3.txt", "a/fake/x.mp4", "b/gallery/1.jpg", "c/fake/1.avi"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    gallery, fakes = protocol.discover(spark, str(tmp_path))
    assert [r["identity"] for r in gallery.collect()] == ["a", "a"] and [r["identity"] for r in fakes.collect()] == ["a"]
    assert protocol.list_files(spark, str(tmp_path / "a/gallery/1.JPG"), ("jpg",)).count() == 0
    assert protocol.list_files(spark, str(tmp_path / "none"), ("jpg",)).count() == 0
    with pytest.raises(FileNotFoundError):
        protocol.discover(spark, str(tmp_path / "none"))
    (tmp_path / "list.txt").write_text("1 Celeb-synthesis/id1_id2_0001.mp4\r\n1 YouTube-real/x.mp4\n0 Celeb-real/id2_0003.mp4")
    listed = protocol.split_list(protocol.read_lines(spark, str(tmp_path / "list.txt")))
    assert [tuple(r) for r in listed.collect()] == [("fake", "id1_id2_0001.mp4"), ("real", "id2_0003.mp4")]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    fakes, reals = names("id1_id2_0001.mp4", "id3_id2_0002.mp4", "id1_id4_0003.mp4"), names(*[f"id2_{k:04}.mp4" for k in range(1, 8)], "id9_0001.mp4")
    probes, gallery = protocol.prepared(fakes, reals, listed)
    assert [tuple(r) for r in probes.collect()] == [("id2", "id1_id2_0001.mp4")]
    assert sorted(r["name"] for r in gallery.collect()) == [f"id2_000{k}.mp4" for k in (1, 2, 4, 5)]
    probes, gallery = protocol.prepared(fakes, reals, listed, "dev", sample=0)
    assert {r["name"] for r in probes.collect()} == {"id3_id2_0002.mp4", "id1_id4_0003.mp4"}
    assert tuple(protocol.prepared_counts(probes, gallery).first()) == (2, 2, 4, 1)
    with pytest.raises(ValueError):
        protocol.prepared(fakes, reals, listed, "train")
    cache, made = str(tmp_path / "scores"), []
    make = lambda: made.append(1) or spark.range(3)
    for reuse in (False, True, True, False):
        assert protocol.cached_scores(spark, cache, reuse, make).count() == 3
    assert len(made) == 2
    monkeypatch.setenv("KINVEC_MODEL_ONNX", str(tmp_path / "list.txt"))
    assert protocol.asset("model.onnx") == (str(tmp_path / "list.txt"), True) and protocol.asset("other", "r") == ("r/other", False)


def test_streaming_tracks_are_the_batch_ones(spark, tmp_path):
    rows = []
    for k, at in enumerate([0.0, 0.5, 1.0, 5.0, 5.5, 9.0, 30.0]):
        rows.append(("v", 1_700_000_000 + at, 0, float(k), 0.0, 50.0, 50.0, [1.0, 0.0]))
        rows.append(("v", 1_700_000_000 + at, 1, 200.0, 0.0, 50.0, 50.0, [0.0, 1.0]))
    df = spark.createDataFrame(rows, "video string, at double, det_idx int, x double, y double, width double, height double, embedding array<double>").withColumn("at", F.timestamp_millis((F.col("at") * 1000).cast("long")))
    source = str(tmp_path / "in")
    for lo, hi in ((0, 6), (6, 10), (10, 12), (12, 14)):
        part = spark.createDataFrame(df.collect()[lo:hi], df.schema).coalesce(1)
        part.write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streams.tracks(stream, "1 second").writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(240)
    got = sorted((r["n_obs"], round(r["duration"], 3)) for r in spark.table("tracked").collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.5), (2, 0.5), (3, 1.0), (3, 1.0)]  # those in sight at the end stay open
    frames = spark.readStream.schema(df.schema).parquet(source).where("det_idx = 0").withColumn("frame", F.col("x"))
    query = streams.sampled(frames, "1 second", "1 second").writeStream.format("memory").queryName("sampled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check2")).start()
    query.awaitTermination(240)
    assert sorted(r["frame"] for r in spark.table("sampled").collect()) == [0.0, 2.0, 3.0, 5.0]


def test_command_line(spark, tmp_path):
    from kinvec.__main__ import main

    unit = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    vectors = spark.createDataFrame([("a/a_0001.jpg", unit(0)), ("a/a_0002.jpg", [0.8, 0.6, 0.0, 0.0]), ("b/b_0001.jpg", unit(1))], "id string, v array<double>")
    vectors.write.parquet(str(tmp_path / "v"))
    (tmp_path / "pairs.txt").write_text("10\t300\na\t1\t2\na\t1\tb\t1\na\t1\tc\t1\n")
    spark.createDataFrame([("b_a_0001.mp4", "a", unit(0)), ("a_b_0001.mp4", "b", unit(1)), ("a_b_0002.mp4", "b", None)], "probe_id string, own string, v array<double>").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("a", unit(0)), ("b", unit(1))], "gallery_id string, v array<double>").write.parquet(str(tmp_path / "g"))
    args = ["all", "--pairs", str(tmp_path / "pairs.txt"), "--embeddings", str(tmp_path / "v"), "--probes", str(tmp_path / "p"), "--gallery", str(tmp_path / "g"), "--scores", str(tmp_path / "s"), "--reuse"]
    text = main(args, spark)
    assert text == main(args, spark) and (tmp_path / "s").exists()
    assert "skipped" in text and "probes          : 3" in text and "known targets" in text
    with pytest.raises(SystemExit):
        main(["verify"], spark)
    assert main(["bench", "--users", "20"], spark).count(" ms, ") == 3

