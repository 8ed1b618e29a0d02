"""Protocol files, score cells and deterministic splits."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import positions

_EDGES = " \t\r\n"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGES))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file in its order, an unterminated last line too; protocol files are small."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return rows.select("line_no", F.regexp_replace("value", "\r$", "").alias("value"))


def image_path(name: Column, index: Column) -> Column:
    """name/name_0001.jpg: at least four digits; an index that is no number raises."""
    return F.concat(name, F.lit("/"), name, F.format_string("_%04d.jpg", index.cast("int")))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """(pair_idx, image_a, image_b, same) of lines (line_no, value): 3 fields genuine, 4 impostor, 2 a header; others raise."""
    f = F.split(trimmed(F.col("value")), r"\s+")
    own = lines.where(trimmed(F.col("value")) != "").select("line_no", f.alias("f")).where(F.size("f") != 2)
    bad = F.raise_error(F.concat(F.lit("malformed pair line: "), F.array_join("f", " "))).cast("string")
    image = lambda name, i: image_path(F.get("f", F.lit(name)), F.get("f", F.lit(i)))
    a = F.when(F.size("f").isin(3, 4), image(0, 1)).otherwise(bad)
    b = F.when(F.size("f") == 3, image(0, 2)).when(F.size("f") == 4, image(2, 3)).otherwise(bad)
    rows = own.select("line_no", a.alias("image_a"), b.alias("image_b"), (F.size("f") == 3).alias("same"))
    return positions(rows, "line_no").select(F.col("pos").cast("long").alias("pair_idx"), "image_a", "image_b", "same")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length) of the files under a folder with one of these endings, in any case; none where there is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return spark.createDataFrame([], "path string, length long")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    pattern = "\\.(" + "|".join(e.lstrip(".").lower() for e in extensions) + ")$"
    return every.where(F.lower("path").rlike(pattern))


def discover(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(gallery, fakes), each (identity, path): of the folders root/<identity>/gallery and /fake, where both have files.  A missing root raises."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(root)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(root)
    return paired(list_files(spark, root, ("jpg", "jpeg", "png")), list_files(spark, root, ("mp4", "avi", "mov")))


def paired(images: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gallery, fakes) of listings (path), for identities that are in both."""
    part = lambda df, folder: df.select(F.regexp_extract("path", f"([^/]+)/{folder}/[^/]+$", 1).alias("identity"), "path").where("identity <> ''")
    gallery, fakes = part(images, "gallery"), part(videos, "fake")
    return gallery.join(fakes, "identity", "left_semi"), fakes.join(gallery, "identity", "left_semi")


def split_list(lines: DataFrame) -> DataFrame:
    """(kind, name) of lines `label path`: fake for Celeb-synthesis/, real for Celeb-real/; others are left out."""
    path = F.regexp_extract("value", "^\\S+\\s+(.*)$", 1)
    kind = F.when(path.startswith("Celeb-synthesis/"), "fake").when(path.startswith("Celeb-real/"), "real")
    return lines.select(kind.alias("kind"), F.regexp_extract(path, "([^/]+)$", 1).alias("name")).where("kind is not null")


def prepared(fakes: DataFrame, reals: DataFrame, listed: DataFrame, split: str = "test", seed: str = "20260818", sample: int = 500, videos: int = 4) -> tuple[DataFrame, DataFrame]:
    """(probes, gallery), each (identity, name): a split's fakes by the identity they show, and its real videos outside the test list.

    test: the listed fakes; dev: those not listed, the first `sample` by hash
    (0: all).  Of each identity the first `videos` real ones by name.
    """
    if split not in ("test", "dev"):
        raise ValueError("the split is test or dev")
    tested = listed.where("kind = 'fake'").select("name")
    chosen = tested if split == "test" else fakes.select("name").join(tested, "name", "left_anti")
    if split == "dev" and sample > 0:
        chosen = deterministic_sample(chosen, seed, sample).select("name")
    probes = chosen.select(impersonated(F.col("name")).alias("identity"), "name")
    left = reals.select("name").join(listed.where("kind = 'real'").select("name"), "name", "left_anti")
    left = left.select(F.split_part("name", F.lit("_"), F.lit(1)).alias("identity"), "name").join(probes.select("identity"), "identity", "left_semi")
    return probes, first_per(left, "identity", "name", videos)


def prepared_counts(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """(fakes, identities, gallery, without): one row; without: identities that have no gallery."""
    a = probes.agg(F.count(F.lit(1)).alias("fakes"), F.countDistinct("identity").alias("identities"))
    b = gallery.agg(F.count(F.lit(1)).alias("gallery"))
    c = probes.select("identity").distinct().join(gallery, "identity", "left_anti").agg(F.count(F.lit(1)).alias("without"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def cached_scores(spark: SparkSession, path: str, reuse: bool, make) -> DataFrame:
    """The scores at `path` where they may be reused and are there; else those that `make` gives, written there if there are any."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    if reuse and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(path)
    scores = make()
    if not scores.limit(1).count():
        return scores
    scores.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def asset(name: str, root: str = "assets") -> tuple[str, bool]:
    """(path, whether it is there) of a file: as the environment variable KINVEC_<NAME> says, else in the root folder."""
    path = os.environ.get("KINVEC_" + "".join(c if c.isalnum() else "_" for c in name).upper(), os.path.join(root, name))
    return path, os.path.exists(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """(probe_id, value): identity, video and gallery=score cells in gallery order, tab-separated."""
    cell = F.concat("gallery_id", F.lit("="), F.col("score").cast("string"))
    each = scores.groupBy("probe_id", "identity", "video").agg(F.array_sort(F.collect_list(F.struct("gallery_pos", cell.alias("cell")))).alias("cells"))
    return each.select("probe_id", F.concat_ws("\t", "identity", "video", F.transform("cells", lambda c: c["cell"])).alias("value"))


def read_score_lines(lines: DataFrame) -> DataFrame:
    """The rows back; blank lines are skipped, a cell is split at its last `=`, fewer than three fields raise."""
    f = F.split("value", "\t")
    own = lines.where(trimmed(F.col("value")) != "").select("probe_id", F.when(F.size(f) >= 3, f).otherwise(F.raise_error(F.lit("a score line needs three fields")).cast("array<string>")).alias("f"))
    cells = own.select("probe_id", F.get("f", F.lit(0)).alias("identity"), F.get("f", F.lit(1)).alias("video"), F.posexplode(F.slice("f", 3, F.size("f"))).alias("gallery_pos", "cell"))
    part = lambda n: F.regexp_extract("cell", "^(.+)=([^=]*)$", n)
    return cells.select("probe_id", "identity", "video", "gallery_pos", part(1).alias("gallery_id"), part(2).cast("double").alias("score"))


def target_of(video: Column) -> Column:
    """The first of exactly three parts of a name; null otherwise."""
    return F.nullif(F.regexp_extract(video, "^([^_]*)_([^_]*)_([^_]+?)(?:[.]mp4)?$", 1), F.lit(""))


def impersonated(video: Column) -> Column:
    return F.split_part(video, F.lit("_"), F.lit(2))


def _crc_table() -> list[int]:
    """The 256 remainders of the polynomial 0x04C11DB7, high bit first."""
    out = []
    for c in range(256):
        r = c << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


def cksum(text: Column) -> Column:
    """The POSIX checksum of a text's UTF-8 bytes: they and then their number's, low one first."""
    raw, n = F.hex(F.encode(text, "UTF-8")), F.octet_length(text)
    byte = lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    own = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), byte)).otherwise(F.array().cast("array<bigint>"))
    size = F.array_compact(F.array(*[F.when(n >= 256**k, F.pmod(F.floor(n / 256**k), F.lit(256)).cast("long")) for k in range(4)]))
    table = F.array(*[F.lit(x) for x in _crc_table()])
    top = lambda crc: F.shiftrightunsigned(crc, 24)
    mixed = lambda crc, b: (crc.bitwiseAND(F.lit(0xFFFFFF)) * 256).bitwiseXOR(F.get(table, top(crc).bitwiseXOR(b).cast("int")))
    return F.aggregate(F.concat(own, size), F.lit(0).cast("long"), mixed, lambda crc: F.lit(0xFFFFFFFF) - crc)


def deterministic_sample(names: DataFrame, seed: str, n: int) -> DataFrame:
    """The n names first by checksum of seed:name."""
    return names.select("name", cksum(F.concat(F.lit(f"{seed}:"), "name")).alias("key")).orderBy("key", "name").limit(n)


def first_per(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")
