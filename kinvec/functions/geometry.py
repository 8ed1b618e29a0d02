"""Boxes, landmarks, alignment and face choice as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SIZE, MAX_TILT, MIN_SHARPNESS = 60.0, 0.35, 40.0


#: Where the five points of a face lie in an aligned picture of 112 pixels (right eye, left eye, nose, right and left corner of the mouth).
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
POINTS = ("right_eye", "left_eye", "nose", "right_mouth", "left_mouth")


def right(box: Column) -> Column:
    return box["x"] + box["width"]


def bottom(box: Column) -> Column:
    return box["y"] + box["height"]


def area(box: Column) -> Column:
    return box["width"] * box["height"]


def landmark_array(marks: Column) -> Column:
    """The five points of a struct, in the template's order, as x, y, x, y, ..."""
    return F.array(*[marks[p][axis].cast("double") for p in POINTS for axis in ("x", "y")])


def similarity(points: Column, template: tuple[tuple[float, float], ...] = TEMPLATE) -> Column:
    """The turn, scale and shift that bring points (x, y, x, y, ...) nearest the template, as a 2 x 3 matrix by rows.

    Least squares without mirroring.  In two dimensions the best turn and scale
    are one complex number: the covariance of the points with the template over
    the points' variance.  Points that all fall together raise.
    """
    n = len(template)
    tx, ty = sum(x for x, _ in template) / n, sum(y for _, y in template) / n
    xs, ys = [F.get(points, F.lit(2 * i)) for i in range(n)], [F.get(points, F.lit(2 * i + 1)) for i in range(n)]
    mx, my = sum(xs[1:], xs[0]) / n, sum(ys[1:], ys[0]) / n
    var, re, im = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x, y, (u, v) in zip(xs, ys, template, strict=True):
        dx, dy = x - mx, y - my
        var = var + dx * dx + dy * dy
        re = re + dx * (u - tx) + dy * (v - ty)
        im = im + dx * (v - ty) - dy * (u - tx)
    a, b = re / var, im / var
    out = F.array(a, -b, F.lit(tx) - (a * mx - b * my), b, a, F.lit(ty) - (b * mx + a * my))
    return F.when(var > 1e-12, out).otherwise(F.raise_error(F.lit("the points are all in one place")).cast("array<double>"))


def suppressed(detections: DataFrame, image: str = "image_id", overlap: float = 0.3, top: int = 50) -> DataFrame:
    """The `top` detections of each image by score (ties: det_idx) without those that overlap a kept better one by more.

    An image's list is bounded by `top`, so it is folded as one array.
    """
    w = Window.partitionBy(image).orderBy(F.desc("score"), "det_idx")
    best = detections.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    one = F.struct("_r", *[F.col(c) for c in detections.columns if c != image])
    lists = best.groupBy(image).agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, d: F.when(F.exists(acc, lambda k: iou(k["box"], d["box"]) > overlap), acc).otherwise(F.concat(acc, F.array(d))))
    return lists.select(image, F.explode(kept).alias("d")).select(image, *[F.col(f"d.{c}").alias(c) for c in detections.columns if c != image])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes only touch or are apart."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    inter = w * h
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(inter / (area(a) + area(b) - inter))


def centre_most(faces: DataFrame, image: str = "image_id") -> DataFrame:
    """The face of each image whose centre is nearest the image's; the first on a tie."""
    dx = F.col("box.x") + F.col("box.width") / 2 - F.col("image_width") / 2
    dy = F.col("box.y") + F.col("box.height") / 2 - F.col("image_height") / 2
    w = Window.partitionBy(image).orderBy(dx * dx + dy * dy, "det_idx")
    return faces.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def crop(box: Column, width: Column, height: Column) -> Column:
    """The box in whole pixels (each figure cut, not rounded) within the image; an empty one raises."""
    x0, y0 = F.greatest(F.lit(0), box["x"].cast("int")), F.greatest(F.lit(0), box["y"].cast("int"))
    w, h = F.least(width - x0, box["width"].cast("int")), F.least(height - y0, box["height"].cast("int"))
    out = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))
    return F.when((w > 0) & (h > 0), out).otherwise(F.raise_error(F.lit("face box lies outside the image")).cast("struct<x0:int,y0:int,x1:int,y1:int>"))


def assess(box: Column, left_eye: Column, right_eye: Column, sharpness: Column) -> Column:
    """struct(accepted, sharpness, reason): size, then tilt, then sharpness; the first that fails, with its figures.

    sharpness only stays with what is accepted.
    """
    small = (box["width"] < MIN_SIZE) | (box["height"] < MIN_SIZE)
    dx, dy = F.abs(left_eye["x"] - right_eye["x"]), F.abs(left_eye["y"] - right_eye["y"])
    tilt = F.when(dx < 1, 1.7976931348623157e308).otherwise(dy / dx)
    fixed = lambda x, places: F.format_string(f"%.{places}f", x.cast("double"))
    too_small = F.concat(F.lit("face too small: "), fixed(box["width"], 0), F.lit("x"), fixed(box["height"], 0), F.lit(f", minimum is {MIN_SIZE:.0f}"))
    pose = F.concat(F.lit("extreme pose or roll: eye tilt ratio "), fixed(tilt, 2))
    blurred = F.concat(F.lit("too blurry: sharpness "), fixed(sharpness, 1), F.lit(f" below {MIN_SHARPNESS:.1f}"))
    reason = F.when(small, too_small).when(tilt > MAX_TILT, pose).when(sharpness < MIN_SHARPNESS, blurred)
    return F.struct(reason.isNull().alias("accepted"), F.when(reason.isNull(), sharpness).alias("sharpness"), reason.alias("reason"))
