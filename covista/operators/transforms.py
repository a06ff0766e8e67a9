"""The transform chain: each step takes the tables of a reconstruction and gives them back changed.

Tables are DataFrames by name: images (image, name, camera, qw, qx, qy, qz, tx, ty, tz), points (point, x, y, z, w, error),
observations (point, image, feature), cameras (camera, model, params map). A step has apply(tables) and description; one that
needs a certain source of observations names it in required_feature_source, which the chain checks before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covista.functions import geometry as g
from covista.functions import text

from . import aggregates, filters, kernels, neighbors, tracks
from .tables import cut

Tables = dict[str, DataFrame]
_Q, _T, _P = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"), ("x", "y", "z")
#: Columns that a reconstruction can do without, by what they hold.
THUMBNAILS, BITMAPS, READINGS = ("thumbnail",), ("patch_bitmap",), ("sharpness", "tensor", "normal_error")


class Transform(Protocol):
    def apply(self, tables: Tables) -> Tables: ...

    @property
    def description(self) -> str: ...


def apply_all(tables: Tables, steps: Sequence[Transform], feature_source: str | None = None) -> Tables:
    """The steps one after the other; a step that needs another source of observations is refused before the first runs."""
    for s in steps:
        need = getattr(s, "required_feature_source", None)
        if need is not None and need != feature_source:
            raise ValueError(f"{s.description} needs {need}, not {feature_source}")
    start = dict(tables)
    for s in steps:
        tables = s.apply_with_input(tables, start) if hasattr(s, "apply_with_input") else s.apply(tables)
    return tables


def transformed(tables: Tables, by: g.Similarity) -> Tables:
    """Points and poses of the new world; points at infinity (w = 0) are only turned, lengths of depth statistics and patches scaled."""
    points = tables["points"]
    moved = dict(zip(_P, by.apply(g.columns(*_P), F.col("w")), strict=True))
    moved |= {c: F.col(c) * by.scale for c in ("depth", "patch_size") if c in points.columns}
    turned, shifted = by.apply_pose(g.columns(*_Q), g.columns(*_T))
    poses = dict(zip((*_Q, *_T), (*turned, *shifted), strict=True))
    poses |= {c: F.col(c) * by.scale for c in ("depth_min", "depth_max", "depth_mean", "depth_median") if c in tables["images"].columns}
    return tables | {"points": points.withColumns(moved), "images": tables["images"].withColumns(poses)}


def dropped(tables: Tables, names: Sequence[str]) -> Tables:
    return {k: v.drop(*names) for k, v in tables.items()}


def kept_points(tables: Tables, points: DataFrame) -> Tables:
    """Tables with these points alone, numbered anew, and their observations."""
    new = cut(filters.renumbered(points, "point", "__new"))
    ids = new.select("point", "__new")
    seen = tables["observations"].join(ids, "point").withColumn("point", F.col("__new")).drop("__new")
    return tables | {"points": new.withColumn("point", F.col("__new")).drop("__new"), "observations": seen}


def kept_images(tables: Tables, images: DataFrame) -> Tables:
    """Tables with these images alone, numbered anew in their order, and the points that they see."""
    chosen = filters.renumbered(images.select("image"), "image", "nth")
    i, o, p = tracks.subset_by_images(tables["images"], tables["observations"], tables["points"], cut(chosen))
    return tables | {"images": i, "observations": o, "points": p.drop("changed")}


@dataclass(frozen=True)
class Step:
    """A transform made of a name and a function."""

    description: str
    run: Callable[[Tables], Tables]
    required_feature_source: str | None = None

    def apply(self, tables: Tables) -> Tables:
        return self.run(tables)


def rotate(axis: Sequence[float], angle: float) -> Step:
    """About an axis through the origin, by radians."""
    import math

    n = math.sqrt(sum(a * a for a in axis))
    if not n > 0:
        raise ValueError("an axis must have a length")
    q = (math.cos(angle / 2), *(a / n * math.sin(angle / 2) for a in axis))
    return Step(f"rotate by {math.degrees(angle):g} degrees", lambda t: transformed(t, g.Similarity(q)))


def translate(by: Sequence[float]) -> Step:
    return Step(f"translate by {tuple(by)}", lambda t: transformed(t, g.Similarity(translation=tuple(map(float, by)))))


def scale(by: float) -> Step:
    s = g.Similarity(scale=float(by))
    return Step(f"scale by {by:g}", lambda t: transformed(t, s))


def similarity(by: g.Similarity) -> Step:
    return Step("similarity", lambda t: transformed(t, by))


def _quaternion(r) -> tuple[float, float, float, float]:
    """The unit quaternion of a rotation matrix, by its largest component."""
    import numpy as np

    k = np.array([[r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0], [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]]]) / 3
    _, v = np.linalg.eigh(k)
    x, y, z, w = v[:, -1]
    return tuple(float(a) for a in (np.array([w, x, y, z]) * (1 if w >= 0 else -1)))


def alignment(source: Tables, target: Tables) -> g.Similarity:
    """The similarity that moves the source's camera centres onto those of the target's images of the same names."""
    centres = lambda t: t["images"].select("name", *[c.alias(a) for c, a in zip(g.camera_centre(g.columns(*_Q), g.columns(*_T)), "xyz", strict=True)])
    pairs = centres(source).join(centres(target).toDF("name", "u", "v", "w"), "name")
    s, r, t = kernels.similarity(pairs, _P, ("u", "v", "w"))
    return g.Similarity(_quaternion(r), tuple(map(float, t)), s)


def align_to(target: Tables) -> Step:
    return Step("align to another reconstruction", lambda t: transformed(t, alignment(t, target)))


@dataclass(frozen=True)
class AlignToInput:
    """Align with the tables that the chain began with."""

    description: str = "align to the chain's input"

    def apply(self, tables: Tables) -> Tables:
        return tables

    def apply_with_input(self, tables: Tables, start: Tables) -> Tables:
        return transformed(tables, alignment(tables, start))


def remove_short_tracks(most: int) -> Step:
    """Points with `most` observations and fewer go."""

    def run(t):
        long = t["observations"].groupBy("point").count().where(F.col("count") > most).select("point")
        return kept_points(t, t["points"].join(long, "point", "left_semi"))

    return Step(f"remove tracks of {most} and fewer", run)


def remove_narrow_tracks(least: float) -> Step:
    def run(t):
        centres = t["images"].select("image", *[c.alias(a) for c, a in zip(g.camera_centre(g.columns(*_Q), g.columns(*_T)), ("cx", "cy", "cz"), strict=True)])
        return kept_points(t, tracks.narrow_tracks_removed(t["points"], t["observations"], centres, least))

    return Step(f"remove tracks narrower than {least:g} radians", run)


def remove_isolated(factor: float, percentile: float = 0.5) -> Step:
    return Step(f"remove points isolated by {factor:g}", lambda t: kept_points(t, neighbors.isolated_filter(t["points"].withColumn("__far", F.col("w") == 0), "point", list(_P), factor, percentile, "__far").drop("__far")))


def remove_large_features(most: float, sizes: DataFrame) -> Step:
    """sizes has (image, feature, size); an observation without one counts as 0."""

    def run(t):
        o = t["observations"].join(sizes, ["image", "feature"], "left")
        return kept_points(t, t["points"].join(filters.at_most(o, "point", "size", most).select("point"), "point", "left_semi"))

    return Step(f"remove features larger than {most:g}", run, "sift_files")


def filter_by_error(most: float) -> Step:
    return Step(f"keep errors up to {most:g}", lambda t: kept_points(t, tracks.by_reading(t["points"], "error", most)))


def filter_by_reading(column: str, most: float) -> Step:
    """Points by a stored reading, such as the self-similarity radius."""
    return Step(f"keep {column} up to {most:g}", lambda t: kept_points(t, tracks.by_reading(t["points"], column, most)))


def filter_by_patch_size(times: float) -> Step:
    return Step(f"keep patches up to {times:g} times the median", lambda t: kept_points(t, tracks.by_patch_size(t["points"], "patch_u", "patch_v", times)))


def include_range(ranges: str) -> Step:
    return Step(f"include {ranges}", lambda t: kept_images(t, filters.include_range(t["images"], "name", ranges)))


def exclude_range(ranges: str) -> Step:
    return Step(f"exclude {ranges}", lambda t: kept_images(t, filters.exclude_range(t["images"], "name", ranges)))


def include_glob(pattern: str) -> Step:
    return Step(f"include {pattern}", lambda t: kept_images(t, filters.matching(t["images"], "name", pattern)))


def exclude_glob(pattern: str) -> Step:
    return Step(f"exclude {pattern}", lambda t: kept_images(t, filters.matching(t["images"], "name", pattern, keep=False)))


def select_by_distribution(count: int) -> Step:
    """`count` images whose camera centres are spread well: the first one, then again and again the one farthest from those taken.

    A pass over the images for each that is taken; only the taken centres, `count` at most, come to the driver.
    """

    def run(t):
        c = cut(t["images"].select("image", *[c.alias(a) for c, a in zip(g.camera_centre(g.columns(*_Q), g.columns(*_T)), "xyz", strict=True)]).withColumn("far", F.lit(float("inf"))))
        taken = []
        while len(taken) < count:
            if (r := c.orderBy(F.desc("far"), "image").first()) is None or r["far"] == 0:
                break
            taken.append(r["image"])
            d = g.norm([F.col(a) - F.lit(r[a]) for a in _P])
            c = c.withColumn("far", F.least("far", d))
            if len(taken) % 8 == 0:
                c = cut(c)
        return kept_images(t, t["images"].where(F.col("image").isin(taken)))

    return Step(f"select {count} images by distribution", run)


def drop_thumbnails() -> Step:
    return Step("drop thumbnails", lambda t: dropped(t, THUMBNAILS))


def drop_patch_bitmaps() -> Step:
    return Step("drop patch bitmaps", lambda t: dropped(t, BITMAPS))


def minimal() -> Step:
    return Step("minimal", lambda t: dropped(t, (*THUMBNAILS, *BITMAPS, *READINGS)))


def to_embedded(features: DataFrame) -> Step:
    """Observations that carry their keypoint and shape, joined from features (image, feature, fx, fy, shape), and no longer name a feature."""
    return Step("to embedded patches", lambda t: t | {"observations": t["observations"].join(features, ["image", "feature"]).drop("feature")}, "sift_files")


def drop_image_adjustments(parameters: Sequence[str], cameras: Sequence[int] | None = None) -> Step:
    """Per-image adjustments (images.adjust, a map by parameter) of the named parameters go; their mean over a camera's images is added to the camera."""

    def run(t):
        chosen = F.lit(True) if cameras is None else F.col("camera").isin(list(cameras))
        names = list(parameters)
        mean = t["images"].where(chosen).groupBy("camera").agg(*[F.avg(F.coalesce(F.col("adjust")[p], F.lit(0.0))).alias(f"__{p}") for p in names])
        c = t["cameras"].join(mean, "camera", "left")
        for p in names:
            c = c.withColumn("params", F.transform_values("params", lambda k, v, p=p: F.when(k == p, v + F.coalesce(F.col(f"__{p}"), F.lit(0.0))).otherwise(v)))
        left = F.when(chosen, F.map_filter("adjust", lambda k, v: ~k.isin(names))).otherwise(F.col("adjust"))
        return t | {"cameras": c.drop(*[f"__{p}" for p in names]), "images": t["images"].withColumn("adjust", left)}

    return Step(f"drop adjustments of {', '.join(parameters)}", run)


def switch_camera_model(model: str, cameras: Sequence[int] | None = None) -> Step:
    """Cameras under another model: parameters of the same name stay, a single focal length stands for both and both for their mean, others become 0."""
    if model not in g.MODELS:
        raise ValueError(f"no camera model {model}")

    def run(t):
        p = F.col("params")
        focal = lambda a, b: F.coalesce(p[a], p[b])
        given = {"f": F.coalesce(p["f"], (p["fx"] + p["fy"]) / 2), "fx": focal("fx", "f"), "fy": focal("fy", "f")}
        new = F.create_map(*[x for n in g.MODELS[model] for x in (F.lit(n), F.coalesce(given.get(n, p[n]), F.lit(0.0)))])
        chosen = F.lit(True) if cameras is None else F.col("camera").isin(list(cameras))
        return t | {"cameras": t["cameras"].withColumns({"params": F.when(chosen, new).otherwise(p), "model": F.when(chosen, F.lit(model)).otherwise(F.col("model"))})}

    return Step(f"switch cameras to {model}", run)


def materialize_infinity(far: float) -> Step:
    """Points at infinity become finite ones, `far` along their direction from the mean of all camera centres."""

    def run(t):
        c = g.camera_centre(g.columns(*_Q), g.columns(*_T))
        mean = t["images"].agg(*[F.avg(x).alias(f"__{a}") for x, a in zip(c, _P, strict=True)])
        p = t["points"].join(F.broadcast(mean))
        d = dict(zip(_P, g.unit(g.columns(*_P)), strict=True))
        moved = {a: F.when(F.col("w") == 0, F.col(f"__{a}") + far * d[a]).otherwise(F.col(a)) for a in _P}
        return t | {"points": p.withColumns(moved | {"w": F.lit(1.0)}).drop(*[f"__{a}" for a in _P])}

    return Step("materialize points at infinity", run)


def scale_by_measurements(measured: Sequence[tuple[str, str, str | float]], unit: str) -> Step:
    """Scale so that the median of measured / stored distances of pairs of points becomes 1; points are named by their point ids."""
    pairs = [(text.parsed_point_id(a)[1], text.parsed_point_id(b)[1], text.length(d, unit)) for a, b, d in measured]

    def run(t):
        p = t["points"].where("w <> 0").select("point", *_P)
        m = p.sparkSession.createDataFrame(pairs, "a long, b long, measured double")
        x = m.join(p.toDF("a", "ax", "ay", "az"), "a").join(p.toDF("b", "bx", "by", "bz"), "b")
        far = g.norm(g.minus(g.columns("ax", "ay", "az"), g.columns("bx", "by", "bz")))
        factor = x.where(far > 0).agg(F.percentile(F.col("measured") / far, 0.5)).first()[0]
        if factor is None:
            raise ValueError("no pair of points to measure by")
        return transformed(t, g.Similarity(scale=float(factor)))

    return Step(f"scale by {len(pairs)} measurements", run)


#: The chain's options by name: how a step is made of the text after the option.
OPTIONS: dict[str, Callable[[str], Transform]] = {
    "rotate": lambda v: rotate([float(x) for x in v.split(",")[:3]], text.angle(v.split(",")[3])),
    "translate": lambda v: translate([float(x) for x in v.split(",")]),
    "scale": lambda v: scale(float(v)),
    "remove-short-tracks": lambda v: remove_short_tracks(int(v)),
    "remove-narrow-tracks": lambda v: remove_narrow_tracks(text.angle(v)),
    "remove-isolated": lambda v: remove_isolated(float(v)),
    "filter-by-reprojection-error": lambda v: filter_by_error(float(v)),
    "filter-by-patch-size": lambda v: filter_by_patch_size(float(v)),
    "include-range": include_range,
    "exclude-range": exclude_range,
    "include-glob": include_glob,
    "exclude-glob": exclude_glob,
    "select-by-distribution": lambda v: select_by_distribution(int(v)),
    "drop-thumbnails": lambda _: drop_thumbnails(),
    "drop-patch-bitmaps": lambda _: drop_patch_bitmaps(),
    "minimal": lambda _: minimal(),
    "switch-camera-model": switch_camera_model,
    "materialize-infinity": lambda v: materialize_infinity(float(v)),
    "align-to-input": lambda _: AlignToInput(),
}


def residuals(tables: Tables, model_of: str | None = None) -> DataFrame:
    """(point, image, error): how far each observation (with x2, y2, its pixel) is from its point's projection; null behind the camera.

    All cameras of one call share a model, `model_of`, or that of the first camera.
    """
    model = model_of or tables["cameras"].first()["model"]
    o = tables["observations"].join(tables["points"].select("point", *_P, "w"), "point").join(tables["images"].select("image", "camera", *_Q, *_T), "image").join(tables["cameras"].select("camera", "params"), "camera")
    turned = g.q_rotate(g.columns(*_Q), g.columns(*_P))
    seen = [a + F.when(F.col("w") == 0, 0.0).otherwise(b) for a, b in zip(turned, g.columns(*_T), strict=True)]
    u, v = g.projected(model, F.col("params"), seen)
    return o.select("point", "image", F.hypot(u - F.col("x2"), v - F.col("y2")).alias("error"))


def point_errors(tables: Tables, model_of: str | None = None) -> DataFrame:
    """points with error recomputed: the root of the mean squared residual over observations that have one."""
    e = residuals(tables, model_of).groupBy("point").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("error"))
    return tables["points"].drop("error").join(e, "point", "left")


def inlier_share(errors: DataFrame, most: float) -> DataFrame:
    """(n, share) of the errors that are most or less; a missing one is none."""
    return errors.agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("error") <= most).cast("double"), F.lit(0.0))).alias("share"))


def depth_statistics(tables: Tables) -> DataFrame:
    """(image, n, depth_min, depth_max, depth_mean, depth_median) of the finite points in front of each image; images without any have n = 0.

    An image sees a bounded number of points, which its exact median holds.
    """
    o = tables["observations"].join(tables["points"].where("w <> 0").select("point", *_P), "point").join(tables["images"].select("image", *_Q, *_T), "image")
    z = g.q_rotate(g.columns(*_Q), g.columns(*_P))[2] + F.col("tz")
    d = o.select("image", z.alias("z")).where("z > 0").groupBy("image").agg(F.count("*").alias("n"), F.min("z").alias("depth_min"), F.max("z").alias("depth_max"), F.avg("z").alias("depth_mean"), F.expr("percentile(z, 0.5)").alias("depth_median"))
    return tables["images"].select("image").join(d, "image", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def compared_poses(left: Tables, right: Tables) -> DataFrame:
    """(name, distance, rotation): how far apart the camera centres of images of the same name are, and by how many degrees they are turned."""
    pose = lambda t, s: t["images"].select("name", *[c.alias(f"{s}{a}") for c, a in zip(g.camera_centre(g.columns(*_Q), g.columns(*_T)), "xyz", strict=True)], *[F.col(c).alias(f"{s}{c}") for c in _Q])
    x = pose(left, "l").join(pose(right, "r"), "name")
    of = lambda s, cs: g.columns(*[s + c for c in cs])
    return x.select("name", g.norm(g.minus(of("l", "xyz"), of("r", "xyz"))).alias("distance"), F.degrees(g.q_angle(of("l", _Q), of("r", _Q))).alias("rotation"))


def compared_points(left: Tables, right: Tables, pairs: DataFrame, size: float) -> DataFrame:
    """(n, mean, median, within_01, within_1, within_10): distances of corresponding points (source, target), and the shares within 0.1, 1 and 10 % of size."""
    x = pairs.join(left["points"].where("w <> 0").selectExpr("point AS source", "x", "y", "z"), "source").join(right["points"].where("w <> 0").selectExpr("point AS target", "x AS u", "y AS v", "z AS t"), "target")
    d = g.norm(g.minus(g.columns("x", "y", "z"), g.columns("u", "v", "t")))
    share = lambda part: F.avg((d <= part * size).cast("double"))
    return x.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"), share(0.001).alias("within_01"), share(0.01).alias("within_1"), share(0.1).alias("within_10"))


def scene_bounds(points: DataFrame) -> DataFrame:
    """(x, y, z, radius): the median of finite points by axis, and the largest distance from it; the origin and 1 for fewer than two points."""
    p = points.where("w <> 0")
    m = [aggregates.quantile(p, a) or 0.0 for a in _P]
    few = F.col("n") < 2
    far = p.agg(F.count("*").alias("n"), F.max(g.norm([F.col(a) - v for a, v in zip(_P, m, strict=True)])).alias("radius"))
    return far.select(*[F.when(few, 0.0).otherwise(F.lit(v)).alias(a) for a, v in zip(_P, m, strict=True)], F.when(few, 1.0).otherwise(F.col("radius")).alias("radius"))


def camera_spacing(images: DataFrame) -> DataFrame:
    """(scale): the 90th percentile of the distances of camera centres to their nearest others; null below two images."""
    c = images.select("image", *[x.alias(a) for x, a in zip(g.camera_centre(g.columns(*_Q), g.columns(*_T)), "xyz", strict=True)])
    return neighbors.nearest_distances(c, "image", list(_P)).agg(F.expr("percentile(distance, 0.9)").alias("scale"))


def image_hops(pairs: DataFrame, images: DataFrame, start: Column, most: int = 10) -> DataFrame:
    """(image, hops): the fewest steps over pairs (i, j) from the images that start holds for; null beyond `most` steps."""
    both = cut(pairs.select("i", "j").unionByName(pairs.selectExpr("j AS i", "i AS j")).distinct())
    reached = cut(images.where(start).select("image", F.lit(0).alias("hops")))
    last = reached
    for k in range(1, most + 1):
        new = both.join(last.select(F.col("image").alias("i")), "i").select(F.col("j").alias("image")).distinct().join(reached, "image", "left_anti").withColumn("hops", F.lit(k))
        last = cut(new)
        if last.isEmpty():
            break
        reached = cut(reached.unionByName(last))
    return images.select("image").join(reached, "image", "left")


def summary(tables: Tables) -> DataFrame:
    """(measure, n, least, most, mean, median) of track lengths, errors and observations by image."""
    length = tables["observations"].groupBy("point").agg(F.count("*").cast("double").alias("v"))
    seen = tables["images"].select("image").join(tables["observations"].groupBy("image").agg(F.count("*").alias("c")), "image", "left").select(F.coalesce("c", F.lit(0)).cast("double").alias("v"))
    out = None
    for name, df in (("track_length", length.select("v")), ("error", tables["points"].where("not isnan(error)").select(F.col("error").cast("double").alias("v"))), ("observations", seen)):
        row = df.agg(F.lit(name).alias("measure"), F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"))
        out = row if out is None else out.unionByName(row)
    return out


def image_metrics(tables: Tables) -> DataFrame:
    """(image, n, mean, median, max, track_length): errors of the points that an image sees, and their mean number of observations; images without any stay."""
    length = tables["observations"].withColumn("len", F.count("*").over(Window.partitionBy("point")))
    o = length.join(tables["points"].select("point", "error"), "point").where("error is not null and not isnan(error)")
    m = o.groupBy("image").agg(F.count("*").alias("n"), F.avg("error").alias("mean"), F.expr("percentile(error, 0.5)").alias("median"), F.max("error").alias("max"), F.avg("len").alias("track_length"))
    return tables["images"].select("image", "name").join(m, "image", "left").withColumn("n", F.coalesce("n", F.lit(0)))
