"""Commands over reconstructions that are kept as folders of Parquet tables: python -m covista COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2"
TABLES = ("images", "points", "observations", "cameras")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("covista").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from covista.sources import bundle

    return bundle.load(spark, folder, *TABLES)


def _show(df: DataFrame, rows: int) -> None:
    """The first rows of a report as lines of JSON."""
    for r in df.limit(rows).toJSON().collect():
        print(r)


def _pairs(tables):
    from covista.operators import joins

    return joins.covisibility(tables["observations"], "point", "image")


def analyze(spark, a):
    from covista.operators import aggregates, transforms

    t = _load(spark, a.folder)
    if a.what == "metrics":
        m = transforms.image_metrics(t)
        _show(aggregates.flags(m, t["points"], "error").orderBy(F.desc_nulls_last("mean"), "image"), a.rows)
    elif a.what == "covisibility":
        _show(_pairs(t).orderBy(F.desc("shared"), "i", "j"), a.rows)
    elif a.what == "images":
        first = t["images"].agg(F.min("image")).first()[0]
        _show(transforms.image_hops(_pairs(t), t["images"], F.col("image") == first).join(transforms.depth_statistics(t), "image").orderBy("image"), a.rows)
    elif a.what == "depth":
        _show(transforms.depth_statistics(t).orderBy("image"), a.rows)


def inspect(spark, a):
    from covista.operators import transforms
    from covista.sources import bundle

    t = _load(spark, a.folder)
    if a.point is not None:
        _show(t["points"].where(F.col("point") == a.point).join(t["observations"], "point").orderBy("image"), a.rows)
        return
    for name, df in t.items():
        print(json.dumps({"table": name} | bundle.digest(df).first().asDict()))
    _show(transforms.summary(t), a.rows)


def compare(spark, a):
    from covista.operators import joins, transforms

    x, y = _load(spark, a.left), _load(spark, a.right)
    moved = transforms.transformed(x, transforms.alignment(x, y)) if a.align else x
    _show(transforms.compared_poses(moved, y).orderBy("name"), a.rows)
    _show(joins.compared_sets(x["observations"], y["observations"], "image", "feature").orderBy("image"), a.rows)


def align(spark, a):
    from covista.operators import transforms
    from covista.sources import bundle

    x = transforms.apply_all(_load(spark, a.folder), [transforms.align_to(_load(spark, a.target))])
    bundle.save(x, a.out)


def xform(spark, a):
    from covista.operators import transforms
    from covista.sources import bundle

    steps = []
    for step in a.step:
        name, _, value = step.partition("=")
        if name not in transforms.OPTIONS:
            raise SystemExit(f"no step {name}; known: {', '.join(sorted(transforms.OPTIONS))}")
        steps.append(transforms.OPTIONS[name](value))
    bundle.save(transforms.apply_all(_load(spark, a.folder), steps, a.feature_source), a.out)
    for s in steps:
        print(s.description)


def motion(spark, a):
    from covista.functions import geometry as g
    from covista.functions import text
    from covista.operators import motion as m

    t = _load(spark, a.folder)
    centre = g.camera_centre(g.columns("qw", "qx", "qy", "qz"), g.columns("tx", "ty", "tz"))
    sequence, number = text.sequence_of_name(F.col("name"))
    frames = t["images"].select("image", sequence.alias("sequence"), number.alias("number"), *[c.alias(n) for c, n in zip(centre, ("cx", "cy", "cz"), strict=True)], "qw", "qx", "qy", "qz").where("sequence is not null")
    _, edges = m.analysed(frames, t["observations"], "sequence", "number", "image", "point", ("cx", "cy", "cz"), ("qw", "qx", "qy", "qz"))
    _show(edges.where("n_flags > 0").orderBy("sequence", "edge"), a.rows)


def match(spark, a):
    from covista.operators import neighbors

    features = spark.read.parquet(a.features)
    if a.cluster:
        neighbors.background_floor_clusters(features, "row", "image", "descriptor").write.parquet(a.out)
    else:
        i, j = (features.where(F.col("image") == k).drop("image") for k in a.images)
        neighbors.mutual_best(i, j, "row", "descriptor", a.limit).write.parquet(a.out)


def merge(spark, a):
    """Reconstructions one after the other: images by name, points by shared observations."""
    from covista.operators import tracks
    from covista.operators.filters import renumbered
    from covista.sources import bundle

    parts = [_load(spark, f) for f in a.folders]
    node = lambda c, k: F.col(c) * len(parts) + k
    union = lambda name, f: [f(p[name], k) for k, p in enumerate(parts)]

    def one(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    images = one(union("images", lambda d, k: d.withColumns({"__node": node("image", k), "camera": node("camera", k)})))
    names = renumbered(images.groupBy("name").agg(F.min("__node").alias("__first")), "__first", "__image")
    merged = images.join(names, images["__node"] == names["__first"], "left_semi").join(names.select("name", "__image"), "name")
    ids = images.join(names.select("name", "__image"), "name").select("__node", "__image")
    points = one(union("points", lambda d, k: d.withColumn("node", node("point", k))))
    for c in "rgb":
        if c not in points.columns:
            points = points.withColumn(c, F.lit(0))
    seen = one(union("observations", lambda d, k: d.select(node("point", k).alias("node"), node("image", k).alias("__node"), "feature"))).join(ids, "__node").select("node", F.col("__image").alias("image"), "feature")
    none = points.select("node", F.col("node").alias("root")).where("false")
    p, o = tracks.merge_points_and_tracks(points.select("node", "x", "y", "z", "w", "r", "g", "b", "error"), seen, none)
    cameras = one(union("cameras", lambda d, k: d.withColumn("camera", node("camera", k))))
    bundle.save({"images": merged.withColumn("image", F.col("__image")).drop("__image", "__node"), "points": p, "observations": o, "cameras": cameras}, a.out)


def from_colmap_bin(spark, a):
    from covista.sources import bundle, colmap

    m = colmap.read_binary(spark, a.folder)
    q, t = F.col("quaternion"), F.col("translation")
    names = {n: q[k] for k, n in enumerate(("qw", "qx", "qy", "qz"))} | {n: t[k] for k, n in enumerate(("tx", "ty", "tz"))}
    params = F.array(*[F.struct(F.lit(model).alias("m"), F.array(*map(F.lit, keys)).alias("k")) for model, keys in _models().items()])
    keys = F.filter(params, lambda s: s["m"] == F.col("model"))[0]["k"]
    bundle.save({
        "images": m["images"].withColumns(names).drop("quaternion", "translation"), "points": m["points"].withColumn("w", F.lit(1.0)),
        "observations": m["tracks"].select("point", "image", "feature"), "cameras": m["cameras"].withColumn("params", F.map_from_arrays(keys, "params")),
    }, a.out)


def _models():
    from covista.functions.geometry import MODELS

    return MODELS


def to_colmap_bin(spark, a):
    from pyspark.sql.window import Window

    from covista.sources import colmap

    t = _load(spark, a.folder)
    keys = F.coalesce(*[F.when(F.col("model") == m, F.array(*[F.col("params")[k] for k in ks])) for m, ks in _models().items()])
    nth = F.row_number().over(Window.partitionBy("point").orderBy("image", "feature")) - 1
    place = F.row_number().over(Window.partitionBy("image").orderBy("feature", "point")) - 1
    o = t["observations"].withColumns({"nth": nth.cast("long"), "place": place.cast("long")})
    zero = lambda c: F.col(c) if c in t["observations"].columns else F.lit(0.0)
    points = t["points"].where("w <> 0")
    o = o.join(points.select("point"), "point", "left_semi")
    colour = lambda c: F.col(c).cast("int") if c in points.columns else F.lit(0)
    colmap.write_binary(spark, a.out, {
        "cameras": t["cameras"].select("camera", "model", *[(F.col(c) if c in t["cameras"].columns else F.lit(0)).alias(c) for c in ("width", "height")], keys.alias("params")),
        "images": t["images"].select("image", F.array("qw", "qx", "qy", "qz").alias("quaternion"), F.array("tx", "ty", "tz").alias("translation"), "camera", "name"),
        "observations": o.select("image", F.col("place").alias("ordinal"), zero("x2").alias("x"), zero("y2").alias("y"), "point"),
        "points": points.select("point", "x", "y", "z", *[colour(c).alias(c) for c in "rgb"], F.coalesce(F.col("error").cast("double"), F.lit(0.0)).alias("error")),
        "tracks": o.select("point", F.col("nth").alias("ordinal"), "image", F.col("place").alias("feature")),
    })


def to_colmap_db(spark, a):
    from covista.sources import archives, colmap

    colmap.write_database_matches(spark, a.out, archives.matches_pairs(spark, a.matches).select((F.col("image_i") + 1).alias("image_i"), (F.col("image_j") + 1).alias("image_j"), "feature_i", "feature_j"))


def frames_json(tables) -> dict:
    """Cameras to world as 4 x 4 matrices by image, y up and looking along -z; images fit the driver."""
    from covista.functions import geometry as g

    q = g.columns("qw", "qx", "qy", "qz")
    axes = [g.q_rotate(g.q_conjugate(q), [F.lit(x) for x in v]) for v in ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0))]
    centre = g.camera_centre(q, g.columns("tx", "ty", "tz"))
    rows = [F.array(*[a[k] for a in axes], centre[k]) for k in range(3)]
    cameras = {r["camera"]: r for r in tables["cameras"].collect()}
    frames = [{"file_path": r["name"], "camera_model": cameras[r["camera"]]["model"], **cameras[r["camera"]]["params"], "transform_matrix": [*r["m"], [0.0, 0.0, 0.0, 1.0]]} for r in tables["images"].select("name", "camera", F.array(*rows).alias("m")).orderBy("name").collect()]
    return {"frames": frames}


def to_nerfstudio(spark, a):
    from covista.sources import archives, colmap

    t = _load(spark, a.folder)
    archives.write(spark, f"{a.out}/transforms.json", json.dumps(frames_json(t), indent=1).encode())
    p = t["points"].where("w <> 0")
    colmap.write_ply(spark, f"{a.out}/sparse.ply", p.select("x", "y", "z", *[(F.col(c) if c in p.columns else F.lit(0)).alias(c) for c in "rgb"]))


def camrig(spark, a):
    from covista.sources import archives

    if a.what == "create":
        with open(a.config) as f:
            c = json.load(f)
        archives.write_camrig(spark, a.path, {"version": 1, **c.get("metadata", {})}, c["cameras"], *([s[k] for s in c["sensors"]] for k in ("pattern", "camera", "quaternion", "translation")))
    else:
        faults = archives.verify(spark, a.path, "camrig").collect()
        if faults:
            raise SystemExit("\n".join(f["fault"] for f in faults))
        archives.write(spark, a.config, bytes(archives.files(spark, a.path).first()["content"]))


def pack(spark, a):
    """A folder of tables as one archive."""
    from covista.sources import reconstruction

    print(reconstruction.save(spark, _load(spark, a.folder), a.archive))


def unpack(spark, a):
    """An archive as a folder of tables."""
    from covista.sources import bundle, reconstruction

    bundle.save(reconstruction.load(spark, a.archive), a.folder)


def verify(spark, a):
    """What is wrong with archives of reconstructions; fails if anything is."""
    from covista.sources import reconstruction

    if faults := reconstruction.verify(spark, a.archives).orderBy("path", "fault").collect():
        raise SystemExit("\n".join(f"{f['path']}: {f['fault']}" for f in faults))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="covista", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(f, name, *places, **options):
        p = sub.add_parser(name, help=f.__doc__)
        for x in places:
            p.add_argument(x)
        p.add_argument("--rows", type=int, default=50, help="rows of a report")
        p.set_defaults(run=f)
        return p

    p = add(analyze, "analyze")
    p.add_argument("what", choices=["metrics", "covisibility", "images", "depth"])
    p.add_argument("folder")
    add(inspect, "inspect", "folder").add_argument("--point", type=int)
    add(compare, "compare", "left", "right").add_argument("--align", action="store_true")
    add(align, "align", "folder", "target", "out")
    p = add(xform, "xform", "folder", "out")
    p.add_argument("--step", action="append", default=[], help="name or name=value, in order")
    p.add_argument("--feature-source")
    add(motion, "motion", "folder")
    p = add(match, "match", "features", "out")
    p.add_argument("--cluster", action="store_true")
    p.add_argument("--images", type=int, nargs=2)
    p.add_argument("--limit", type=float)
    add(merge, "merge", "out").add_argument("folders", nargs="+")
    add(from_colmap_bin, "from-colmap-bin", "folder", "out")
    add(to_colmap_bin, "to-colmap-bin", "folder", "out")
    add(to_colmap_db, "to-colmap-db", "matches", "out")
    add(to_nerfstudio, "to-nerfstudio", "folder", "out")
    add(pack, "pack", "folder", "archive")
    add(unpack, "unpack", "archive", "folder")
    add(verify, "verify").add_argument("archives", nargs="+")
    p = add(camrig, "camrig")
    p.add_argument("what", choices=["create", "cp"])
    p.add_argument("path")
    p.add_argument("config", help="create: a JSON file of cameras and sensors; cp: where to")
    sub.add_parser("version").set_defaults(run=lambda spark, a: print(VERSION))
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(None if a.command == "version" else _spark(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
