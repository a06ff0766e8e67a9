"""Reconstructions in one column archive each: a Spark data source that scans its tables by row ranges, a streaming writer, and verification.

An archive has sections of arrays of one length (images, points3d, tracks, rigs, frames, derived) and JSON entries. Each
array is an entry of its own, named by shape and type, so a scan opens the directory and the entries of the columns that
are asked for, and no others; entries are decompressed as streams, a batch of rows at a time.
"""

from __future__ import annotations

import contextlib
import json
import uuid
import zipfile
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from covista.functions import geometry as g
from covista.operators.tables import cut

from . import archives
from .archives import ArchiveError

FORMAT = "covista_reconstruction"
#: Rows of a partition of a scan, and bytes of a batch or of a chunk that is written.
ROWS, BATCH = 1 << 18, 4 << 20
#: For each table: where its arrays are, its row number's name, and the array that tells how many rows there are.
TABLES = {
    "images": ("images/", "image", "images/camera_indexes"),
    "points": ("points3d/", "point", "points3d/reprojection_errors"),
    "observations": ("tracks/", "observation", "tracks/image_indexes"),
    "sensors": ("rigs/sensor_", "sensor", "rigs/sensor_camera_indexes"),
    "image_frames": ("frames/image_", "image", "frames/image_frame_indexes"),
    "frames": ("frames/rig_indexes", "frame", "frames/rig_indexes"),
    "depths": ("derived/", "image", "derived/observed_depth_histogram_counts"),
    "underived_normals": ("points3d/underived_normals_xyz", "row", "points3d/underived_normals_xyz"),
}
#: Arrays that have a row for each point though they are in another folder, and names of older versions. Fixed values of the format.
BY_POINT = ("tracks/observation_counts", "tracks/reference_observations")
OLD_NAMES = {"points3d/positions_xyz": "points3d/positions_xyzw", "points3d/estimated_normals_xyz": "points3d/normals_xyz", "tracks/points3d_indexes": "tracks/point_indexes", "images/observed_depth_histogram_counts": "derived/observed_depth_histogram_counts"}
#: Versions: of today's axes, of normals that follow from the patch frame and readings in 16 bits, the last without readings.
AXES, NEWEST, PLAIN = 5, 16, 14
#: The sections that a whole archive's digest has, in order; derived/ has its own only.
SECTIONS = ("metadata", "cameras", "rigs", "frames", "images", "points3d", "tracks")
_NONE = {"constraint_reference_images": 0xFFFFFFFF, "reference_observations": -1}
_SCALARS = {"int8": "short", "int16": "short", "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "long", "int32": "int", "int64": "long", "float16": "float", "float32": "float", "float64": "double", "uint128": "binary"}
_ARROW = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}


def store(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@contextlib.contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """The archive at a path or URI of a store that Arrow reads; only what is asked for is fetched."""
    where, at = store(path)
    with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        yield z


def arrays(z: zipfile.ZipFile) -> dict[str, tuple[str, tuple[int, ...], str]]:
    """For each array, by today's name: its entry, shape and type."""
    out = {}
    for entry in z.namelist():
        if m := archives._ARRAY.fullmatch(entry):
            out[OLD_NAMES.get(m[1], m[1])] = entry, tuple(int(x) for x in m[2].split(".") if x), m[3]
    return out


def table_columns(z: zipfile.ZipFile, table: str) -> dict[str, tuple[str, tuple[int, ...], str]]:
    """The arrays of a table by column name, and its number of rows at ''."""
    folder, _, anchor = TABLES[table]
    found = arrays(z)
    if anchor not in found:
        return {"": ("", (0,), "")}
    n = found[anchor][1][0]
    own = {k: v for k, v in found.items() if (k.startswith(folder) and k not in BY_POINT and (table == "underived_normals") == k.startswith("points3d/underived")) or (table == "points" and k in BY_POINT)}
    if odd := [k for k, v in own.items() if v[1][0] != n]:
        raise ArchiveError(f"{odd[0]} has {own[odd[0]][1][0]} rows, not {n}")
    return {"": ("", (n,), "")} | {k.rsplit("/", 1)[1].removesuffix("_deficit"): v for k, v in own.items()}


def _kind(shape: tuple[int, ...], kind: str) -> str:
    """The Spark type of a column: rows of two dimensions and more (pictures) are bytes."""
    return _SCALARS[kind] if len(shape) == 1 else f"array<{_SCALARS[kind]}>" if len(shape) == 2 else "binary"


def _values(raw: bytes, name: str, entry: str, shape: tuple[int, ...], kind: str) -> pa.Array:
    x = np.frombuffer(raw, archives.TYPES[kind]).reshape(-1, *shape[1:])
    if kind == "uint128" or len(shape) > 2:
        return pa.array([r.tobytes() for r in x], pa.binary())
    if kind == "float16":
        x = x.astype(np.float32)
        x = 1 - x if "_deficit." in entry else x
    flat = pa.array(x.reshape(-1).astype(_ARROW[_SCALARS[kind]].to_pandas_dtype()))
    if name in _NONE:
        flat = pa.array(x.reshape(-1).astype(np.int64), mask=x.reshape(-1) == _NONE[name]).cast(flat.type)
    return flat if len(shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, shape[1], np.int32)), flat)


class Stream:
    """An entry's uncompressed bytes from a place on."""

    def __init__(self, z: zipfile.ZipFile, entry: str, skip: int = 0):
        import zstandard

        self.entry, self.reader = entry, zstandard.ZstdDecompressor().stream_reader(z.open(entry))
        while skip:
            skip -= len(self.read(min(skip, BATCH)))

    def read(self, n: int) -> bytes:
        import zstandard

        out = bytearray()
        try:
            while len(out) < n and (part := self.reader.read(n - len(out))):
                out += part
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{self.entry}: {e}") from None
        if len(out) < n:
            raise ArchiveError(f"{self.entry} ends early")
        return bytes(out)

    def chunks(self) -> Iterator[bytes]:
        """What is left, in parts."""
        import zstandard

        try:
            while part := self.reader.read(BATCH):
                yield part
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{self.entry}: {e}") from None


def row_bytes(shape: tuple[int, ...], kind: str) -> int:
    return int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(archives.TYPES[kind]).itemsize


class Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    """Row ranges of one table in each of the paths; of the entries, only those of the schema's columns."""

    def __init__(self, options: Mapping[str, str], schema):
        self.options, self.names = dict(options), schema.fieldNames()
        self.table, self.paths = options["table"], json.loads(options["paths"])

    def partitions(self):
        size, out = int(self.options.get("rows", ROWS)), []
        low, high = (int(self.options.get(k, d)) for k, d in (("start", 0), ("stop", 1 << 62)))
        for path in self.paths:
            with opened(path) as z:
                n = min(high, table_columns(z, self.table)[""][1][0])
            out += [Rows(path, at, min(n, at + size)) for at in range(low, n, size)]
        return out or [Rows("", 0, 0)]

    def read(self, partition):
        if partition.start == partition.stop:
            return
        with opened(partition.path) as z:
            columns = table_columns(z, self.table)
            wanted = [n for n in self.names if n in columns]
            streams = {n: Stream(z, columns[n][0], partition.start * row_bytes(*columns[n][1:])) for n in wanted}
            names = archives.json_entry(z, "images/names.json.zst") if "name" in self.names else None
            step = max(1, min(16_384, BATCH // max([1, *(row_bytes(*columns[n][1:]) for n in wanted)])))
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                made = {"path": pa.array([partition.path] * n), TABLES[self.table][1]: pa.array(np.arange(at, at + n))}
                made |= {c: _values(s.read(n * row_bytes(*columns[c][1:])), c, *columns[c]) for c, s in streams.items()}
                if names is not None:
                    made["name"] = pa.array(names[at : at + n], pa.string())
                yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n) for c in self.names], self.names)


class ArchiveSource(DataSource):
    """Format covista_reconstruction, with the options table and paths (a JSON list), and rows, start and stop of the ranges."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        table, paths = self.options["table"], json.loads(self.options["paths"])
        columns: dict[str, str] = {}
        for path in paths:
            with opened(path) as z:
                for n, (_, shape, kind) in table_columns(z, table).items():
                    if n and columns.setdefault(n, _kind(shape, kind)) != _kind(shape, kind):
                        raise ArchiveError(f"{n} is of another type in {path}")
        own = {"path": "string", TABLES[table][1]: "long"} | ({"name": "string"} if table == "images" else {})
        return ", ".join(f"{n} {k}" for n, k in (own | columns).items())

    def reader(self, schema):
        return ArchiveReader(self.options, schema)


def scan(spark: SparkSession, paths: str | list[str], table: str, columns: str | None = None, start: int = 0, stop: int | None = None, rows: int = ROWS) -> DataFrame:
    """A table of archives: path, its row number (image, point, observation ...), and its arrays as columns.

    columns, a list of columns with their types as DDL, limits what is decompressed; start and stop limit the rows. Null
    stands for what the format marks by a number. A table that an archive doesn't have is empty.
    """
    if table not in TABLES:
        raise ArchiveError(f"no table {table}; there are {', '.join(TABLES)}")
    spark.dataSource.register(ArchiveSource)
    r = spark.read.format(FORMAT).option("table", table).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("rows", rows).option("start", start)
    r = r if stop is None else r.option("stop", stop)
    return (r.schema(columns) if columns else r).load()


def document(path: str, name: str):
    """A JSON entry of one archive; None where there is none."""
    with opened(path) as z:
        return archives.json_entry(z, f"{name}.json.zst") if f"{name}.json.zst" in z.namelist() else None


def load(spark: SparkSession, path: str, rows: int = ROWS) -> dict[str, DataFrame]:
    """The tables of a reconstruction as the transforms take them: images, points, observations, cameras, and those of rigs where there are any.

    Archives older than version 5 have other axes (cameras look down +z, y down); their poses, points and normals are
    turned. In archives of version 16 with patch frames, the normals follow from the frames; those that don't are stored.
    """
    meta = document(path, "metadata")
    if not meta or meta["version"] > NEWEST:
        raise ArchiveError(f"{path} is of version {meta and meta['version']}; up to {NEWEST} can be read")
    cameras = [(k, c["model"], int(c["width"]), int(c["height"]), {n: float(v) for n, v in c["parameters"].items()}) for k, c in enumerate(document(path, "cameras/metadata") or [])]
    i, p, o = (scan(spark, path, t, rows=rows).drop("path") for t in ("images", "points", "observations"))
    images = i.select("image", "name", F.col("camera_indexes").alias("camera"), *_spread("quaternions_wxyz", ("qw", "qx", "qy", "qz")), *_spread("translations_xyz", ("tx", "ty", "tz")), *_others(i, "image", "name", "camera_indexes", "quaternions_wxyz", "translations_xyz"))
    at = _spread("positions_xyzw", ("x", "y", "z", "w"))
    with opened(path) as z:
        homogeneous = arrays(z)["points3d/positions_xyzw"][1][1] == 4
    points = p.select("point", *(at if homogeneous else [*at[:3], F.lit(1.0).alias("w")]), F.col("reprojection_errors").cast("double").alias("error"), *_spread("colors_rgb", ("r", "g", "b")), *_others(p, "point", "positions_xyzw", "reprojection_errors", "colors_rgb", "observation_counts"))
    feature = [F.col("feature_indexes").alias("feature")] if "feature_indexes" in o.columns else [F.col("observation").alias("feature")]
    xy = _spread("keypoints_xy", ("u", "v")) if "keypoints_xy" in o.columns else []
    observations = o.select(F.col("point_indexes").alias("point"), F.col("image_indexes").alias("image"), *feature, *xy, *_others(o, "observation", "point_indexes", "image_indexes", "feature_indexes", "keypoints_xy"))
    out = {"images": images, "points": _with_normals(spark, path, points, meta), "observations": observations, "cameras": spark.createDataFrame(cameras, "camera long, model string, width int, height int, params map<string,double>")}
    if document(path, "rigs/metadata") is not None:
        out |= {t: scan(spark, path, t, rows=rows).drop("path") for t in ("sensors", "image_frames", "frames")}
    return _turned(out) if meta["version"] < AXES else out


def _spread(column: str, names: tuple[str, ...]) -> list[Column]:
    return [F.col(column)[k].alias(n) for k, n in enumerate(names)]


def _others(df: DataFrame, *known: str) -> list[str]:
    return [c for c in df.columns if c not in known]


def _frame_normal() -> Column:
    """The normal of a point's patch frame, null where its frame isn't stored or gives none."""
    u, v = ([F.col(f"patch_{k}_halfvec_xyz")[i] for i in range(3)] for k in "uv")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    good = (length > 0) & (length < float("inf")) & ~((u[0] == 0) & (u[1] == 0) & (u[2] == 0))
    return F.when(good, F.array(*[(c / length).cast("float") for c in n]))


def _with_normals(spark: SparkSession, path: str, points: DataFrame, meta: dict) -> DataFrame:
    if meta["version"] < NEWEST or "normals_xyz" in points.columns or "patch_u_halfvec_xyz" not in points.columns or not (document(path, "points3d/metadata") or {}).get("has_normals"):
        return points
    from covista.operators import filters

    points = points.withColumn("normals_xyz", _frame_normal())
    open_ = filters.renumbered(points.where("w <> 0 and normals_xyz is null").select("point"), "point").select("point", F.col("new_index").alias("row"))
    stored = open_.join(scan(spark, path, "underived_normals").drop("path"), "row").select("point", "underived_normals_xyz")
    return points.join(stored, "point", "left").withColumn("normals_xyz", F.coalesce("normals_xyz", "underived_normals_xyz")).drop("underived_normals_xyz")


#: Half a turn of the camera about x, and a quarter turn of the world about x (back).
_FLIP, _BACK = (0.0, 1.0, 0.0, 0.0), (0.5**0.5, 0.5**0.5, 0.0, 0.0)


def _turned(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """From the axes of older versions: the world's (x, y, z) is (x, z, -y), a camera's (x, -y, -z)."""
    q = g.q_product(g.q_product([F.lit(v) for v in _FLIP], [F.col(c) for c in ("qw", "qx", "qy", "qz")]), [F.lit(v) for v in _BACK])
    images = tables["images"].withColumns(dict(zip(("qw", "qx", "qy", "qz"), q, strict=True)) | {"ty": -F.col("ty"), "tz": -F.col("tz")})
    vectors = [c for c in ("normals_xyz", "patch_u_halfvec_xyz", "patch_v_halfvec_xyz") if c in tables["points"].columns]
    points = tables["points"].withColumns({"y": F.col("z"), "z": -F.col("y")} | {c: F.array(F.col(c)[0], F.col(c)[2], -F.col(c)[1]) for c in vectors})
    out = tables | {"images": images, "points": points}
    if "sensors" in out:
        q = [F.col("sensor_quaternions_wxyz")[k] for k in range(4)]
        q = g.q_product(g.q_product([F.lit(v) for v in _FLIP], q), [F.lit(v) for v in _FLIP])
        t = [F.col("sensor_translations_xyz")[k] for k in range(3)]
        out["sensors"] = out["sensors"].withColumns({"sensor_quaternions_wxyz": F.array(*[-c for c in q]), "sensor_translations_xyz": F.array(t[0], -t[1], -t[2])})
    return out


# The writer.


def _encoded(name: str, x: np.ndarray, kind: np.dtype) -> bytes:
    if kind.kind in "iu" and len(x) and not (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
        raise ArchiveError(f"{name} has {x.min()} to {x.max()}, which {kind} doesn't hold")
    return x.astype(kind).tobytes()


def _chunks(df: DataFrame, columns: Mapping[str, tuple[Column, str]], order: list[str]) -> DataFrame:
    """(entry, part, nth, rows, data): the columns' bytes in the order of the rows, in chunks, as a written table.

    The rows are sorted over all partitions by range; parts and chunks of a part are in that order.
    """
    kinds = {n: np.dtype(archives.TYPES[k]) for n, (_, k) in columns.items()}
    schema = pa.schema([("entry", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("rows", pa.int64()), ("data", pa.binary())])

    def run(batches):
        nth = 0
        for b in batches:
            part = b.column("_part")[0].as_py() if b.num_rows else 0
            made = {n: (lambda x: x.flatten() if pa.types.is_list(x.type) else x)(b.column(n)) for n in kinds}
            raw = [b"".join(x.to_pylist()) if pa.types.is_binary(x.type) else _encoded(n, x.to_numpy(zero_copy_only=False), kinds[n]) for n, x in made.items()]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(kinds)), *(pa.array([v] * len(kinds), pa.int64()) for v in (part, nth, b.num_rows)), pa.array(raw, pa.binary())], schema=schema)
            nth += 1

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(dealt.select(F.spark_partition_id().cast("long").alias("_part"), *[c.alias(n) for n, (c, _) in columns.items()]).mapInArrow(run, "entry string, part long, nth long, rows long, data binary"))


def save(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, metadata: Mapping | None = None, level: int = 3) -> str:
    """Write an archive of the tables images, points, observations and cameras, and of the arrays that they have besides; returns its digest.

    Rows are numbered anew by the order of their numbers: points and images without gaps, observations by point, image and
    feature. A point without observations, or an observation of what isn't there, is an error, and nothing is written.
    Spark sorts the tables and cuts their columns into chunks of bytes. A file and a section's digest are made from one end
    to the other, so one task reads the chunks in order, holds a few at a time, compresses them, folds them into the
    digest and writes them on; the driver gets the digest alone. The file gets its name when it is whole.
    """
    from covista.operators import filters

    points, images = (cut(filters.renumbered(tables[t], k)) for t, k in (("points", "point"), ("images", "image")))
    number = lambda df, k: df.select(F.col(k).alias(f"_{k}"), F.col("new_index").alias(f"new_{k}"))
    seen = tables["observations"].join(number(points, "point"), F.col("point") == F.col("_point"), "left").join(number(images, "image"), F.col("image") == F.col("_image"), "left")
    seen = cut(seen.drop("_point", "_image"))
    counts = cut(seen.groupBy("new_point").agg(F.count("*").alias("observation_counts")))
    points = cut(points.join(counts, points["new_index"] == counts["new_point"], "left"))
    lost = seen.where("new_point is null or new_image is null").count(), points.where("observation_counts is null").count()
    if any(lost):
        raise ArchiveError(f"{lost[0]} observations of points or images that aren't there, {lost[1]} points without observations")
    cameras = [r.asDict() for r in tables["cameras"].orderBy("camera").collect()]
    numbers = {c["camera"]: k for k, c in enumerate(cameras)}
    camera = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col("camera")] if numbers else F.lit(0)
    arr = lambda *names: F.array(*[F.col(n).cast("double") for n in names])

    def optional(df: DataFrame, folder: str, kinds: Mapping[str, str]) -> dict:
        return {f"{folder}/{n}": (F.col(n), k) for n, k in kinds.items() if n in df.columns}

    p_columns = {"points3d/positions_xyzw": (arr("x", "y", "z", "w"), "float64"), "points3d/reprojection_errors": (F.col("error"), "float32"), "tracks/observation_counts": (F.col("observation_counts"), "uint32")}
    p_columns["points3d/colors_rgb"] = (arr("r", "g", "b") if {"r", "g", "b"} <= {*points.columns} else F.array(*[F.lit(0.0)] * 3), "uint8")
    p_columns |= optional(points, "points3d", {"normals_xyz": "float32", "normal_confidence": "uint8", "patch_u_halfvec_xyz": "float32", "patch_v_halfvec_xyz": "float32"})
    i_columns = {"images/camera_indexes": (camera, "uint32"), "images/quaternions_wxyz": (arr("qw", "qx", "qy", "qz"), "float64"), "images/translations_xyz": (arr("tx", "ty", "tz"), "float64")}
    zero = F.lit(bytes(16))
    sift = "feature" in seen.columns
    for n in ("feature_tool_hashes", "sift_content_hashes") if sift else ("image_file_hashes",):
        i_columns[f"images/{n}"] = (F.coalesce(F.col(n), zero) if n in images.columns else zero, "uint128")
    i_columns |= optional(images, "images", {"focal_adjustments": "float64", "principal_point_adjustments_xy": "float64", "radial_bspline_adjustments": "float64", "rolling_shutter_rates_xyz": "float64"})
    o_columns = {"tracks/image_indexes": (F.col("new_image"), "uint32"), "tracks/point_indexes": (F.col("new_point"), "uint32")} | ({"tracks/feature_indexes": (F.col("feature"), "uint32")} if sift else {})
    o_columns |= {"tracks/keypoints_xy": (arr("u", "v"), "float32")} if {"u", "v"} <= {*seen.columns} else {}
    o_columns |= optional(seen, "tracks", {"observation_confidence": "uint8"})
    sizes = {"images": images.count(), "points": points.count(), "observations": seen.count()}
    tails = {n: t for n, t in (("positions_xyzw", 4), ("colors_rgb", 3), ("normals_xyz", 3), ("patch_u_halfvec_xyz", 3), ("patch_v_halfvec_xyz", 3), ("quaternions_wxyz", 4), ("translations_xyz", 3), ("principal_point_adjustments_xy", 2), ("radial_bspline_adjustments", 2), ("rolling_shutter_rates_xyz", 3), ("keypoints_xy", 2))}
    made = {}
    for df, columns, order, table in ((points, p_columns, ["new_index"], "points"), (images, i_columns, ["new_index"], "images"), (seen, o_columns, ["new_point", "new_image", *(["feature"] if sift else [])], "observations")):
        chunks = _chunks(df, columns, order)
        for n, (_, kind) in columns.items():
            tail = tails.get(n.rsplit("/", 1)[1])
            made[f"{n}.{sizes[table]}{f'.{tail}' if tail else ''}.{kind}.zst"] = chunks.where(F.col("entry") == n).select("part", "nth", "data")
    names = [r[0] for r in images.orderBy("new_index").select("name").toLocalIterator()]
    far = points.where("w = 0").count()
    documents = {
        "metadata": dict(metadata or {}) | {"version": PLAIN, "image_count": sizes["images"], "point_count": sizes["points"], "infinity_point_count": far, "observation_count": sizes["observations"], "camera_count": len(cameras), "feature_source": "sift_files" if sift else "embedded_patches"},
        "cameras/metadata": [{"model": c["model"], "width": c.get("width") or 0, "height": c.get("height") or 0, "parameters": c["params"]} for c in cameras],
        "images/metadata": {"image_count": sizes["images"], "has_thumbnails": False},
        "images/names": names,
        "points3d/metadata": {"point_count": sizes["points"], "has_normals": "normals_xyz" in points.columns, "has_normal_confidence": "normal_confidence" in points.columns, "has_uv_frames": "patch_u_halfvec_xyz" in points.columns},
        "tracks/metadata": {"observation_count": sizes["observations"], "has_feature_indexes": sift, "has_keypoints_xy": "u" in seen.columns, "has_observation_confidence": "observation_confidence" in seen.columns},
        "derived/depth_statistics": {"num_histogram_buckets": 1, "images": [{"histogram_min_z": None, "histogram_max_z": None, "observed": {"count": 0, "infinity_count": 0, "min_z": None, "max_z": None, "median_z": None, "mean_z": None}}] * sizes["images"]},
    }
    plain = {f"{n}.json.zst": json.dumps(d, separators=(",", ":"), ensure_ascii=False).encode() for n, d in documents.items()}
    plain[f"derived/observed_depth_histogram_counts.{sizes['images']}.1.uint32.zst"] = bytes(4 * sizes["images"])
    return _assembled(spark, path, plain, made, level)


def _assembled(spark: SparkSession, path: str, plain: dict[str, bytes], made: dict[str, DataFrame], level: int) -> str:
    """The archive of the entries plain, and of made, whose rows (part, nth, data) are chunks; its digest."""
    entries = [(s, n) for s in (*SECTIONS, "derived") for n in sorted({**plain, **made}) if n.startswith(f"{s}/") or n == f"{s}.json.zst"]
    kinds = "place int, part long, nth long, data binary"
    # a row before the others, so that there is a task even if no table has a row
    chunks = spark.range(1).select(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("nth"), F.lit(b"").alias("data"))
    for k, (_, n) in enumerate(entries):
        if n in made:
            chunks = chunks.unionByName(made[n].select(F.lit(k).alias("place"), "part", "nth", "data"))

    def run(batches):
        rows = ((k, d) for b in batches for k, d in zip(b.column("place").to_pylist(), b.column("data").to_pylist(), strict=True) if k >= 0)
        name, digest = _written(path, entries, plain, rows, level)
        yield pa.RecordBatch.from_pydict({"name": [name], "digest": [digest]})

    ordered = chunks.select(*[c.split()[0] for c in kinds.split(", ")]).repartition(1).sortWithinPartitions("place", "part", "nth")
    done = cut(ordered.mapInArrow(run, "name string, digest string"), batch=16).first()
    jvm = spark.sparkContext._jvm
    end, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, done["name"]))
    fs = end.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(end, False)
    if not fs.rename(part, end):
        raise OSError(f"can't write {path}")
    return done["digest"]


def _written(path: str, entries: list[tuple[str, str]], plain: dict[str, bytes], rows: Iterator[tuple[int, bytes]], level: int) -> tuple[str, str]:
    """(name, digest) of an archive of entries (section, name), under a name of this attempt's own: plain ones, and those whose (place, chunk) come in rows, by place."""
    import xxhash
    import zstandard

    name = f"{path}.part-{uuid.uuid4().hex}"
    where, at = store(name)
    done, row = False, next(rows, None)
    try:
        digests = {}
        with where.open_output_stream(at, compression=None, buffer_size=BATCH) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for k, (section, n) in enumerate(entries):
                h = digests.setdefault(section, xxhash.xxh3_128())
                with z.open(zipfile.ZipInfo(n), "w", force_zip64=True) as f, zstandard.ZstdCompressor(level=level).stream_writer(f, closefd=False) as c:
                    if n in plain:
                        h.update(plain[n])
                        c.write(plain[n])
                    while row is not None and row[0] == k:
                        h.update(row[1])
                        c.write(row[1])
                        row = next(rows, None)
            whole = xxhash.xxh3_128(b"".join(digests[s].digest() for s in SECTIONS if s in digests)).hexdigest()
            hashes = {f"{s}_xxh128": d.hexdigest() for s, d in digests.items()} | {"content_xxh128": whole}
            z.writestr(archives.HASHES, zstandard.ZstdCompressor().compress(json.dumps(hashes, separators=(",", ":")).encode()))
        done = True
    finally:
        if not done:
            with contextlib.suppress(OSError):
                where.delete_file(at)
    return name, whole


def copied_part(spark: SparkSession, path: str, to: str, share: float) -> None:
    """Copy the first share of a file's bytes, by a task, a block at a time."""

    def run(batches):
        for b in batches:
            (a, x), (c, y) = store(path), store(to)
            with a.open_input_stream(x, compression=None) as i, c.open_output_stream(y, compression=None) as o:
                left = int(a.get_file_info(x).size * share)
                while left and (part := i.read(min(left, BATCH))):
                    o.write(part)
                    left -= len(part)
            yield b

    spark.range(1).repartition(1).mapInArrow(run, "id long").collect()


# Verification.


def _section_faults(path: str, section: str) -> tuple[str | None, list[str]]:
    """A section's digest, and what is wrong with it. Entries are read as streams."""
    import xxhash

    out: list[str] = []
    try:
        with opened(path) as z:
            h, found = xxhash.xxh3_128(), False
            for n in sorted(z.namelist()):
                if n.startswith(f"{section}/") or n == f"{section}.json.zst":
                    found, size, m = True, 0, archives._ARRAY.fullmatch(n)
                    for part in Stream(z, n).chunks():
                        h.update(part)
                        size += len(part)
                    want = int(np.prod([int(x) for x in m[2].split(".") if x], dtype=np.int64)) * np.dtype(archives.TYPES[m[3]]).itemsize if m else size
                    if size != want:
                        out.append(f"{n} has {size} bytes, not {want}")
            stored = archives.json_entry(z, archives.HASHES)
            if found and stored.get(f"{section}_xxh128") not in (None, h.hexdigest()):
                out.append(f"{section}_xxh128 is {h.hexdigest()}")
            if not found and section not in ("rigs", "frames", "derived"):
                out.append(f"no section {section}")
            return (h.hexdigest() if found else None), out + (_rules(z, section) if found else [])
    except (ArchiveError, zipfile.BadZipFile, OSError, ValueError, KeyError) as e:
        return None, [f"{section}: {e}"]


def _blocks(z: zipfile.ZipFile, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of an array, a batch at a time."""
    entry, shape, kind = arrays(z)[name]
    wide = row_bytes(shape, kind)
    step, s = max(1, BATCH // wide), Stream(z, entry)
    for at in range(0, shape[0], step):
        n = min(step, shape[0] - at)
        yield at, np.frombuffer(s.read(n * wide), archives.TYPES[kind]).reshape(n, *shape[1:])


def _rules(z: zipfile.ZipFile, section: str) -> list[str]:
    """The constraints of a section, besides its digest."""
    meta, out = archives.json_entry(z, "metadata.json.zst"), []
    if section == "metadata":
        if meta.get("version", 0) > NEWEST:
            out.append(f"version {meta.get('version')} is newer than {NEWEST}")
        if meta.get("feature_source", "sift_files") not in ("sift_files", "embedded_patches"):
            out.append(f"unknown feature_source {meta['feature_source']}")
        if any(n.startswith("frames/") for n in z.namelist()) != any(n.startswith("rigs/") for n in z.namelist()):
            out.append("rigs and frames must be there together")
    counted = {"images": "image_count", "points3d": "point_count", "tracks": "observation_count"}
    if section in counted:
        table = {"images": "images", "points3d": "points", "tracks": "observations"}[section]
        n = table_columns(z, table)[""][1][0]
        if n != meta.get(counted[section]):
            out.append(f"{counted[section]} is {meta.get(counted[section])}, but there are {n} rows")
    if section == "images":
        names, cameras = archives.json_entry(z, "images/names.json.zst"), len(archives.json_entry(z, "cameras/metadata.json.zst"))
        if len(names) != meta.get("image_count") or len(set(names)) != len(names):
            out.append(f"{len(names)} names, {len(set(names))} of them different")
        if any((x >= cameras).any() for _, x in _blocks(z, "images/camera_indexes")):
            out.append("an image's camera isn't there")
    if section == "points3d" and arrays(z)["points3d/positions_xyzw"][1][1] == 4:
        far = 0
        for at, x in _blocks(z, "points3d/positions_xyzw"):
            bad = ~np.isfinite(x).all(axis=1)
            out += [f"positions_xyzw row {at + k} isn't finite" for k in np.flatnonzero(bad)[:10]]
            out += [f"positions_xyzw row {at + k} has no direction" for k in np.flatnonzero((x == 0).all(axis=1))[:10]]
            far += int((x[:, 3] == 0).sum())
        if far != meta.get("infinity_point_count", 0):
            out.append(f"infinity_point_count is {meta.get('infinity_point_count')}, but {far} points have w = 0")
    if section == "tracks":
        last, total = (-1, -1), 0
        for (at, p), (_, i) in zip(_blocks(z, "tracks/point_indexes"), _blocks(z, "tracks/image_indexes"), strict=True):
            a, b = np.concatenate(([last[0]], p.astype(np.int64))), np.concatenate(([last[1]], i.astype(np.int64)))
            wrong = (a[1:] < a[:-1]) | ((a[1:] == a[:-1]) & (b[1:] < b[:-1]))
            if wrong.any():
                out.append(f"observations aren't in order by point and image at row {at + int(wrong.argmax())}")
                break
            if (b[1:] >= meta.get("image_count", 0)).any() or (a[1:] >= meta.get("point_count", 0)).any():
                out.append(f"an observation from row {at} on is of a point or image that isn't there")
            last = (int(a[-1]), int(b[-1]))
        for at, n in _blocks(z, "tracks/observation_counts"):
            total += int(n.sum())
            if (n < 1).any():
                out.append(f"point {at + int((n < 1).argmax())} has no observations")
        if total != meta.get("observation_count"):
            out.append(f"observation_counts come to {total}, not {meta.get('observation_count')}")
    return out


def verify(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, fault): what is wrong with the archives; one without faults has no row.

    Each section of each archive is a task of its own, which reads its entries as streams; a second step folds the
    sections' digests, a few rows an archive, into that of the whole.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    sections = [*SECTIONS, "derived"]
    rows = spark.createDataFrame([(p, s, k) for p in paths for k, s in enumerate(sections)], "path string, section string, k int").repartition(len(paths) * len(sections), "path", "section")

    def run(frames):
        import pandas as pd

        for f in frames:
            made = [(p, s, k, *_section_faults(p, s)) for p, s, k in zip(f["path"], f["section"], f["k"], strict=True)]
            yield pd.DataFrame(made, columns=["path", "section", "k", "digest", "faults"])

    def whole(key, f):
        import pandas as pd
        import xxhash

        f = f.sort_values("k")
        out = [x for xs in f["faults"] for x in xs]
        have = f[(f["section"] != "derived") & f["digest"].notna()]["digest"]
        try:
            with opened(key[0]) as z:
                stored = archives.json_entry(z, archives.HASHES).get("content_xxh128")
        except (ArchiveError, zipfile.BadZipFile, OSError, ValueError) as e:
            stored, out = None, [*out, str(e)]
        now = xxhash.xxh3_128(b"".join(bytes.fromhex(x) for x in have)).hexdigest()
        if stored is not None and stored != now:
            out.append(f"content_xxh128 is {now}")
        return pd.DataFrame({"path": [key[0]] * len(out), "fault": out}, dtype=object)

    found = rows.mapInPandas(run, "path string, section string, k int, digest string, faults array<string>")
    return found.groupBy("path").applyInPandas(whole, "path string, fault string")
