"""The public COLMAP interchange formats: the SQLite database, and the binary model files cameras, images, points3D, rigs and frames."""

from __future__ import annotations

import io
import os
import sqlite3
import struct
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from covista.functions.text import MOST_IMAGES

from .archives import files, write

#: Camera models by their number in the formats: name and count of parameters; fixed values.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}
_NUMBER = {name: k for k, (name, _) in MODELS.items()}
_TABLES = """
CREATE TABLE IF NOT EXISTS cameras (camera_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, model INTEGER NOT NULL, width INTEGER NOT NULL, height INTEGER NOT NULL, params BLOB, prior_focal_length INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS images (image_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, name TEXT NOT NULL UNIQUE, camera_id INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS keypoints (image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS descriptors (image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS matches (pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB);
CREATE TABLE IF NOT EXISTS two_view_geometries (pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB, config INTEGER NOT NULL, F BLOB, E BLOB, H BLOB, qvec BLOB, tvec BLOB);
"""


def _database(content: bytes, query: str) -> pd.DataFrame:
    """The rows of a query over a database that came as bytes; held in memory."""
    c = sqlite3.connect(":memory:")
    c.deserialize(content)
    try:
        return pd.read_sql_query(query, c)
    finally:
        c.close()


def scan(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of an SQLite query over each database, with its path in front; a database in a task."""

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                x = _database(c, query)
                x.insert(0, "path", p)
                yield x

    return files(spark, path).mapInPandas(run, "path string, " + schema)


def database_matches(spark: SparkSession, path: str, verified: bool = False) -> DataFrame:
    """(path, image_i, image_j, feature_i, feature_j), images by their ids from 1: all matches, or those that two-view geometry kept."""
    name = "two_view_geometries" if verified else "matches"

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                for pair, rows, data in _database(c, f"SELECT pair_id, rows, data FROM {name} WHERE rows > 0").itertuples(index=False):
                    x = np.frombuffer(data, "<u4").reshape(rows, 2).astype(np.int64)
                    j = pair % MOST_IMAGES
                    yield pd.DataFrame({"path": p, "image_i": (pair - j) // MOST_IMAGES, "image_j": j, "feature_i": x[:, 0], "feature_j": x[:, 1]})

    return files(spark, path).mapInPandas(run, "path string, image_i long, image_j long, feature_i long, feature_j long")


def _saved(spark: SparkSession, path: str, fill) -> None:
    with tempfile.TemporaryDirectory() as folder:  # SQLite needs a file of the driver's; the result goes to `path`
        at = os.path.join(folder, "database.db")
        c = sqlite3.connect(at)
        c.executescript(_TABLES)
        fill(c)
        c.commit()
        c.close()
        with open(at, "rb") as f:
            write(spark, path, f.read())


def _features(c, cameras: DataFrame, images: DataFrame, features: DataFrame) -> None:
    for r in cameras.toLocalIterator():
        c.execute("INSERT INTO cameras VALUES (?, ?, ?, ?, ?, 0)", (r["camera"], _NUMBER[r["model"]], r["width"], r["height"], np.array(r["params"], "<f8").tobytes()))
    for r in images.toLocalIterator():
        c.execute("INSERT INTO images VALUES (?, ?, ?)", (r["image"], r["name"], r["camera"]))

    def flush(image, rows):
        xy = np.array([[r["x"], r["y"], *(r["shape"] or [])] for r in rows], "<f4")
        d = np.array([r["descriptor"] for r in rows], "u1")
        c.execute("INSERT INTO keypoints VALUES (?, ?, ?, ?)", (image, *xy.shape, xy.tobytes()))
        c.execute("INSERT INTO descriptors VALUES (?, ?, ?, ?)", (image, *d.shape, d.tobytes()))

    own, rows = None, []
    for r in features.orderBy("image", "feature").toLocalIterator():
        if r["image"] != own and rows:
            flush(own, rows)
            rows = []
        own = r["image"]
        rows.append(r)
    if rows:
        flush(own, rows)


def _matches(c, matches: DataFrame) -> None:
    own, rows = None, []

    def flush():
        x = np.array(rows, "<u4")
        c.execute("INSERT INTO matches VALUES (?, ?, ?, ?)", (own, *x.shape, x.tobytes()))

    for r in matches.orderBy("image_i", "image_j", "feature_i", "feature_j").toLocalIterator():
        if not 0 < r["image_i"] < r["image_j"] < MOST_IMAGES:
            raise ValueError(f"not a pair of images: {r['image_i']}, {r['image_j']}")
        pair = r["image_i"] * MOST_IMAGES + r["image_j"]
        if pair != own and rows:
            flush()
            rows = []
        own = pair
        rows.append((r["feature_i"], r["feature_j"]))
    if rows:
        flush()


def write_database(spark: SparkSession, path: str, cameras: DataFrame, images: DataFrame, features: DataFrame, matches: DataFrame | None = None) -> None:
    """A database of cameras (camera, model, width, height, params), images (image, name, camera), features (image, feature, x, y, shape, descriptor) and matches.

    One file on one machine, so rows come to the driver image by image and pair by pair, never all at once.
    """

    def fill(c):
        _features(c, cameras, images, features)
        if matches is not None:
            _matches(c, matches)

    _saved(spark, path, fill)


def write_database_matches(spark: SparkSession, path: str, matches: DataFrame) -> None:
    """A database of matches (image_i < image_j, feature_i, feature_j) alone."""
    _saved(spark, path, lambda c: _matches(c, matches))


# Binary models.


class _Reader:
    def __init__(self, data: bytes):
        self.data = io.BytesIO(data)

    def take(self, form: str):
        raw = self.data.read(struct.calcsize("<" + form))
        return struct.unpack("<" + form, raw)

    def text(self) -> str:
        out = bytearray()
        while (c := self.data.read(1)) not in (b"\0", b""):
            out += c
        return out.decode()

    def array(self, kind: str, n: int) -> np.ndarray:
        k = np.dtype(kind)
        return np.frombuffer(self.data.read(k.itemsize * n), k)


_OBSERVED = np.dtype([("x", "<f8"), ("y", "<f8"), ("point", "<i8")])


def _cameras(r: _Reader):
    for _ in range(r.take("Q")[0]):
        i, model, w, h = r.take("iiQQ")
        name, n = MODELS[model]
        yield i, name, w, h, r.array("<f8", n).tolist()


def _images(r: _Reader):
    for _ in range(r.take("Q")[0]):
        i, *pose, camera = r.take("i7di")
        name = r.text()
        seen = r.array(_OBSERVED, r.take("Q")[0])
        yield i, pose[:4], pose[4:], camera, name, seen


def _points(r: _Reader):
    for _ in range(r.take("Q")[0]):
        i, x, y, z, red, green, blue, error = r.take("Q3d3Bd")
        track = r.array("<i4", 2 * r.take("Q")[0]).reshape(-1, 2)
        yield i, x, y, z, red, green, blue, error, track


def _read(spark: SparkSession, path: str, rows, schema: str, block: int = 4096) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            for c in f["content"]:
                out = []
                for row in rows(_Reader(c)):
                    out.append(row)
                    if len(out) == block:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    return files(spark, path).mapInPandas(run, schema)


def read_binary(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cameras, images, points, observations (image, ordinal, x, y, point or null) and tracks (point, ordinal, image, feature) of a model's folder."""

    def observations(r):
        for i, *_, seen in _images(r):
            for k, (x, y, p) in enumerate(seen.tolist()):
                yield i, k, x, y, p if p >= 0 else None

    def tracks(r):
        for i, *_, track in _points(r):
            for k, (image, feature) in enumerate(track.tolist()):
                yield i, k, image, feature

    images, points = f"{folder}/images.bin", f"{folder}/points3D.bin"
    return {
        "cameras": _read(spark, f"{folder}/cameras.bin", _cameras, "camera long, model string, width long, height long, params array<double>"),
        "images": _read(spark, images, lambda r: (x[:5] for x in _images(r)), "image long, quaternion array<double>, translation array<double>, camera long, name string"),
        "observations": _read(spark, images, observations, "image long, ordinal long, x double, y double, point long"),
        "points": _read(spark, points, lambda r: (x[:8] for x in _points(r)), "point long, x double, y double, z double, r int, g int, b int, error double"),
        "tracks": _read(spark, points, tracks, "point long, ordinal long, image long, feature long"),
    }


def write_binary(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Write what read_binary() gives. The files are one each, so their rows pass through the driver; observations and tracks must be in their tables."""
    pack = lambda form, *v: struct.pack("<" + form, *v)
    cameras = tables["cameras"].orderBy("camera").collect()
    out = [pack("Q", len(cameras))]
    for c in cameras:
        out.append(pack("iiQQ", c["camera"], _NUMBER[c["model"]], c["width"], c["height"]) + np.array(c["params"], "<f8").tobytes())
    write(spark, f"{folder}/cameras.bin", b"".join(out))

    def grouped(df, key, *order):
        own, rows = None, []
        for r in df.orderBy(key, *order).toLocalIterator():
            if rows and r[key] != own:
                yield own, rows
                rows = []
            own = r[key]
            rows.append(r)
        if rows:
            yield own, rows

    seen = {k: np.array([(r["x"], r["y"], -1 if r["point"] is None else r["point"]) for r in rows], _OBSERVED).tobytes() for k, rows in grouped(tables["observations"], "image", "ordinal")}
    images = tables["images"].orderBy("image").collect()
    out = [pack("Q", len(images))]
    for i in images:
        data = seen.get(i["image"], b"")
        out.append(pack("i7di", i["image"], *i["quaternion"], *i["translation"], i["camera"]) + i["name"].encode() + b"\0" + pack("Q", len(data) // _OBSERVED.itemsize) + data)
    write(spark, f"{folder}/images.bin", b"".join(out))
    tracks = {k: np.array([(r["image"], r["feature"]) for r in rows], "<i4").tobytes() for k, rows in grouped(tables["tracks"], "point", "ordinal")}
    points = tables["points"].orderBy("point").collect()
    out = [pack("Q", len(points))]
    for p in points:
        data = tracks.get(p["point"], b"")
        out.append(pack("Q3d3Bd", p["point"], p["x"], p["y"], p["z"], p["r"], p["g"], p["b"], p["error"]) + pack("Q", len(data) // 8) + data)
    write(spark, f"{folder}/points3D.bin", b"".join(out))


def write_ply(spark: SparkSession, path: str, points: DataFrame) -> None:
    """An ASCII PLY of finite points (x, y, z, r, g, b)."""
    rows = points.select("x", "y", "z", "r", "g", "b").collect()
    head = ["ply", "format ascii 1.0", f"element vertex {len(rows)}", *(f"property float {c}" for c in "xyz"), *(f"property uint8 {c}" for c in ("red", "green", "blue")), "end_header"]
    write(spark, path, ("\n".join([*head, *(f"{r[0]:.8g} {r[1]:.8g} {r[2]:.8g} {r[3]} {r[4]} {r[5]}" for r in rows)]) + "\n").encode())
