"""Column archives: ZIP files of stored entries, each one zstandard frame of compact JSON or of a little-endian array.

An entry of an array is named name.<shape>.<type>.zst, so an archive describes itself. Digests are XXH128 of the uncompressed
bytes; content_hash.json.zst holds them by section, and one of all sections' digests (16 bytes each, big-endian) in order.
Files are read by Spark's binaryFile source, a file in a task, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types by their name in an entry; uint128 are raw digests of 16 bytes.
TYPES = {"int8": "i1", "int16": "<i2", "float16": "<f2", "uint8": "u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8", "uint128": "V16"}
_ARRAY = re.compile(rf"(.+?)((?:\.\d+)*)\.({'|'.join(TYPES)})\.zst")
HASHES = "content_hash.json.zst"
#: The sections of each format in the order of their digests, after which entries they have; a name ending in / is a folder,
#: whose entries are hashed one after the other in the order of their names. Fixed values of the formats.
SECTIONS = {
    "sift": ("feature_tool_metadata.json.zst", "metadata.json.zst", "features/positions_xy.", "features/affine_shapes.", "features/descriptors.", "thumbnail_y_x_rgb."),
    "camrig": ("metadata.json.zst", "cameras/metadata.json.zst", "sensors/image_file_patterns.json.zst", "sensors/camera_indexes.", "sensors/quaternions_wxyz.", "sensors/translations_xyz."),
    "matches": ("metadata.json.zst", "images/", "image_pairs/", "clusters/", "cluster_patches/", "two_view_geometries/"),
}


class ArchiveError(ValueError):
    """What is wrong with an archive, and in which entry."""


def _xxh128(*parts: bytes) -> bytes:
    import xxhash

    h = xxhash.xxh3_128()
    for p in parts:
        h.update(p)
    return h.digest()


def zst_entry(archive: zipfile.ZipFile, name: str) -> bytes:
    """The uncompressed bytes of an entry."""
    import zstandard

    try:
        raw = archive.read(name)
    except KeyError:
        raise ArchiveError(f"no entry {name}") from None
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    except zstandard.ZstdError as e:
        raise ArchiveError(f"{name}: {e}") from None


def json_entry(archive: zipfile.ZipFile, name: str):
    return json.loads(zst_entry(archive, name))


def array_entry(archive: zipfile.ZipFile, name: str, rows: int | None = None) -> np.ndarray:
    """An array in the shape that its name tells, its first rows only where given; digests are rows of 16 bytes."""
    if not (m := _ARRAY.fullmatch(name)):
        raise ArchiveError(f"{name} isn't named as an array")
    shape = tuple(int(x) for x in m[2].split(".") if x)
    data, kind = zst_entry(archive, name), np.dtype(TYPES[m[3]])
    if len(data) != int(np.prod(shape)) * kind.itemsize:
        raise ArchiveError(f"{name} has {len(data)} bytes")
    out = np.frombuffer(data, kind).reshape(shape)
    return out if rows is None else out[:rows]


def found(archive: zipfile.ZipFile, start: str) -> str | None:
    """The name of the entry that begins so, if there is one."""
    return next((n for n in archive.namelist() if n.startswith(start)), None)


def column(archive: zipfile.ZipFile, start: str, rows: int | None = None) -> np.ndarray:
    name = found(archive, start + ".")
    if name is None:
        raise ArchiveError(f"no entry {start}")
    return array_entry(archive, name, rows)


def section_digests(archive: zipfile.ZipFile, kind: str) -> list[tuple[str, bytes]]:
    """(section, digest) of the sections that are there, in order."""
    out = []
    for section in SECTIONS[kind]:
        names = sorted(n for n in archive.namelist() if n.startswith(section)) if section.endswith("/") else [n for n in [found(archive, section)] if n]
        if names:
            out.append((section.strip("/.").removesuffix(".json.zst"), _xxh128(*[zst_entry(archive, n) for n in names])))
    return out


def packed(kind: str, documents: Mapping[str, object], arrays: Mapping[str, np.ndarray], level: int = 5) -> bytes:
    """The bytes of an archive of documents (JSON by name) and arrays (by name without shape and type), with its digests."""
    import zstandard

    entries = {f"{n}.json.zst": json.dumps(d, separators=(",", ":"), ensure_ascii=False).encode() for n, d in documents.items()}
    names = {np.dtype(v): k for k, v in TYPES.items()}
    for n, a in arrays.items():
        a = np.ascontiguousarray(a)
        a = a.astype(a.dtype.newbyteorder("<")) if a.dtype.kind != "V" else a
        entries[f"{n}.{'.'.join(map(str, a.shape))}.{names[a.dtype]}.zst"] = a.tobytes()
    out, compress = io.BytesIO(), zstandard.ZstdCompressor(level=level).compress
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, data in entries.items():
            z.writestr(n, compress(data))
    with zipfile.ZipFile(out, "a", zipfile.ZIP_STORED) as z:
        digests = section_digests(z, kind)
        hashes = {f"{s.split('/')[-1] if kind != 'camrig' else s}_xxh128": d.hex() for s, d in digests if kind == "matches" or s in ("metadata", "feature_tool_metadata")}
        hashes = {k.replace("feature_tool_metadata", "feature_tool"): v for k, v in hashes.items()}
        z.writestr(HASHES, compress(json.dumps(hashes | {"content_xxh128": _xxh128(*[d for _, d in digests]).hex()}, separators=(",", ":")).encode()))
    return out.getvalue()


def faults(data: bytes, kind: str) -> list[str]:
    """What doesn't fit in an archive: bytes that can't be read, shapes, digests, counts."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out, stored = [], json_entry(z, HASHES)
            digests = section_digests(z, kind)
            for s, d in digests:
                key = {"feature_tool_metadata": "feature_tool"}.get(s, s) + "_xxh128"
                if key in stored and stored[key] is not None and stored[key] != d.hex():
                    out.append(f"{key} is {d.hex()}")
            whole = _xxh128(*[d for _, d in digests]).hex()
            if stored.get("content_xxh128") != whole:
                out.append(f"content_xxh128 is {whole}")
            sizes: dict[str, set[int]] = {}
            for n in z.namelist():
                if _ARRAY.fullmatch(n):
                    array_entry(z, n)
            if kind == "sift":
                count = json_entry(z, "metadata.json.zst").get("feature_count")
                sizes = {n: {len(column(z, f"features/{n}")), count} for n in ("positions_xy", "affine_shapes", "descriptors")}
            if kind == "camrig":
                sizes = {"sensors": {len(column(z, f"sensors/{n}")) for n in ("camera_indexes", "quaternions_wxyz", "translations_xyz")}}
            if kind == "matches" and found(z, "clusters/cluster_starts."):
                starts = column(z, "clusters/cluster_starts")
                sizes = {"members": {int(starts[-1]), len(column(z, "clusters/member_images")), len(column(z, "clusters/member_features"))}}
                if (np.diff(starts.astype(np.int64)) < 0).any():
                    out.append("cluster_starts descend")
            return out + [f"{n}: counts {sorted(map(str, c))} differ" for n, c in sizes.items() if len(c) > 1]
    except (ArchiveError, zipfile.BadZipFile, json.JSONDecodeError, UnicodeDecodeError) as e:
        return [str(e)]


# Spark's side.


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file by Hadoop's file systems: under another name first, so that a reader never sees half of it."""
    jvm = spark.sparkContext._jvm
    end, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    fs = end.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(data)
    out.close()
    fs.delete(end, False)
    if not fs.rename(part, end):
        raise OSError(f"can't write {path}")


def verify(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """(path, fault): all faults of the archives; an archive without any has no row."""

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            rows = [(p, x) for p, c in zip(f["path"], f["content"], strict=True) for x in faults(c, kind)]
            yield pd.DataFrame(rows, columns=["path", "fault"])

    return files(spark, paths).mapInPandas(run, "path string, fault string")


def inventory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, entry, shape, type, bytes, xxh128) of every entry."""

    def run(frames):
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for n in z.namelist():
                        m, data = _ARRAY.fullmatch(n), zst_entry(z, n)
                        rows.append((p, n, [int(x) for x in m[2].split(".") if x] if m else None, m[3] if m else "json", len(data), _xxh128(data).hex()))
            yield pd.DataFrame(rows, columns=["path", "entry", "shape", "type", "bytes", "xxh128"])

    return files(spark, paths).mapInPandas(run, "path string, entry string, shape array<int>, type string, bytes long, xxh128 string")


def documents(spark: SparkSession, paths: str | list[str], name: str) -> DataFrame:
    """(path, json): a JSON entry of each archive as text, null where there is none."""

    def run(frames):
        for f in frames:
            out = []
            for c in f["content"]:
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    out.append(zst_entry(z, name).decode() if name in z.namelist() else None)
            yield pd.DataFrame({"path": f["path"], "json": out})

    return files(spark, paths).mapInPandas(run, "path string, json string")


def columns(spark: SparkSession, paths: str | list[str], folder: str, names: Mapping[str, str], rows: int | None = None) -> DataFrame:
    """(path, row, columns...): the arrays of a folder side by side, one row for each of their first index.

    names are the columns with their Spark types; only these entries are decompressed, and rows limits how many are given.
    """

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    data = {n: column(z, f"{folder}/{n}", rows) for n in names}
                n = len(next(iter(data.values())))
                for at in range(0, n, 4096):
                    part = {k: v[at : at + 4096] for k, v in data.items()}
                    flat = {k: [x.tobytes() for x in v] if v.dtype.kind == "V" else v.reshape(len(v), -1).tolist() if v.ndim > 1 else v for k, v in part.items()}
                    yield pd.DataFrame({"path": p, "row": np.arange(at, at + len(next(iter(part.values()))))} | flat)

    return files(spark, paths).mapInPandas(run, "path string, row long, " + ", ".join(f"{k} {v}" for k, v in names.items()))


# Feature files.

_POSITIONS, _SHAPES, _DESCRIPTORS = {"positions_xy": "array<float>"}, {"affine_shapes": "array<float>"}, {"descriptors": "array<short>"}


def sift_metadata(spark: SparkSession, paths) -> DataFrame:
    return documents(spark, paths, "metadata.json.zst")


def sift_features(spark: SparkSession, paths, rows: int | None = None) -> DataFrame:
    """(path, row, positions_xy, affine_shapes, descriptors); of the first rows where given: features are stored largest first."""
    return columns(spark, paths, "features", _POSITIONS | _SHAPES | _DESCRIPTORS, rows)


def sift_positions(spark: SparkSession, paths, rows: int | None = None) -> DataFrame:
    return columns(spark, paths, "features", _POSITIONS, rows)


def sift_positions_descriptors(spark: SparkSession, paths, rows: int | None = None) -> DataFrame:
    return columns(spark, paths, "features", _POSITIONS | _DESCRIPTORS, rows)


def sift_keypoints(spark: SparkSession, paths, rows: int | None = None) -> DataFrame:
    return columns(spark, paths, "features", _POSITIONS | _SHAPES, rows)


def sift_thumbnails(spark: SparkSession, paths) -> DataFrame:
    """(path, thumbnail): 128 x 128 pixels of 3 bytes, row by row."""

    def run(frames):
        for f in frames:
            out = []
            for c in f["content"]:
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    out.append(column(z, "thumbnail_y_x_rgb").tobytes())
            yield pd.DataFrame({"path": f["path"], "thumbnail": out})

    return files(spark, paths).mapInPandas(run, "path string, thumbnail binary")


def write_sift(spark: SparkSession, path: str, tool: dict, metadata: dict, positions: np.ndarray, shapes: np.ndarray, descriptors: np.ndarray, thumbnail: np.ndarray) -> None:
    """One feature file; its count of features is taken from the arrays, which must agree."""
    n = len(positions)
    if not len(shapes) == len(descriptors) == n:
        raise ArchiveError("positions, shapes and descriptors differ in number")
    arrays = {"features/positions_xy": positions.astype("<f4"), "features/affine_shapes": shapes.astype("<f4"), "features/descriptors": descriptors.astype("u1"), "thumbnail_y_x_rgb": thumbnail.astype("u1")}
    write(spark, path, packed("sift", {"feature_tool_metadata": tool, "metadata": metadata | {"feature_count": n}}, arrays))


# Match files.


def matches_metadata(spark: SparkSession, paths) -> DataFrame:
    return documents(spark, paths, "metadata.json.zst")


def matches_image_names(spark: SparkSession, paths) -> DataFrame:
    """(path, image, name)."""
    x = documents(spark, paths, "images/names.json.zst").select("path", F.posexplode(F.from_json("json", "array<string>")).alias("image", "name"))
    return x


def matches_clusters(spark: SparkSession, paths) -> DataFrame:
    """(path, cluster, ordinal, image, feature): one row for each member of a cluster."""

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    if found(z, "clusters/cluster_starts.") is None:
                        continue
                    starts, images, features = (column(z, f"clusters/{n}").astype(np.int64) for n in ("cluster_starts", "member_images", "member_features"))
                size = np.diff(starts)
                own = np.repeat(np.arange(len(size)), size)
                yield pd.DataFrame({"path": p, "cluster": own, "ordinal": np.arange(len(own)) - np.repeat(starts[:-1], size), "image": images, "feature": features})

    return files(spark, paths).mapInPandas(run, "path string, cluster long, ordinal long, image long, feature long")


def matches_pairs(spark: SparkSession, paths) -> DataFrame:
    """(path, pair, image_i, image_j, feature_i, feature_j, distance): one row for each match."""

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    if found(z, "image_pairs/image_index_pairs.") is None:
                        continue
                    pairs, counts, features, far = (column(z, f"image_pairs/{n}") for n in ("image_index_pairs", "match_counts", "match_feature_indexes", "match_descriptor_distances"))
                own = np.repeat(np.arange(len(pairs)), counts)
                yield pd.DataFrame({"path": p, "pair": own, "image_i": pairs[own, 0], "image_j": pairs[own, 1], "feature_i": features[:, 0], "feature_j": features[:, 1], "distance": far})

    return files(spark, paths).mapInPandas(run, "path string, pair long, image_i long, image_j long, feature_i long, feature_j long, distance float")


def _match_documents(names: list[str], metadata: dict) -> dict[str, object]:
    return {"metadata": metadata, "images/metadata": {"image_count": len(names)}, "images/names": names}


def write_matches(spark: SparkSession, path: str, names: list[str], matches: DataFrame, metadata: dict | None = None) -> None:
    """One file of pair matches (image_i, image_j, feature_i, feature_j, distance), pairs in order; a file holds what fits one machine."""
    m = matches.orderBy("image_i", "image_j", "feature_i", "feature_j").toPandas()
    pairs, counts = np.unique(m[["image_i", "image_j"]].to_numpy(np.int64), axis=0, return_counts=True) if len(m) else (np.empty((0, 2)), np.empty(0))
    arrays = {"image_pairs/image_index_pairs": pairs.astype("<u4"), "image_pairs/match_counts": counts.astype("<u4"), "image_pairs/match_feature_indexes": m[["feature_i", "feature_j"]].to_numpy().astype("<u4"), "image_pairs/match_descriptor_distances": m["distance"].to_numpy().astype("<f4")}
    meta = _match_documents(names, metadata or {}) | {"image_pairs/metadata": {"pair_count": len(pairs), "match_count": len(m)}}
    write(spark, path, packed("matches", meta, arrays))


def write_cluster_matches(spark: SparkSession, path: str, names: list[str], members: DataFrame, metadata: dict | None = None) -> None:
    """One file of clusters (cluster, image, feature), numbered anew in their order, members by image."""
    m = members.orderBy("cluster", "image", "feature").toPandas()
    _, counts = np.unique(m["cluster"].to_numpy(), return_counts=True)
    arrays = {"clusters/cluster_starts": np.concatenate(([0], np.cumsum(counts))).astype("<u4"), "clusters/member_images": m["image"].to_numpy().astype("<u4"), "clusters/member_features": m["feature"].to_numpy().astype("<u4")}
    meta = _match_documents(names, metadata or {}) | {"clusters/metadata": {"cluster_count": len(counts), "member_count": len(m)}}
    write(spark, path, packed("matches", meta, arrays))


# Camera rigs.


def camrig_sensors(spark: SparkSession, paths) -> DataFrame:
    """(path, row, camera_indexes, quaternions_wxyz, translations_xyz) of each sensor."""
    return columns(spark, paths, "sensors", {"camera_indexes": "long", "quaternions_wxyz": "array<double>", "translations_xyz": "array<double>"})


def write_camrig(spark: SparkSession, path: str, metadata: dict, cameras: list[dict], patterns: list[str], camera_indexes, quaternions, translations) -> None:
    n = len(patterns)
    if not len(camera_indexes) == len(quaternions) == len(translations) == n:
        raise ArchiveError("a rig has a pattern, a camera, a rotation and a translation for each sensor")
    arrays = {"sensors/camera_indexes": np.asarray(camera_indexes, "<u4"), "sensors/quaternions_wxyz": np.asarray(quaternions, "<f8").reshape(n, 4), "sensors/translations_xyz": np.asarray(translations, "<f8").reshape(n, 3)}
    write(spark, path, packed("camrig", {"metadata": metadata, "cameras/metadata": {"cameras": cameras}, "sensors/image_file_patterns": patterns}, arrays))
