"""Reconstructions in archives: round trips by table, ranges and columns, older versions, and faults that are found."""

import json
import zipfile

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from covista.sources import archives, reconstruction as rec


def tables(spark, n=40):
    r = np.random.default_rng(3)
    points = [(3 * k, *map(float, r.normal(size=3)), float(k % 7 > 0), float(np.float32(0.5 + k / n)), k % 256, 1, 2, [float(np.float32(v)) for v in r.normal(size=3)]) for k in range(n)]
    images = [(10 + 2 * k, f"a/image_{k:03d}.jpg", 5 + k % 2, *map(float, r.normal(size=7)), 1.0 + k / 10) for k in range(6)]
    seen = [(3 * p, 10 + 2 * ((p + d) % 6), 7 * p + d, float(np.float32(r.normal())), 2.5) for p in range(n) for d in range(2 + p % 3)]
    return {
        "points": spark.createDataFrame(points, "point long, x double, y double, z double, w double, error double, r int, g int, b int, normals_xyz array<float>"),
        "images": spark.createDataFrame(images, "image long, name string, camera long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, focal_adjustments double"),
        "observations": spark.createDataFrame(seen, "point long, image long, feature long, u double, v double"),
        "cameras": spark.createDataFrame([(5, "PINHOLE", 1920, 1080, {"fx": 1000.0, "fy": 1000.0, "cx": 960.0, "cy": 540.0}), (6, "SIMPLE_RADIAL", 640, 480, {"f": 500.0, "k": 0.1})], "camera long, model string, width int, height int, params map<string,double>"),
    }


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "a.zip")
    digest = rec.save(spark, tables(spark), path, {"operation": "test"})
    return path, digest


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def test_round_trip_by_table(spark, archive):
    want, got = tables(spark), rec.load(spark, archive[0], rows=16)
    for t, key in (("points", "point"), ("images", "image")):
        numbers = {v: k for k, v in enumerate(sorted(r[0] for r in want[t].select(key).collect()))}
        renumbered = want[t].withColumn(key, F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col(key)])
        if t == "images":
            renumbered = renumbered.withColumn("camera", F.col("camera") - 5)
        same = [c for c in want[t].columns]
        assert rows(got[t], *same) == rows(renumbered.select(*[F.col(c).cast(got[t].schema[c].dataType) for c in same]), *same)
    assert rows(got["observations"], "point", "image", "feature", "u", "v") == rows(want["observations"].select((F.col("point") / 3).cast("long").alias("point"), ((F.col("image") - 10) / 2).cast("long").alias("image"), "feature", F.col("u").cast("float").alias("u"), F.col("v").cast("float").alias("v")), "point", "image", "feature", "u", "v")
    assert rows(got["cameras"], "model", "width", "height") == rows(want["cameras"], "model", "width", "height")
    assert rec.document(archive[0], "metadata")["operation"] == "test"


def test_scans_read_ranges_and_columns_only(spark, archive, tmp_path):
    df = rec.scan(spark, archive[0], "points", "point long, reprojection_errors float", start=5, stop=30, rows=10)
    assert df.rdd.getNumPartitions() == 3 and [r["point"] for r in df.orderBy("point").collect()] == list(range(5, 30))
    assert rec.scan(spark, [archive[0]] * 2, "images").count() == 12 and rec.scan(spark, archive[0], "sensors").count() == 0
    # an entry that isn't asked for may be broken
    broken = str(tmp_path / "b.zip")
    with zipfile.ZipFile(archive[0]) as a, zipfile.ZipFile(broken, "w") as b:
        for n in a.namelist():
            b.writestr(n, b"no frame" if "colors" in n else a.read(n))
    assert rec.scan(spark, broken, "points", "point long, reprojection_errors float").count() == 40
    assert any("colors_rgb" in r["fault"] for r in rec.verify(spark, broken).collect())
    with pytest.raises(archives.ArchiveError):
        rec.scan(spark, archive[0], "trees")


def test_saving_again_gives_the_same_digest(spark, archive, tmp_path):
    again = rec.load(spark, archive[0])
    assert rec.save(spark, again, str(tmp_path / "c.zip"), {"operation": "test"}) == archive[1]
    other = again | {"points": again["points"].withColumn("x", F.when(F.col("point") == 7, F.col("x") + 1e-9).otherwise(F.col("x")))}
    assert rec.save(spark, other, str(tmp_path / "d.zip"), {"operation": "test"}) != archive[1]


def rewritten(source, target, change):
    """A copy with entries changed by change(name, bytes) before they are compressed again."""
    with zipfile.ZipFile(source) as a, zipfile.ZipFile(target, "w") as b:
        for n in a.namelist():
            data = change(n, archives.zst_entry(a, n))
            if data is not None:
                b.writestr(n, zstandard.ZstdCompressor().compress(data))
    return str(target)


def rehashed(path):
    """The file's digests, made anew."""
    with zipfile.ZipFile(path) as z:
        parts = {s: b"".join(archives.zst_entry(z, n) for n in sorted(z.namelist()) if n.startswith(f"{s}/") or n == f"{s}.json.zst") for s in (*rec.SECTIONS, "derived")}
        kept = {n: archives.zst_entry(z, n) for n in z.namelist() if n != archives.HASHES}
    digests = {s: xxhash.xxh3_128(p).digest() for s, p in parts.items() if p}
    hashes = {f"{s}_xxh128": d.hex() for s, d in digests.items()} | {"content_xxh128": xxhash.xxh3_128(b"".join(digests[s] for s in rec.SECTIONS if s in digests)).hexdigest()}
    with zipfile.ZipFile(path, "w") as b:
        for n, data in kept.items() | {archives.HASHES: json.dumps(hashes).encode()}.items():
            b.writestr(n, zstandard.ZstdCompressor().compress(data))
    return path


def test_faults_are_found(spark, archive, tmp_path):
    assert rec.verify(spark, [archive[0]]).count() == 0
    flip = lambda n, d: bytes([d[0] ^ 1]) + d[1:] if "translations" in n else d
    said = {r["fault"].split(" is ")[0] for r in rec.verify(spark, rewritten(archive[0], tmp_path / "flip.zip", flip)).collect()}
    assert said == {"images_xxh128", "content_xxh128"}

    def nan(n, d):
        return np.where(np.arange(len(d) // 8) == 9, np.nan, np.frombuffer(d)).tobytes() if "positions_xyzw" in n else d

    def swap(n, d):
        if "point_indexes" not in n:
            return d
        x = np.frombuffer(d, "<u4").copy()
        x[[0, 30]] = x[[30, 0]]
        return x.tobytes()

    def counts(n, d):
        return json.dumps(json.loads(d) | {"point_count": 41}).encode() if n == "metadata.json.zst" else d

    for change, want in ((nan, "isn't finite"), (swap, "aren't in order"), (counts, "point_count is 41"), (lambda n, d: None if n.startswith("tracks/") else d, "no section tracks")):
        path = rehashed(rewritten(archive[0], tmp_path / "x.zip", change))
        said = [r["fault"] for r in rec.verify(spark, path).collect()]
        assert any(want in s for s in said) and not any("xxh128" in s for s in said), said
    (tmp_path / "none.zip").write_bytes(b"not an archive")
    assert rec.verify(spark, str(tmp_path / "none.zip")).count() > 0


def test_what_does_not_fit_is_refused(spark, tmp_path):
    t = tables(spark)
    with pytest.raises(archives.ArchiveError, match="1 points without"):
        rec.save(spark, t | {"observations": t["observations"].where("point <> 6")}, str(tmp_path / "e.zip"))
    with pytest.raises(archives.ArchiveError, match="that aren't there"):
        rec.save(spark, t | {"images": t["images"].where("image <> 10")}, str(tmp_path / "e.zip"))
    assert not list(tmp_path.iterdir())


def test_older_versions(spark, archive, tmp_path):
    """Version 1: positions of three numbers, other names and axes."""

    def old(n, d):
        if n == "metadata.json.zst":
            return json.dumps(json.loads(d) | {"version": 1}).encode()
        return d

    path = rewritten(archive[0], tmp_path / "old.zip", old)
    with zipfile.ZipFile(path) as z:
        kept = {n: archives.zst_entry(z, n) for n in z.namelist()}
    n = next(k for k in kept if "positions_xyzw" in k)
    kept["points3d/positions_xyz.40.3.float64.zst"] = np.frombuffer(kept.pop(n)).reshape(-1, 4)[:, :3].tobytes()
    n = next(k for k in kept if "normals_xyz" in k)
    kept[n.replace("normals_xyz", "estimated_normals_xyz")] = kept.pop(n)
    n = next(k for k in kept if "point_indexes" in k)
    kept[n.replace("point_indexes", "points3d_indexes")] = kept.pop(n)
    with zipfile.ZipFile(path, "w") as b:
        for n, data in kept.items():
            b.writestr(n, zstandard.ZstdCompressor().compress(data))
    now, then = rec.load(spark, archive[0]), rec.load(spark, path)
    a, b = ({r["point"]: r for r in t["points"].collect()} for t in (now, then))
    assert all((b[k]["x"], b[k]["y"], b[k]["z"], b[k]["w"]) == (r["x"], r["z"], -r["y"], 1.0) and b[k]["normals_xyz"] == [r["normals_xyz"][0], r["normals_xyz"][2], -r["normals_xyz"][1]] for k, r in a.items())
    # what a camera sees stays the same, but for its own axes
    rot = lambda q: np.array([[1 - 2 * (q[2] ** 2 + q[3] ** 2), 2 * (q[1] * q[2] - q[0] * q[3]), 2 * (q[1] * q[3] + q[0] * q[2])], [2 * (q[1] * q[2] + q[0] * q[3]), 1 - 2 * (q[1] ** 2 + q[3] ** 2), 2 * (q[2] * q[3] - q[0] * q[1])], [2 * (q[1] * q[3] - q[0] * q[2]), 2 * (q[2] * q[3] + q[0] * q[1]), 1 - 2 * (q[1] ** 2 + q[2] ** 2)]])
    p, q = a[1], b[1]
    for i, j in zip(now["images"].orderBy("image").collect(), then["images"].orderBy("image").collect(), strict=True):
        size = np.linalg.norm([i["qw"], i["qx"], i["qy"], i["qz"]])
        old_q, new_q = (np.array([r["qw"], r["qx"], r["qy"], r["qz"]]) / size for r in (i, j))
        before = rot(old_q) @ [p["x"], p["y"], p["z"]] + [i["tx"], i["ty"], i["tz"]]
        after = rot(new_q) @ [q["x"], q["y"], q["z"]] + [j["tx"], j["ty"], j["tz"]]
        assert np.allclose(before * [1, -1, -1], after)


def test_normals_that_follow_from_patch_frames(spark, archive, tmp_path):
    """Version 16: normals of the patch frames; those of points without a frame are stored, in order."""
    with zipfile.ZipFile(archive[0]) as z:
        kept = {n: archives.zst_entry(z, n) for n in z.namelist() if "normals_xyz" not in n}
    r = np.random.default_rng(5)
    u, v = r.normal(size=(2, 40, 3)).astype("<f4")
    w = np.frombuffer(next(d for n, d in kept.items() if "positions_xyzw" in n)).reshape(-1, 4)[:, 3]
    u[[3, 8, 14]] = 0
    bare = [k for k in (3, 8, 14) if w[k] != 0]
    stored = r.normal(size=(len(bare), 3)).astype("<f4")
    kept |= {"points3d/patch_u_halfvec_xyz.40.3.float32.zst": u.tobytes(), "points3d/patch_v_halfvec_xyz.40.3.float32.zst": v.tobytes(), f"points3d/underived_normals_xyz.{len(bare)}.3.float32.zst": stored.tobytes()}
    kept["metadata.json.zst"] = json.dumps(json.loads(kept["metadata.json.zst"]) | {"version": 16}).encode()
    path = str(tmp_path / "new.zip")
    with zipfile.ZipFile(path, "w") as b:
        for n, data in kept.items():
            b.writestr(n, zstandard.ZstdCompressor().compress(data))
    got = {x["point"]: x["normals_xyz"] for x in rec.load(spark, path)["points"].collect()}
    want = np.cross(u, v)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-30)
    want[bare] = stored
    assert all(got[k] is None if w[k] == 0 and k in (3, 8, 14) else np.allclose(got[k], want[k], atol=1e-5) for k in range(40))


def sent_to_driver(spark):
    """Bytes of all tasks' results so far."""
    sc = spark.sparkContext
    jvm = sc._gateway.jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).resultSize() for k in range(stages.size())}


def many(spark, points=3000, images=200):
    zero, one = F.lit(0.0), F.lit(1.0)
    seen = spark.range(points).withColumnRenamed("id", "point").crossJoin(spark.range(images).withColumnRenamed("id", "image"))
    return {
        "points": spark.range(points).select(F.col("id").alias("point"), *[one.alias(c) for c in ("x", "y", "z", "w", "error")]),
        "images": spark.range(images).select(F.col("id").alias("image"), F.format_string("%05d.jpg", "id").alias("name"), F.lit(0).alias("camera"), *[one.alias(c) for c in ("qw", "tx", "ty", "tz")], *[zero.alias(c) for c in ("qx", "qy", "qz")]),
        "observations": seen.withColumns({"feature": F.xxhash64("point", "image").bitwiseAND(F.lit((1 << 31) - 1)), "u": F.rand(1), "v": F.rand(2)}),
        "cameras": spark.createDataFrame([(0, "PINHOLE", 1, 1, {"fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0})], "camera long, model string, width int, height int, params map<string,double>"),
    }


def test_rows_are_not_written_through_the_driver(spark, tmp_path):
    t, before = many(spark), set(sent_to_driver(spark))
    path = str(tmp_path / "many.zip")
    rec.save(spark, t, path)
    sent = sum(n for k, n in sent_to_driver(spark).items() if k not in before)
    assert 0 < sent < 2 << 20 and rec.document(path, "metadata")["observation_count"] == 600_000
    assert rec.verify(spark, path).count() == 0 and [p.name for p in tmp_path.glob("many*")] == ["many.zip"]


def test_an_archive_without_rows(spark, tmp_path):
    t, path = tables(spark), str(tmp_path / "none.zip")
    rec.save(spark, {k: d if k == "cameras" else d.where("false") for k, d in t.items()}, path)
    assert rec.load(spark, path)["points"].count() == 0 and rec.document(path, "images/names") == []
