"""Archives, databases and binary models: what is written comes back, and what is changed is found."""

import io
import zipfile

import numpy as np
import pytest

from covista.sources import archives, bundle, colmap


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_feature_files(spark, tmp_path):
    r = np.random.default_rng(1)
    xy, shapes, d, thumb = r.normal(size=(9, 2)), r.normal(size=(9, 2, 2)), r.integers(0, 256, (9, 128)), r.integers(0, 256, (128, 128, 3))
    path = f"{tmp_path}/a.sift"
    archives.write_sift(spark, path, {"tool": "x"}, {"version": 2, "image_name": "a.jpg"}, xy, shapes, d, thumb)
    assert archives.verify(spark, path, "sift").collect() == []
    got = archives.sift_features(spark, path).orderBy("row").toPandas()
    assert np.allclose(np.stack(got["positions_xy"]), xy.astype("f4")) and np.allclose(np.stack(got["affine_shapes"]), shapes.reshape(9, 4).astype("f4"))
    assert (np.stack(got["descriptors"]) == d).all()
    assert archives.sift_positions(spark, path, 3).count() == 3 and archives.sift_keypoints(spark, path).columns[2:] == ["positions_xy", "affine_shapes"]
    assert archives.sift_positions_descriptors(spark, path).count() == 9
    assert bytes(archives.sift_thumbnails(spark, path).first()["thumbnail"]) == thumb.astype("u1").tobytes()
    assert '"feature_count":9' in archives.sift_metadata(spark, path).first()["json"]
    assert {x["entry"]: x["shape"] for x in archives.inventory(spark, path).collect()}["features/descriptors.9.128.uint8.zst"] == [9, 128]
    data, out = open(path, "rb").read(), io.BytesIO()
    import zstandard

    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, zstandard.compress(b"{}") if n == "feature_tool_metadata.json.zst" else a.read(n))
    (tmp_path / "b.sift").write_bytes(out.getvalue())
    (tmp_path / "c.sift").write_bytes(b"no archive")
    found = rows(archives.verify(spark, f"{tmp_path}/[bc].sift", "sift"))
    assert [f.split()[0] for p, f in found if "b.sift" in p] == ["content_xxh128", "feature_tool_xxh128"] and any("c.sift" in p for p, _ in found)
    with pytest.raises(archives.ArchiveError):
        archives.write_sift(spark, path, {}, {}, xy, shapes[:3], d, thumb)


def test_match_files_and_rigs(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 5, 6, 0.5), (0, 1, 1, 2, 0.25), (1, 2, 3, 3, 1.0)], "image_i long, image_j long, feature_i long, feature_j long, distance double")
    archives.write_matches(spark, f"{tmp_path}/p.matches", ["a", "b", "c"], m)
    assert rows(archives.matches_pairs(spark, f"{tmp_path}/p.matches").drop("path", "pair")) == rows(m)
    c = spark.createDataFrame([(7, 0, 1), (7, 2, 4), (9, 1, 1), (9, 2, 2)], "cluster long, image long, feature long")
    archives.write_cluster_matches(spark, f"{tmp_path}/c.matches", ["a", "b", "c"], c)
    assert rows(archives.matches_clusters(spark, f"{tmp_path}/c.matches").drop("path")) == [(0, 0, 0, 1), (0, 1, 2, 4), (1, 0, 1, 1), (1, 1, 2, 2)]
    assert [x["name"] for x in archives.matches_image_names(spark, f"{tmp_path}/c.matches").orderBy("image").collect()] == ["a", "b", "c"]
    assert archives.verify(spark, f"{tmp_path}/*.matches", "matches").collect() == [] and archives.matches_metadata(spark, f"{tmp_path}/c.matches").count() == 1
    archives.write_camrig(spark, f"{tmp_path}/r.camrig", {"version": 1}, [{"model": "PINHOLE"}], ["l/%04d.jpg", "r/%04d.jpg"], [0, 0], [[1, 0, 0, 0]] * 2, [[0, 0, 0], [1, 0, 0]])
    assert archives.verify(spark, f"{tmp_path}/r.camrig", "camrig").collect() == []
    assert rows(archives.camrig_sensors(spark, f"{tmp_path}/r.camrig").select("row", "translations_xyz")) == [(0, [0, 0, 0]), (1, [1, 0, 0])]


def test_databases(spark, tmp_path):
    cameras = spark.createDataFrame([(1, "PINHOLE", 640, 480, [500.0, 500.0, 320.0, 240.0])], "camera long, model string, width long, height long, params array<double>")
    images = spark.createDataFrame([(1, "a.jpg", 1), (2, "b.jpg", 1)], "image long, name string, camera long")
    features = spark.createDataFrame([(i, k, k + 0.5, 2.0 * k, [1.0, 0.0, 0.0, 1.0], [k] * 128) for i in (1, 2) for k in range(3)], "image long, feature long, x double, y double, shape array<double>, descriptor array<int>")
    m = spark.createDataFrame([(1, 2, 0, 1), (1, 2, 2, 0)], "image_i long, image_j long, feature_i long, feature_j long")
    path = f"{tmp_path}/d.db"
    colmap.write_database(spark, path, cameras, images, features, m)
    assert rows(colmap.database_matches(spark, path).drop("path")) == rows(m) and colmap.database_matches(spark, path, verified=True).count() == 0
    assert rows(colmap.scan(spark, path, "SELECT image_id AS image, rows AS n, cols AS width FROM keypoints", "image long, n long, width long").drop("path")) == [(1, 3, 6), (2, 3, 6)]
    colmap.write_database_matches(spark, f"{tmp_path}/m.db", m)
    assert colmap.database_matches(spark, f"{tmp_path}/m.db").count() == 2
    with pytest.raises(ValueError):
        colmap.write_database_matches(spark, path, m.selectExpr("image_j image_i", "image_i image_j", "feature_i", "feature_j"))


def test_binary_models(spark, tmp_path):
    t = {
        "cameras": spark.createDataFrame([(1, "SIMPLE_RADIAL", 640, 480, [500.0, 320.0, 240.0, 0.1])], "camera long, model string, width long, height long, params array<double>"),
        "images": spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1, "ä.jpg"), (4, [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "b")], "image long, quaternion array<double>, translation array<double>, camera long, name string"),
        "observations": spark.createDataFrame([(3, 0, 1.5, 2.5, 7), (3, 1, 0.0, 0.0, None)], "image long, ordinal long, x double, y double, point long"),
        "points": spark.createDataFrame([(7, 1.0, 2.0, 3.0, 10, 20, 255, 0.5), (8, 0.0, 0.0, 0.0, 0, 0, 0, 0.0)], "point long, x double, y double, z double, r int, g int, b int, error double"),
        "tracks": spark.createDataFrame([(7, 0, 3, 0)], "point long, ordinal long, image long, feature long"),
    }
    colmap.write_binary(spark, str(tmp_path), t)
    got = colmap.read_binary(spark, str(tmp_path))
    for name, df in t.items():
        assert sorted(map(str, got[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    colmap.write_ply(spark, f"{tmp_path}/p.ply", t["points"])
    assert open(f"{tmp_path}/p.ply").read().splitlines()[-2:] == ["1 2 3 10 20 255", "0 0 0 0 0 0"]


def test_bundles(spark, tmp_path):
    t = {"a": spark.createDataFrame([(None, 1), (1, None)], "x long, y long"), "b": spark.createDataFrame([(1, None), (1, 1)], "x long, y long")}
    bundle.save(t, str(tmp_path))
    back = bundle.load(spark, str(tmp_path), "a", "b")
    assert rows(back["b"].na.fill(-1)) == [(1, -1), (1, 1)] and back["a"].columns == ["x", "y"]
    assert bundle.digest(back["a"]).first() == bundle.digest(t["a"]).first()
    one, two = (spark.createDataFrame([r], "x long, y long") for r in ((None, 1), (1, None)))
    assert bundle.digest(one).first()["digest"] != bundle.digest(two).first()["digest"]
