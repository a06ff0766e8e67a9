"""The commands over a small reconstruction, and lookups in coverage grids."""

import json

import numpy as np
import pytest

from covista import cli
from covista.operators import aggregates, coverage
from covista.sources import bundle


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("demo"))
    rows = [(k, f"a_{k:03d}.jpg", 0, float(np.cos(k * 0.1)), 0.0, float(np.sin(k * 0.1)), 0.0, 0.1 * k, 0.2 * k * k, 5.0) for k in range(6)]
    bundle.save({
        "images": spark.createDataFrame(rows, "image long, name string, camera long, qw double, qx double, qy double, qz double, tx double, ty double, tz double"),
        "points": spark.createDataFrame([(k, float(np.cos(k)), float(np.sin(k)), 0.1 * k, 1.0, 0.5) for k in range(10)], "point long, x double, y double, z double, w double, error double"),
        "observations": spark.createDataFrame([(p, (p + d) % 6, p) for p in range(10) for d in range(3)], "point long, image long, feature long"),
        "cameras": spark.createDataFrame([(0, "PINHOLE", {"fx": 1000.0, "fy": 1000.0, "cx": 960.0, "cy": 540.0})], "camera long, model string, params map<string,double>"),
    }, at)
    return at


def lines(capsys, *args):
    cli.main(list(args))
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_reports(spark, folder, capsys):
    assert len(lines(capsys, "analyze", "metrics", folder)) == 6 and lines(capsys, "analyze", "covisibility", folder)[0]["shared"] >= 1
    assert lines(capsys, "analyze", "images", folder)[0]["hops"] == 0 and len(lines(capsys, "analyze", "depth", folder, "--rows", "2")) == 2
    assert len(lines(capsys, "inspect", folder)) == 7 and len(lines(capsys, "inspect", folder, "--point", "3")) == 3
    cli.main(["version"])
    assert capsys.readouterr().out.strip() == cli.VERSION


def test_chain_and_formats(spark, folder, tmp_path, capsys):
    cli.main(["xform", folder, f"{tmp_path}/x", "--step", "scale=2", "--step", "remove-short-tracks=1"])
    cli.main(["align", f"{tmp_path}/x", folder, f"{tmp_path}/y"])
    capsys.readouterr()
    assert max(r["distance"] for r in lines(capsys, "compare", f"{tmp_path}/y", folder) if "distance" in r) < 1e-6
    cli.main(["merge", f"{tmp_path}/m", folder, folder])
    assert {n: spark.read.parquet(f"{tmp_path}/m/{n}").count() for n in ("images", "points", "observations")} == {"images": 6, "points": 10, "observations": 30}
    cli.main(["to-colmap-bin", folder, f"{tmp_path}/bin"])
    cli.main(["from-colmap-bin", f"{tmp_path}/bin", f"{tmp_path}/z"])
    back = bundle.load(spark, f"{tmp_path}/z", *cli.TABLES)
    assert back["observations"].count() == 30 and back["cameras"].first()["params"]["fx"] == 1000
    assert max(r["distance"] for r in lines(capsys, "compare", f"{tmp_path}/z", folder) if "distance" in r) < 1e-9
    cli.main(["to-nerfstudio", folder, f"{tmp_path}/n"])
    assert len(json.load(open(f"{tmp_path}/n/transforms.json"))["frames"]) == 6
    with pytest.raises(SystemExit):
        cli.main(["xform", folder, f"{tmp_path}/w", "--step", "nothing"])


def test_coverage_lookups(spark):
    seen = spark.createDataFrame([(0, 50.0, 50.0), (0, 20.0, 80.0)], "image int, x double, y double")
    grid = aggregates.coverage_grid(seen, "image", "x", "y", 12.0, 4.0, 100, 100).cache()
    covered = {(r["cx"], r["cy"]): r["n"] for r in grid.collect()}
    at = spark.createDataFrame([(0, 0, 50.0, 50.0, 20.0), (1, 0, 1.0, 1.0, 6.0), (2, 0, 50.0, 50.0, 0.5), (3, 0, 300.0, 0.0, 5.0)], "row int, image int, x double, y double, radius double")
    assert [r["n"] for r in coverage.counts_at(grid, at, 4.0).orderBy("row").collect()] == [covered[12, 12], 0, covered[12, 12], 0]
    want = []
    for _, _, x, y, r in at.collect():
        cells = [(a, b) for a in range(25) for b in range(25) if ((a + 0.5) * 4 - x) ** 2 + ((b + 0.5) * 4 - y) ** 2 <= r * r]
        free = {int(np.arctan2((b + 0.5) * 4 - y, (a + 0.5) * 4 - x) % (2 * np.pi) / (2 * np.pi) * 8) for a, b in cells if (a, b) not in covered}
        want.append((sum(c in covered for c in cells) / len(cells) if cells else 0, sum(1 << k for k in free)))
    assert np.allclose([r["share"] for r in coverage.covered_fraction(grid, at, 4.0, 100, 100).orderBy("row").collect()], [w for w, _ in want])
    assert [r["mask"] for r in coverage.uncovered_sectors(grid, at, 4.0, 100, 100, 8).orderBy("row").collect()] == [w for _, w in want]
    assert abs(coverage.image_covered_fraction(grid, 4.0, 100, 100).first()["share"] - len(covered) / 625) < 1e-12
    m = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 0, True), (1, 1, False), (2, 0, True)], "cluster int, image int, satisfied boolean")
    got = coverage.bridging_clusters(m, spark.createDataFrame([(0, 0), (1, 1)], "image int, grp int")).first()
    assert (got["satisfied"], got["n"]) == (1, 2) and 0 < got["low"] < 0.5


def test_archives(spark, folder, tmp_path, capsys):
    cli.main(["pack", folder, f"{tmp_path}/a.zip"])
    cli.main(["verify", f"{tmp_path}/a.zip"])
    cli.main(["unpack", f"{tmp_path}/a.zip", f"{tmp_path}/again"])
    assert len(lines(capsys, "inspect", f"{tmp_path}/again")) == 7
    (tmp_path / "b.zip").write_bytes((tmp_path / "a.zip").read_bytes()[:500])
    with pytest.raises(SystemExit):
        cli.main(["verify", f"{tmp_path}/b.zip"])
