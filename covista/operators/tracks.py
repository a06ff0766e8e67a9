"""Operators over points, images and the observations that join them: adjacency, correspondence, merging, subsets and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covista.functions import geometry as g

from . import graphs
from .filters import renumbered
from .tables import cut

#: How many pair radii apart neighbours may be, the images they must share, the share of hits, the range tolerance.
NEAREST, FARTHEST, SHARED, MAJORITY, TOLERANCE = 1.0, 10.0, 2, 0.5, 0.05
_EPS_RADIUS, _EPS_RANGE = 1e-6, 1e-12
#: Cells are so many reaches wide: an asking row is shuffled once for each cell that it touches, a quarter more than one a side on average.
WIDE = 4


def adjacency_candidates(observations: DataFrame, nearest: float = NEAREST, farthest: float = FARTHEST) -> DataFrame:
    """(p, q), p < q, distinct: points that are within nearest to farthest pair radii of each other in some image.

    observations has (point, image, x, y, radius); the pair radius is the smaller one. A cell is as wide as the reach of
    the radii of its level (radii between two powers of 4) times WIDE, and each point asks, in every level, the cells next to its own
    that its reach touches, so that a few large radii don't widen the cells of the small ones.
    """
    o = observations.where("x is not null and y is not null and radius > 0 and not isnan(x) and not isnan(y) and radius < double('inf')")
    o = o.withColumn("level", F.ceil(F.log2(F.col("radius")) / 2).cast("int"))
    levels = o.select("level").distinct()
    width = WIDE * farthest * F.pow(F.lit(4.0), F.col("level"))
    # the pair's radius is the smaller one: a row asks, in each level from its own upward, the rows that are no finer than it
    asks = o.withColumnRenamed("level", "own").join(F.broadcast(levels), F.col("level") >= F.col("own"))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - farthest * F.col("radius")) / width), F.floor((F.col(c) + farthest * F.col("radius")) / width)))
    a = asks.withColumn("cx", near("x")).withColumn("cy", near("y")).select("image", "level", "cx", "cy", F.col("point").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("radius").alias("ar"))
    b = o.select("image", "level", F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"), F.col("point").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("radius").alias("br"))
    met = a.join(b, ["image", "level", "cx", "cy"]).where("a <> b")
    r, d = F.least("ar", "br"), F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return met.where((d >= nearest * r) & (d <= farthest * r)).select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()


def adjacency(observations: DataFrame, points: DataFrame, images: DataFrame, nearest: float = NEAREST, farthest: float = FARTHEST, shared: int = SHARED, majority: float = MAJORITY, tolerance: float = TOLERANCE) -> DataFrame:
    """(p, q, separation_med, separation_min, separation_max, shared_images, annulus_hits, range_mismatch): edges in both directions.

    observations (point, image, ordinal, x, y), points (point, radius, px, py, pz, at_infinity), images (image, cx, cy, cz).
    Candidate pairs are vetted over all images that see both, with a point's first observation in each: enough images, at
    least one hit of the annulus and a majority of hits, and a median relative difference of the ranges within tolerance.
    Separations are in pair radii and over hits alone. Points at infinity and radii that aren't above 0 take no part.
    """
    p = points.where("not at_infinity and radius > 0")
    o = observations.join(p, "point").join(images, "image")
    far = g.norm([F.col(f"p{c}") - F.col(f"c{c}") for c in "xyz"])
    first = Window.partitionBy("point", "image").orderBy("ordinal")
    o = o.select("point", "image", "ordinal", "x", "y", F.col("radius").cast("double").alias("radius"), far.alias("range"))
    o = cut(o)  # read several times below
    pairs = cut(adjacency_candidates(o, nearest, farthest))
    o = cut(o.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "ordinal"))
    side = lambda s: o.select(F.col("point").alias(s), "image", *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "radius", "range")])
    met = pairs.join(side("p"), "p").join(side("q"), ["q", "image"])
    r = F.greatest(F.least("p_radius", "q_radius"), F.lit(_EPS_RADIUS))
    dx, dy = F.col("p_x") - F.col("q_x"), F.col("p_y") - F.col("q_y")
    ratio = F.sqrt(dx * dx + dy * dy) / r
    mismatch = F.abs(F.col("p_range") - F.col("q_range")) / F.greatest(0.5 * (F.col("p_range") + F.col("q_range")), F.lit(_EPS_RANGE))
    met = met.select("p", "q", F.when((ratio >= nearest) & (ratio <= farthest), ratio).alias("ratio"), mismatch.alias("mismatch"))
    # a pair shares no more images than there are, which bounds its exact medians
    stats = met.groupBy("p", "q").agg(F.expr("percentile(ratio, 0.5)").alias("separation_med"), F.min("ratio").alias("separation_min"), F.max("ratio").alias("separation_max"), F.count("*").alias("shared_images"), F.count("ratio").alias("annulus_hits"), F.expr("percentile(mismatch, 0.5)").alias("range_mismatch"))
    ok = stats.where((F.col("shared_images") >= shared) & (F.col("annulus_hits") >= 1) & (F.col("annulus_hits") >= majority * F.col("shared_images")) & ~F.isnan("range_mismatch") & (F.col("range_mismatch") <= tolerance))
    rest = ok.columns[2:]
    return ok.unionByName(ok.select(F.col("q").alias("p"), F.col("p").alias("q"), *rest))


def correspondence_by_coordinate(source: DataFrame, target: DataFrame, shared: DataFrame, radius: float = 2.0, least: int = 2) -> DataFrame:
    """(source, target, votes): one-to-one correspondences of points by where they are seen in shared images.

    source and target have (image, ordinal, x, y, point), shared (source_image, target_image). In each shared image,
    observations that are each other's nearest within radius (ties: the one listed first) vote for their points. Pairs
    with least votes and more are taken one by one, most votes first, then by the first vote cast (by image pair, then
    place), until a point is used. Rounds of pairs that are the first for both their points give the same result.
    """
    finite = "x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('inf') and abs(y) < double('inf')"
    cell = WIDE * radius if radius > 0 else 1.0
    s = source.where(finite).join(shared.withColumnRenamed("source_image", "image"), "image").select("image", "target_image", F.col("ordinal").alias("so"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("point").alias("source"))
    # the cells that the radius touches, one or two a side; a hair more, as a sum may be rounded
    reach = abs(radius) * (1 + 1e-9)
    low, high = (lambda c, k=k: F.floor((F.col(c) + k * (reach + F.abs(F.col(c)) * 1e-15)) / cell) for k in (-1, 1))
    for c in "xy":
        s = s.withColumn(f"c{c}", F.explode(F.sequence(low(f"s{c}"), high(f"s{c}"))))
    t = target.where(finite).select(F.col("image").alias("target_image"), F.col("ordinal").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("point").alias("target"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d2 = (F.col("sx") - F.col("tx")) * (F.col("sx") - F.col("tx")) + (F.col("sy") - F.col("ty")) * (F.col("sy") - F.col("ty"))
    near = s.join(t, ["target_image", "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    best = lambda own, other: F.row_number().over(Window.partitionBy("image", "target_image", own).orderBy("d2", other))
    votes = near.withColumns({"a": best("so", "to"), "b": best("to", "so")}).where("a = 1 and b = 1")
    pairs = votes.groupBy("source", "target").agg(F.count("*").alias("votes"), F.min(F.struct("image", "target_image", "so")).alias("first")).where(F.col("votes") >= least)
    left = cut(pairs.withColumn("turn", F.struct((-F.col("votes")).alias("v"), "first", "source", "target")))
    out = None
    while not left.isEmpty():
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("turn"))
        ranked = cut(left.withColumns({"s": first("source"), "t": first("target")}))
        now = ranked.where("s = 1 and t = 1").select("source", "target", "votes")
        out = now if out is None else out.unionByName(now)
        left = ranked.where("s > 1 or t > 1").drop("s", "t")
        left = cut(left.join(now.select("source"), "source", "left_anti").join(now.select("target"), "target", "left_anti"))
    return out if out is not None else pairs.select("source", "target", "votes")


def grouped_correspondences(pairs: DataFrame, points: DataFrame, percentile: float = 95.0) -> DataFrame:
    """(node, root): groups of points that pairs (a, b) join, without the groups that spread further than the percentile of all groups' spreads.

    points has (node, x, y, z); a group's spread is the largest distance of its points to their mean.
    """
    groups = graphs.connected_groups(pairs, "a", "b")
    placed = cut(groups.join(points, groups["id"] == points["node"]).select("node", "root", "x", "y", "z"))
    spread = cut(graphs.group_max_distance(placed, "root", "x", "y", "z"))
    limit = spread.agg(F.expr(f"percentile(farthest, {percentile / 100})").alias("limit"))
    keep = spread.join(F.broadcast(limit)).where("farthest <= limit").select("root")
    return placed.join(keep, "root", "left_semi").select("node", "root")


def merge_points_and_tracks(points: DataFrame, observations: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, observations) of several reconstructions as one.

    points (node, x, y, z, w, r, g, b, error), observations (node, image, feature), with images of the merged table, and
    groups (node, root). Points of a group become one, as do points that share an observation: the mean of positions,
    colours and errors over finite members, or, where all members are at infinity (w = 0), the unit mean direction. A
    point that no group has stays as it is. New points are numbered from 0 by their least node; observations are distinct.
    """
    seen = observations.groupBy("image", "feature").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where("size(all) > 1")
    links = seen.select("a", F.explode("all").alias("b")).unionByName(groups.select(F.col("root").alias("a"), F.col("node").alias("b"))).where("a <> b")
    roots = graphs.connected_groups(links, "a", "b") if not links.isEmpty() else groups.select(F.col("node").alias("id"), "root").where("false")
    placed = points.join(roots, points["node"] == roots["id"], "left").withColumn("root", F.coalesce("root", "node")).drop("id")
    finite = F.col("w") != 0
    any_ = Window.partitionBy("root")
    used = placed.withColumn("__finite", F.max(finite).over(any_)).where(finite == F.col("__finite"))
    mean = used.groupBy("root").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b", "error")], F.max("w").alias("w"), F.count("*").alias("members"))
    length = F.when(F.col("w") == 0, g.norm(g.columns("x", "y", "z"))).otherwise(1.0)
    mean = mean.withColumns({c: F.col(c) / F.when(length > 0, length).otherwise(1.0) for c in "xyz"})
    out = renumbered(mean, "root", "point")
    ids = placed.select("node", "root").join(out.select("root", "point"), "root")
    return out.drop("root"), observations.join(ids, "node").select("point", "image", "feature").distinct()


def merged_cameras(images: DataFrame) -> DataFrame:
    """(camera, merged): cameras of several reconstructions that an image of the same name shows to be one. images has (name, camera), camera ids unlike each other."""
    links = images.groupBy("name").agg(F.min("camera").alias("a"), F.collect_set("camera").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
    roots = graphs.connected_groups(links, "a", "b") if not links.isEmpty() else images.select(F.col("camera").alias("id"), F.col("camera").alias("root")).where("false")
    all_ = images.select("camera").distinct()
    return all_.join(roots, all_["camera"] == roots["id"], "left").select("camera", F.coalesce("root", "camera").alias("merged"))


def paired_images(left: DataFrame, right: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """(left, right, stage): images of two tables, each in one pair at most.

    1: a digest that one row of each side has. 2: digests that several rows of a side share, where the names are equal as
    well, the first of a name on each side. 3: the rest by name, the first of each side that isn't paired. A null pairs
    with nothing.
    """
    count = lambda d, s: d.groupBy(digest).agg(F.count("*").alias(f"n_{s}"))
    both = count(left, "l").join(count(right, "r"), digest)
    once, several = both.where("n_l = 1 and n_r = 1").select(digest), both.where("n_l > 1 or n_r > 1").select(digest)
    of = lambda d, side, *on: d.select(F.col(key).alias(side), *on)
    one = cut(of(left, "left", digest).join(once, digest, "left_semi").join(of(right, "right", digest), digest).select("left", "right", F.lit(1).alias("stage")))
    first = lambda d, side, *on: d.groupBy(*on).agg(F.min(key).alias(side))
    shared = lambda d: d.join(several, digest, "left_semi")
    two = cut(first(shared(left), "left", digest, name).join(first(shared(right), "right", digest, name), [digest, name]).select("left", "right", F.lit(2).alias("stage")))
    done = one.unionByName(two)
    rest = lambda d, side: d.join(done.select(F.col(side).alias(key)), key, "left_anti")
    three = first(rest(left, "left"), "left", name).join(first(rest(right, "right"), "right", name), name).select("left", "right", F.lit(3).alias("stage"))
    return done.unionByName(three)


def pruned_pairs(pairs: DataFrame, gap: int = 4, most_close: int | None = None, most_distant: int = 5000, search: int = 3) -> DataFrame:
    """Pairs (i, j, score) for matching: those whose numbers differ by gap or less, the closest first if there is a most of them; and of the others the best.

    Of the distant ones, the search * most_distant closest are looked at, and of these the most_distant with the highest
    score taken; ties by (i, j).
    """
    far = F.abs(F.col("j") - F.col("i"))
    close, distant = pairs.where(far <= gap), pairs.where(far > gap)
    if most_close is not None:
        close = close.orderBy(far, "i", "j").limit(most_close)
    return close.unionByName(distant.orderBy(far, "i", "j").limit(search * most_distant).orderBy(F.desc("score"), "i", "j").limit(most_distant))


def subset_by_images(images: DataFrame, observations: DataFrame, points: DataFrame, chosen: DataFrame, drop_orphans: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, observations, points) of the chosen images (image, nth), which are numbered by nth.

    Points that none of them sees go, or stay if drop_orphans is off; points are numbered anew in their order. changed
    tells of a point whether it has lost observations.
    """
    kept = images.join(chosen, "image").withColumn("image", F.col("nth")).drop("nth")
    seen = observations.join(chosen, "image").withColumn("image", F.col("nth")).drop("nth")
    before, after = observations.groupBy("point").agg(F.count("*").alias("n")), seen.groupBy("point").agg(F.count("*").alias("m"))
    p = points.join(before, "point", "left").join(after, "point", "inner" if drop_orphans else "left")
    p = renumbered(p.withColumn("changed", F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))).drop("n", "m"), "point", "__new")
    ids = p.select("point", "__new")
    return kept, seen.join(ids, "point").withColumn("point", F.col("__new")).drop("__new"), p.withColumn("point", F.col("__new")).drop("__new")


def max_viewing_angles(observations: DataFrame, points: DataFrame, images: DataFrame) -> DataFrame:
    """(point, angle): the widest angle in radians between two rays of a point, from points (point, x, y, z) and images (image, cx, cy, cz).

    Rays meet ray by ray within a point: a track has no more rays than images.
    """
    o = observations.select("point", "image").distinct().join(points, "point").join(images, "image")
    o = cut(o.select("point", "image", *[(F.col(c) - F.col(f"c{c}")).alias(f"r{c}") for c in "xyz"]))
    other = o.toDF("point", "image2", "sx", "sy", "sz")
    met = o.join(other, "point").where("image < image2")
    return met.groupBy("point").agg(F.max(g.angle_between(g.columns("rx", "ry", "rz"), g.columns("sx", "sy", "sz"))).alias("angle"))


def narrow_tracks_removed(points: DataFrame, observations: DataFrame, images: DataFrame, least: float) -> DataFrame:
    """points (point, x, y, z, w) without finite ones whose rays are all within an angle of less than `least` radians; points at infinity stay."""
    wide = max_viewing_angles(observations, points.where("w <> 0").select("point", "x", "y", "z"), images).where(F.col("angle") >= least).select("point")
    return points.where("w = 0").unionByName(points.where("w <> 0").join(wide, "point", "left_semi"))


def by_patch_size(points: DataFrame, u: str, v: str, times: float) -> DataFrame:
    """points whose patch size, the root of u * v, is no more than `times` the median of all; rows without a patch go."""
    size = F.sqrt(F.col(u) * F.col(v))
    median = points.agg(F.percentile(size, 0.5).alias("__median"))
    return points.join(F.broadcast(median)).where(size <= times * F.col("__median")).drop("__median")


def by_reading(points: DataFrame, column: str, most: float) -> DataFrame:
    """points whose stored reading is no more than `most`; null and NaN readings go."""
    return points.where(~F.isnan(column) & (F.col(column) <= most))


def selected_clusters(members: DataFrame, images: DataFrame | None = None, clusters: DataFrame | None = None, statuses: list | None = None, least_span: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, images): members (cluster, ordinal, image, status, refinable, ...) that are left, with clusters numbered anew in their order, and n of each requested image.

    Clusters that aren't refinable, or not among those asked for (a set: repeats collapse), go; of the others, members with
    an accepted status on requested images stay, where they are on least_span images and more, two at least. Requested
    images stay even without members.
    """
    m = members.where("refinable")
    if clusters is not None:
        m = m.join(clusters.select("cluster").distinct(), "cluster", "left_semi")
    if statuses is not None:
        m = m.where(F.col("status").isin(statuses))
    asked = images.select("image").distinct() if images is not None else members.select("image").distinct()
    m = m.join(asked, "image", "left_semi")
    wide = m.groupBy("cluster").agg(F.countDistinct("image").alias("n")).where(F.col("n") >= max(2, least_span)).select("cluster")
    out = m.join(renumbered(wide, "cluster", "__new"), "cluster").withColumn("source_cluster", F.col("cluster")).withColumn("cluster", F.col("__new")).drop("__new")
    return out, asked.join(out.groupBy("image").agg(F.count("*").alias("n")), "image", "left").select("image", F.coalesce("n", F.lit(0)).alias("n"))


def member_positions(members: DataFrame) -> DataFrame:
    return members.select("cluster", "ordinal", "x", "y")


def member_shapes(members: DataFrame) -> DataFrame:
    return members.select("cluster", "ordinal", "shape")


def worst_consistency(members: DataFrame, value: str) -> DataFrame:
    """(cluster, worst): the largest finite value of each cluster; without bound where none is finite."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return members.groupBy("cluster").agg(F.coalesce(F.max(finite), F.lit(float("inf"))).alias("worst"))


def cluster_radii(members: DataFrame, refine_radius: float, shape: str = "shape") -> DataFrame:
    """(cluster, radius): the largest of the members' sizes times refine_radius; members without a shape don't count."""
    return members.groupBy("cluster").agg((F.max(g.affine_size(F.col(shape))) * refine_radius).alias("radius"))


def coarsest_clusters(members: DataFrame, refine_radius: float, n: int, shape: str = "shape") -> DataFrame:
    """(cluster) of the n clusters of largest radius, ties by cluster; in ascending order."""
    return cluster_radii(members, refine_radius, shape).where("radius is not null").orderBy(F.desc("radius"), "cluster").limit(n).select("cluster").orderBy("cluster")


def bands(radius: Column, floor: Column | float, edges: list[float]) -> Column:
    """The band k with edges[k + 1] <= radius / floor < edges[k] (edges descend), the last of several; -1 for none."""
    x, out = radius / floor, F.lit(-1)
    for k in range(len(edges) - 1):
        out = F.when((x < edges[k]) & (x >= edges[k + 1]), k).otherwise(out)
    return out


def source_clusters(chosen: DataFrame, members: DataFrame, floor: float, edges: list[float]) -> tuple[DataFrame, DataFrame]:
    """(joined, behind): each chosen row (cluster, image, feature) with the first source cluster that has its feature; and the source clusters that no chosen row has, by band.

    members has (source, image, feature, radius). Joined rows without a source have null; behind has (source, radius, band).
    """
    first = members.groupBy("image", "feature").agg(F.min("source").alias("source"))
    joined = chosen.join(first, ["image", "feature"], "left").select("cluster", "image", "feature", "source")
    radii = members.groupBy("source").agg(F.max("radius").alias("radius"))
    behind = radii.join(joined.select("source").distinct(), "source", "left_anti")
    return joined, behind.select("source", "radius", bands(F.col("radius"), floor, edges).alias("band"))


def displacements(members: DataFrame) -> DataFrame:
    """(i, j, shared, displacement): shared clusters of each two images, and the mean distance of a cluster's members in both.

    members has (cluster, ordinal, image, x, y); of several members of a cluster in an image the first counts.
    """
    nth = F.row_number().over(Window.partitionBy("cluster", "image").orderBy("ordinal"))
    m = members.withColumn("__nth", nth).where("__nth = 1").select("cluster", F.col("image").alias("i"), "x", "y")
    met = m.join(m.toDF("cluster", "j", "x2", "y2"), "cluster").where("i < j")
    return met.groupBy("i", "j").agg(F.count("*").alias("shared"), F.avg(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("displacement"))


def partners_by_displacement(pairs: DataFrame, k: int, least: int, farthest: bool = False) -> DataFrame:
    """(image, partner, displacement, rank): of each image the k partners of least (or largest) displacement that share `least` clusters and more; ties by partner."""
    both = pairs.select(F.col("i").alias("image"), F.col("j").alias("partner"), "shared", "displacement").unionByName(pairs.select(F.col("j").alias("image"), F.col("i").alias("partner"), "shared", "displacement"))
    order = F.desc("displacement") if farthest else F.asc("displacement")
    nth = F.row_number().over(Window.partitionBy("image").orderBy(order, "partner"))
    return both.where(F.col("shared") >= least).withColumn("rank", nth).where(F.col("rank") <= k).select("image", "partner", "displacement", "rank")


def prune_covered(points: DataFrame, row: str, group: str, owner: str, x: str, y: str, reach: str, radius: str, protected: str | None = None, ratio: float = 2.0, finest: float = 0.0, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, owners): the rows that stay, with their owner numbered anew, and the map (owner, new) of owners that stay.

    A row goes if a row of another owner, finer by ratio, lies within its reach, unless it is protected; then owners with
    fewer than least rows go. NaN radii match nothing.
    """
    from .joins import within_reach

    size = points.select(F.col(row).alias("row"), F.col(owner).alias("owner"), F.col(radius).alias("radius"), (F.col(protected) if protected else F.lit(False)).alias("safe"))
    near = within_reach(points, row, group, x, y, reach).select("row", "other")
    near = near.join(size.where("not safe"), "row").join(size.select(F.col("row").alias("other"), F.col("owner").alias("o2"), F.col("radius").alias("r2")), "other")
    gone = near.where(~F.isnan("radius") & ~F.isnan("r2") & (F.col("owner") != F.col("o2")) & (F.col("r2") < F.col("radius")) & (F.col("radius") >= ratio * F.col("r2")) & (F.col("r2") >= finest)).select("row").distinct()
    left = cut(size.join(gone, "row", "left_anti"))
    enough = renumbered(left.groupBy("owner").count().where(F.col("count") >= least).select("owner"), "owner", "new")
    return left.join(enough, "owner").select("row", "owner", "new", "radius"), enough.select("owner", "new")
