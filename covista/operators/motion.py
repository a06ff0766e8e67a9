"""Discontinuities in ordered camera frames: extrapolation, shared points across an edge, flags and the break verdict.

Frames have a sequence, a number, a centre (three columns) and a unit quaternion (four). Edge k of a sequence lies between
its frames k and k + 1, in the order of their numbers from 0. Everything is windows within a sequence and sums by edge; a
point's observations are only looked at in pairs that follow each other, so no set of points is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covista.functions import geometry as g

from .tables import cut

#: Thresholds of the flags and of the break verdict, and the lengths of the windows in frames.
STEP, OVERLAP, OBSERVATIONS, STEPS, DEGREES = 1.5, 1.8, 2.5, 3.0, 15.0
BREAK_ROTATION, BREAK_SHARED = 4.0, 0.2
OVERLAP_WINDOW, BASELINE, BREAK_WINDOW = 16, 24, 8
#: A ratio within these is in band; beyond half or twice it is a strong change.
BAND, STRONG = (0.75, 1 / 0.75), (0.5, 2.0)


def _order(sequence: str, order: str):
    return Window.partitionBy(sequence).orderBy(order)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def positions(frames: DataFrame, sequence: str, order: str) -> DataFrame:
    """frames with pos, from 0 within the sequence, and n, the frames of the sequence."""
    return frames.withColumn("pos", F.row_number().over(_order(sequence, order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(sequence)))


def classify_ratio(ratio: Column) -> Column:
    """What a step ratio says: null in band or without a ratio."""
    slow = F.when(ratio < STRONG[0], "strong deceleration").when(ratio < BAND[0], "deceleration")
    return slow.when(ratio > STRONG[1], "strong acceleration").when(ratio > BAND[1], "acceleration")


def extrapolated(centres: list[list[Column]], turns: list[list[Column]], times: list[Column], at: Column) -> tuple[list[Column], list[Column]]:
    """(centre, unit quaternion) at a time, from the polynomial through two or three poses.

    The components of the quaternions are extrapolated one by one, with the signs that the first of them gives.
    """
    weights = []
    for i, t in enumerate(times):
        w = F.lit(1.0)
        for j, s in enumerate(times):
            if i != j:
                w = w * ((at - s) / (t - s))
        weights.append(w)
    signs = [F.when(g.dot(turns[0], q) < 0, -1.0).otherwise(1.0) for q in turns]
    centre = [sum((w * c[k] for w, c in zip(weights, centres, strict=True)), F.lit(0.0)) for k in range(3)]
    turn = [sum((w * s * q[k] for w, s, q in zip(weights, signs, turns, strict=True)), F.lit(0.0)) for k in range(4)]
    return centre, g.unit(turn)


def extrapolation_errors(frames: DataFrame, sequence: str, order: str, centre: tuple[str, ...], turn: tuple[str, ...]) -> DataFrame:
    """frames with left_trans, left_rot, right_trans, right_rot: how far a frame is from where its neighbours on one side point.

    Of the line through the nearest two and the parabola through the nearest three the smaller error counts; degrees for
    rotations; null without two neighbours. Frame numbers are the times.
    """
    w = _order(sequence, order)
    at = F.col(order).cast("double")
    out, names = frames, {}
    for k in (-3, -2, -1, 1, 2, 3):
        for c in (*centre, *turn, order):
            names[f"__{c}{k}"] = F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    out = out.withColumns(names)

    def error(ks):
        pose = [[F.col(f"__{c}{k}") for c in centre] for k in ks], [[F.col(f"__{c}{k}") for c in turn] for k in ks]
        c, q = extrapolated(*pose, [F.col(f"__{order}{k}").cast("double") for k in ks], at)
        return g.norm(g.minus(c, g.columns(*centre))), F.degrees(g.q_angle(q, g.columns(*turn)))

    columns = {}
    for side, two, three in (("left", (-2, -1), (-3, -2, -1)), ("right", (2, 1), (1, 2, 3))):
        for kind, a, b in zip(("trans", "rot"), error(two), error(three), strict=True):
            columns[f"{side}_{kind}"] = F.least(a, b)  # least() passes over nulls
    return out.withColumns(columns).drop(*names)


def motion_path(frames: DataFrame, sequence: str, order: str, centre: tuple[str, ...], turn: tuple[str, ...], sigmas: float = 2.5) -> DataFrame:
    """frames with step and rotation (degrees, from the frame before), bend and twist (from the middle of both neighbours) and jump.

    A jump is a step or a rotation above its mean and `sigmas` population deviations over the sequence.
    """
    w, all_ = _order(sequence, order), Window.partitionBy(sequence)
    names = {f"__{s}{c}": f(c).over(w) for s, f in (("b", F.lag), ("a", F.lead)) for c in (*centre, *turn)}
    x = frames.withColumns(names)
    of = lambda s, cs: [F.col(f"__{s}{c}") for c in cs]
    here, turned = g.columns(*centre), g.columns(*turn)
    middle = [(a + b) / 2 for a, b in zip(of("b", centre), of("a", centre), strict=True)]
    x = x.withColumns({
        "step": g.norm(g.minus(here, of("b", centre))), "rotation": F.degrees(g.q_angle(turned, of("b", turn))),
        "bend": g.norm(g.minus(here, middle)), "twist": F.degrees(g.q_angle(turned, g.q_slerp(of("b", turn), of("a", turn), F.lit(0.5)))),
    }).drop(*names)
    over = lambda c: F.coalesce(F.col(c) > F.avg(c).over(all_) + sigmas * F.stddev_pop(c).over(all_), F.lit(False))
    return x.withColumn("jump", over("step") | over("rotation"))


def _steps(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str) -> DataFrame:
    """(sequence, n, pos, before, after) for each item and frame that sees it: the positions where the item is seen before and next."""
    placed = positions(frames.select(sequence, order, frame), sequence, order).select(sequence, frame, "pos", "n")
    seen = observations.select(F.col(frame), F.col(item).alias("__item")).distinct().join(placed, frame)
    w = Window.partitionBy(sequence, "__item").orderBy("pos")
    return seen.select(sequence, "n", "pos", F.lag("pos").over(w).alias("before"), F.lead("pos").over(w).alias("next"))


def _by_edge(frames: DataFrame, events: DataFrame, sequence: str, order: str, names: list[str]) -> DataFrame:
    """(sequence, edge, n, names...): running sums of events (sequence, edge, names...) over all edges of a sequence."""
    edges = positions(frames.select(sequence, order), sequence, order).where("pos < n - 1").select(sequence, F.col("pos").alias("edge"), "n")
    sums = events.groupBy(sequence, "edge").agg(*[F.sum(c).alias(c) for c in names])
    w = Window.partitionBy(sequence).orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    joined = edges.join(sums, [sequence, "edge"], "left")
    return joined.select(sequence, "edge", "n", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in names])


def _runs(start: Column, stop: Column, name: str) -> Column:
    """Two events that add 1 to `name` on the edges from start up to, but not with, stop."""
    event = lambda at, by: F.struct(at.cast("int").alias("edge"), F.lit(name).alias("what"), F.lit(by).alias("by"))
    return F.when(start < stop, F.array(event(start, 1), event(stop, -1))).otherwise(F.array().cast("array<struct<edge:int,what:string,by:int>>"))


def shared_across(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str, window: int) -> DataFrame:
    """(sequence, edge, n, before, after, both): items seen in the window frames up to an edge, in those after it, and in both.

    An item's observations at positions p < q that follow each other are on both sides of the edges from max(p, q - window)
    to min(q, p + window) - 1, and these runs don't overlap, so sums of their ends count each item once an edge.
    """
    s = _steps(frames, observations, sequence, order, frame, item)
    end = F.coalesce(F.least(F.col("pos") + window, "next"), F.col("pos") + window)
    begin = F.greatest(F.col("pos") - window, F.coalesce("before", F.lit(0)), F.lit(0))
    events = F.concat(
        _runs(F.col("pos"), F.least(end, F.col("n")), "before"),
        _runs(begin, F.col("pos"), "after"),
        F.when(F.col("next").isNotNull(), _runs(F.greatest("pos", F.col("next") - window), F.least("next", F.col("pos") + window), "both")).otherwise(F.array().cast("array<struct<edge:int,what:string,by:int>>")),
    )
    flat = s.select(sequence, F.explode(events).alias("e")).select(sequence, F.col("e.edge").alias("edge"), *[F.when(F.col("e.what") == c, F.col("e.by")).otherwise(0).alias(c) for c in ("before", "after", "both")])
    return _by_edge(frames, flat, sequence, order, ["before", "after", "both"])


def overlap_drops(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str, window: int = OVERLAP_WINDOW, baseline: int = BASELINE) -> DataFrame:
    """(sequence, edge, overlap, drop): items on both sides of an edge as a share of the smaller side, and the median of the edges around over it.

    All drops are null in sequences of fewer than three windows; of fewer than three neighbours with an overlap too, and
    where their median is 0. An overlap of 0 is a drop without bound.
    """
    x = shared_across(frames, observations, sequence, order, frame, item, window)
    small = F.least("before", "after")
    x = x.withColumn("overlap", F.when((small > 0) & (F.col("n") >= 3 * window), F.col("both") / F.when(small > 0, small)))
    w = Window.partitionBy(sequence).orderBy("edge")
    near = F.concat(F.collect_list("overlap").over(w.rowsBetween(-baseline, -1)), F.collect_list("overlap").over(w.rowsBetween(1, baseline)))
    x = x.withColumn("__near", near).withColumn("__base", _median(F.col("__near")))
    known = F.col("overlap").isNotNull() & (F.size("__near") >= 3)
    drop = F.when(known & (F.col("overlap") == 0), float("inf")).when(known & (F.col("__base") > 0), F.col("__base") / F.when(F.col("overlap") > 0, F.col("overlap")))
    return x.select(sequence, "edge", "overlap", drop.alias("drop"))


def shared_by_neighbours(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str) -> DataFrame:
    """(sequence, edge, shared): items that both frames of an edge see."""
    return shared_across(frames, observations, sequence, order, frame, item, 1).select(sequence, "edge", F.col("both").alias("shared"))


def nearby_shared(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str, window: int = BREAK_WINDOW) -> DataFrame:
    """(sequence, edge, nearby): items seen in the window frames on both sides of an edge."""
    return shared_across(frames, observations, sequence, order, frame, item, window).select(sequence, "edge", F.col("both").alias("nearby"))


def frame_flags(left_trans: Column, left_rot: Column, right_trans: Column, right_rot: Column, step_ratio: Column, overlap_drop: Column, obs_z: Column, most_trans: Column, most_rot: Column | float = DEGREES) -> Column:
    """The flags of a frame, in a fixed order; step_ratio and overlap_drop are those of the edge that ends in it. A null sets no flag."""
    tests = [("L.t", left_trans > most_trans), ("L.r", left_rot > most_rot), ("R.t", right_trans > most_trans), ("R.r", right_rot > most_rot), ("Step", step_ratio > STEP), ("Cov", overlap_drop > OVERLAP), ("Obs", obs_z < -OBSERVATIONS)]
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests]))


def flagged_edges(frames: DataFrame, sequence: str, flags: str = "flags") -> DataFrame:
    """(sequence, edge, evidence): what frames (sequence, pos, n, flags) say about edges, as an array of (pos, flag).

    Flags of the left, of steps and of overlaps are about the edge before the frame, those of the right about the one
    after it. A frame's Obs flag goes to both its edges, if something else flags them.
    """
    each = frames.select(sequence, "pos", "n", F.explode(flags).alias("flag"))
    right = F.col("flag").startswith("R")
    own = each.where("flag <> 'Obs'").withColumn("edge", F.col("pos") - F.when(right, 0).otherwise(1)).where("edge >= 0 and edge < n - 1").select(sequence, "edge", "pos", "flag")
    dim = each.where("flag = 'Obs'").select(sequence, F.explode(F.array(F.col("pos") - 1, F.col("pos"))).alias("edge"), "pos", "flag")
    dim = dim.join(own.select(sequence, "edge").distinct(), [sequence, "edge"], "left_semi")
    return own.unionByName(dim).groupBy(sequence, "edge").agg(F.sort_array(F.collect_list(F.struct("pos", "flag"))).alias("evidence"))


def break_reference(edges: DataFrame, sequence: str) -> DataFrame:
    """(sequence, rate, gap, shared, nearby): the medians over edges (rotation, gap, shared, nearby) of the sequence; rate is rotation by gap.

    A sequence has as many edges as frames, which bounds what the exact medians hold.
    """
    x = edges.withColumn("rate", F.col("rotation") / F.col("gap"))
    return x.groupBy(sequence).agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"median_{c}") for c in ("rate", "gap", "shared", "nearby")])


def break_verdicts(edges: DataFrame, sequence: str) -> DataFrame:
    """edges (rotation, gap, shared, nearby) with expected, ratio and is_break.

    An edge is a break where it turns more than BREAK_ROTATION times what the sequence's rate gives for its gap (the
    median gap at least), and both shared counts are below BREAK_SHARED of their medians.
    """
    x = edges.join(break_reference(edges, sequence), sequence)
    expected = F.col("median_rate") * F.greatest(F.col("gap").cast("double"), "median_gap")
    ratio = F.when(expected > 0, F.col("rotation") / F.when(expected > 0, expected)).when(F.col("rotation") > 0, float("inf")).otherwise(0.0)
    few = (F.col("shared") < BREAK_SHARED * F.col("median_shared")) & (F.col("nearby") < BREAK_SHARED * F.col("median_nearby"))
    return x.withColumns({"expected": expected, "ratio": ratio}).withColumn("is_break", (F.col("ratio") > BREAK_ROTATION) & few).drop("median_rate", "median_gap", "median_shared", "median_nearby")


def analysed(frames: DataFrame, observations: DataFrame, sequence: str, order: str, frame: str, item: str, centre: tuple[str, ...], turn: tuple[str, ...], least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frames, edges) of all sequences with `least` frames and more: the errors and flags of frames, and the evidence and verdict of edges."""
    from . import sequences

    long = positions(frames, sequence, order).where(F.col("n") >= least).drop("pos", "n")
    long = cut(long)
    errors = cut(extrapolation_errors(long, sequence, order, centre, turn))
    path = cut(positions(motion_path(errors, sequence, order, centre, turn), sequence, order))
    sizes = observations.select(frame, F.col(item).alias("__item")).distinct().groupBy(frame).agg(F.count("*").alias("observed"))
    path = path.join(sizes, frame, "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("double"))
    path = sequences.robust_z(path, sequence, order, "observed").withColumnRenamed("z", "obs_z")
    path = cut(path)
    w = _order(sequence, order)
    lagged = path.withColumn("__last", F.lag(order).over(w)).where("pos > 0")
    steps = lagged.select(sequence, (F.col("pos") - 1).alias("edge"), F.col("step").alias("length"), "rotation", (F.col(order) - F.col("__last")).alias("gap"))
    ratios = sequences.step_ratios(steps, sequence, "edge", "length").select(sequence, "edge", "length", "rotation", "gap", "ratio").withColumnRenamed("ratio", "step_ratio")
    drops = overlap_drops(long, observations, sequence, order, frame, item)
    edges = ratios.join(drops, [sequence, "edge"], "left")
    edges = edges.join(shared_by_neighbours(long, observations, sequence, order, frame, item), [sequence, "edge"]).join(nearby_shared(long, observations, sequence, order, frame, item), [sequence, "edge"])
    edges = cut(edges)
    limit = edges.groupBy(sequence).agg((STEPS * F.expr("percentile(length, 0.5)")).alias("most_trans"))
    landing = edges.select(sequence, (F.col("edge") + 1).alias("pos"), "step_ratio", F.col("drop").alias("overlap_drop"))
    path = path.join(landing, [sequence, "pos"], "left").join(limit, sequence)
    flags = frame_flags(*g.columns("left_trans", "left_rot", "right_trans", "right_rot", "step_ratio", "overlap_drop", "obs_z", "most_trans"))
    path = cut(path.withColumn("flags", flags))
    found = flagged_edges(path, sequence)
    verdicts = break_verdicts(edges, sequence).join(found, [sequence, "edge"], "left").withColumn("n_flags", F.coalesce(F.size("evidence"), F.lit(0)))
    verdicts = cut(verdicts)
    core = sequences.core_edges(verdicts, sequence, "edge", "n_flags", "shared").select(sequence, "edge", F.lit(True).alias("is_core"))
    return path, verdicts.join(core, [sequence, "edge"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
