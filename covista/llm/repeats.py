"""Which windows of symbols repeat anywhere in a table of texts: the distributed part that the two substring operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import repeated_keys, scratch_table, slices, text_column, to_batch

Symbols = Callable[[bytes], np.ndarray]
_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


def _schema(**columns) -> pa.Schema:
    return pa.schema([("rid", pa.int64()), *columns.items()])


def window_runs(keyed: DataFrame, symbols: Symbols, shape: anchors.Shape, alive: DataFrame | None = None) -> DataFrame:
    """(rid, start, n, place, key, context) for each run of windows that share an anchor, over whole texts.

    alive has (rid, start, n), the windows that are looked at; texts without any aren't read. All are where it is None.
    """
    schema, some = _schema(start=pa.int64(), n=pa.int32(), place=pa.int32(), key=pa.int64(), context=pa.int64()), alive is not None

    def run(batches):
        for b in slices(batches):
            who, parts = [], []
            for i, text in enumerate(text_column(b)):
                if len(text) < shape.size:
                    continue
                own, live = symbols(text), None
                if some:
                    live = covered(max(0, len(own) - shape.size + 1), b.column("starts")[i].values.to_numpy(), b.column("lengths")[i].values.to_numpy(), 1)
                x = anchors.runs(own, shape, live)
                if len(x[0]):
                    who.append(np.full(len(x[0]), i))
                    parts.append(x)
            if parts:
                at = pa.array(np.concatenate(who))
                start, n, key, context, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield to_batch({"rid": b.column("rid").take(at), "start": start, "n": n.astype(np.int32), "place": place.astype(np.int32), "key": key, "context": context}, schema)

    rows = keyed.select("rid", "text") if alive is None else keyed.join(_lists(alive), "rid").select("rid", "text", "starts", "lengths")
    return rows.mapInArrow(run, _ddl(schema))


def _lists(rows: DataFrame) -> DataFrame:
    """(rid, starts, lengths): all runs of a row side by side."""
    return rows.groupBy("rid").agg(F.collect_list("start").alias("starts"), F.collect_list(F.col("n").cast("int")).alias("lengths")).hint("shuffle_hash")


def with_repeated_keys(runs: DataFrame) -> DataFrame:
    """The runs whose anchor is found at another place too; no window of any other can repeat."""
    return scratch_table(runs.join(repeated_keys(runs, "key"), "key", "left_semi"))


def split(runs: DataFrame, *bucket: str) -> tuple[DataFrame, DataFrame]:
    """(runs that repeat as a whole, runs of which single windows may repeat), from runs in buckets.

    Runs with one bucket and one context are the same symbols, so they repeat. Where a bucket also has a run that is
    alone in its context, one run of each of the bucket's contexts goes on.
    """
    more = [c for c in runs.columns if c not in (*bucket, "context")]
    classes = scratch_table(runs.groupBy(*bucket, "context").agg(F.count("*").alias("c"), F.first(F.struct(*more)).alias("one")))
    whole = runs.join(classes.where("c > 1").select(*bucket, "context"), [*bucket, "context"], "left_semi").select("rid", "start", "n")
    open_ = classes.groupBy(*bucket).agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 and least = 1")
    return whole, classes.join(scratch_table(open_.select(*bucket)), list(bucket), "left_semi").select(*bucket, "context", "one.*")


def expand(keyed: DataFrame, runs: DataFrame, symbols: Symbols, shape: anchors.Shape, columns: dict[str, pa.DataType], f: Callable[..., Iterator[dict]]) -> DataFrame:
    """Read the texts of runs again. f(symbols, half-window identifiers, start, n, place, key) yields columns, each a part of the rows of one text."""
    schema = _schema(**columns)

    def run(batches):
        for b in slices(batches):
            for i, (text, wanted) in enumerate(zip(text_column(b), b.column("runs"), strict=True)):
                x = symbols(text)
                halves = anchors.half_ids(x, shape)
                own = wanted.values
                for out in f(x, halves, *(own.field(k).to_numpy().astype(np.int64) for k in ("start", "n", "place", "key"))):
                    at = pa.array(np.full(len(out["start"]), i))
                    yield to_batch({"rid": b.column("rid").take(at), **out}, schema)

    lists = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "place", "key")).alias("runs")).hint("shuffle_hash")
    return keyed.join(lists, "rid").select("rid", "text", "runs").mapInArrow(run, _ddl(schema))


def single_windows(keyed: DataFrame, runs: DataFrame, symbols: Symbols, shape: anchors.Shape) -> DataFrame:
    """(rid, start, n = 1) for each window of the runs that another of their windows, with the same key, is equal to."""

    def single(_, halves, start, n, place, key):
        for at in range(0, len(start), 4096):
            s, m, k = (x[at : at + 4096] for x in (start, n, key))
            each = flat(s, m)
            yield {"start": each, "key": np.repeat(k, m), "id": anchors.window_ids(halves, shape, each).view(np.int64)}

    windows = scratch_table(expand(keyed, runs, symbols, shape, {"start": pa.int64(), "key": pa.int64(), "id": pa.int64()}, single))
    return windows.join(repeated_keys(windows, "key", "id"), ["key", "id"], "left_semi").select("rid", "start", F.lit(1).alias("n"))


def flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def attach(keyed: DataFrame, *found: DataFrame) -> DataFrame:
    """keyed with starts and lengths, the runs of repeated windows of each row; each of found has (rid, start, n)."""
    rows = found[0].select("rid", "start", "n")
    for f in found[1:]:
        rows = rows.unionByName(f.select("rid", "start", "n"))
    return keyed.join(_lists(rows), "rid", "left").select("doc_id", "text", "starts", "lengths")


def covered(total: int, starts, lengths, size: int) -> np.ndarray:
    """For each of total symbols, whether a window of the runs covers it."""
    if starts is None or not len(starts):
        return np.zeros(total, bool)
    at = np.zeros(total + 1, np.int64)
    s = np.asarray(starts, np.int64)
    np.add.at(at, s, 1)
    np.add.at(at, s + np.asarray(lengths, np.int64) + size - 1, -1)
    return np.cumsum(at[:-1]) > 0
