"""Exact top-k search by inner product with pivot tables: distances to pivots bound every score, candidates are read in bound order."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_table, to_batch

#: Pivots; rows in a block of queries and in a block of candidates, on average; candidates scored at a time.
PIVOTS, QUERIES, CANDIDATES, STEP = 48, 256, 4096, 64


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with y; exact, in integers of any size where floats aren't. A score beyond a long is an error."""
    with np.errstate(over="ignore"):
        easy = np.abs(x).max(axis=1, initial=0) * np.abs(y).max(initial=0) * x.shape[-1] < 2.0**53
    out = np.zeros(len(x), np.int64)
    out[easy] = (x[easy] @ y).astype(np.int64)
    for k in np.flatnonzero(~easy):
        out[k] = sum(int(a) * int(b) for a, b in zip(x[k], y, strict=True))  # raises OverflowError
    return out


def bounds(size: np.ndarray, of_rows: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Upper bounds of scores: size is |x|^2 + |q|^2 for each row x, of_rows its distances to the pivots, far the query's.

    |d(x, p) - d(q, p)| is a lower bound of d(x, q) for each pivot p; the largest, over all pivots, gives
    (|x|^2 + |q|^2 - bound^2) / 2. Where squares are beyond a double, a distance is infinite or none, and so is the bound:
    such rows may have any score.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _reach(size, np.fmax.reduce(np.abs(of_rows - far), axis=1, initial=0))


def _reach(size, apart):
    """The highest score at distance apart or more, with more than rounding can take away; infinite where that isn't finite."""
    upper = (size - apart * apart) / 2 + 1e-9 * size + 1
    return np.where(np.isfinite(upper), upper, np.inf)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared norms; infinite where a double can't hold them."""
    with np.errstate(over="ignore"):
        return (x * x).sum(1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)))
    return np.where(np.isnan(d), np.inf, d)


def search_block(queries: np.ndarray, q_keys: np.ndarray, of_queries: np.ndarray, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, of_rows: np.ndarray, k: int, least: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each query the k highest (score, id) among rows, ties to smaller ids, and how many candidates were scored for each.

    of_queries and of_rows are the pivot tables. Rows are scored in the order of their bound until it falls below the
    k-th score so far, or below least, which k other rows are known to reach. A row with the query's key is the query.
    """
    out, read = [], []
    norms, q_norms = squares(rows), squares(queries)
    low, high, most = of_rows.min(0, initial=np.inf), of_rows.max(0, initial=0), norms.max(initial=0)
    for q, norm, own, far, floor in zip(queries, q_norms, q_keys, of_queries, least, strict=True):
        with np.errstate(over="ignore", invalid="ignore"):
            reach = _reach(most + norm, np.fmax.reduce(np.fmax(low - far, far - high), initial=0))
        if not len(rows) or reach < floor:
            out.append([])
            read.append(0)
            continue
        upper = bounds(norms + norm, of_rows, far)
        left = np.flatnonzero((upper >= floor) & (keys != own))
        left = left[np.argsort(-upper[left], kind="stable")]
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        step, at, n = STEP, 0, 0
        while at < len(left):
            part = left[at : at + step]
            if len(best) == k and upper[part[0]] < best[0][0]:
                break
            n += len(part)
            scores = _scores(rows[part], q)
            if len(scores) > 4 * k:  # only the k best of a step can count, with their ties
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                part, scores = part[scores >= kth], scores[scores >= kth]
            for s, i in zip(scores.tolist(), ids[part].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            at += step
            step *= 2
        read.append(n)
        out.append(sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])))
    return out, read


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>) with floor(scale * x) for each component x as double.

    A null vector, one with a null or non-finite component, and a row without an id take no part.
    """
    value = lambda x: x.cast("double")
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    # from 2^52 on a double has no fraction, and its floor needn't fit a long
    floor = F.transform(F.col(vector_col), lambda x: F.when(F.abs(value(x) * scale) < 2.0**52, F.floor(value(x) * scale).cast("double")).otherwise(value(x) * scale))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("v"))


def pivot_table(rows: DataFrame, near: np.ndarray, width: int) -> DataFrame:
    """rows (key, vec_id, v) with far, the distances to all pivots, and cell, the nearest pivot: computed once, kept with the rows."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("far", pa.binary()), ("cell", pa.int32())])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = _matrix(b.column("v").to_pylist(), width)
                far = distances(x, near)
                yield to_batch({"key": b.column("key"), "vec_id": b.column("vec_id"), "v": [r.tobytes() for r in x], "far": [r.tobytes() for r in far], "cell": far.argmin(axis=1).astype(np.int32)}, schema)

    return rows.mapInArrow(run, "key long, vec_id long, v binary, far binary, cell int")


def blocks(table: DataFrame, size: int) -> DataFrame:
    """(block, cell, keys, ids, data, far, low, high, most): rows in blocks of about size, near the same pivot; a pivot with many rows has many blocks.

    low and high are the least and largest distances of the block's rows to each pivot, most their largest squared norm.
    """
    sizes = scratch_table(table.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts")))
    placed = table.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def run(pdf):
        import pandas as pd

        x, far = (np.stack([np.frombuffer(v) for v in pdf[c]]) for c in ("v", "far"))
        cell, part = (int(pdf[c].iloc[0]) for c in ("cell", "part"))
        return pd.DataFrame([{"block": cell << 32 | part, "cell": cell, "keys": pdf["key"].to_numpy(np.int64).tobytes(), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "data": x.tobytes(), "far": far.tobytes(), "low": far.min(0), "high": far.max(0), "most": float(squares(x).max())}])

    return scratch_table(placed.groupBy("cell", "part").applyInPandas(run, "block long, cell int, keys binary, ids binary, data binary, far binary, low array<double>, high array<double>, most double"))


def top_k(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, with_read: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of is_query (a Column of vec_id) the k highest inner products.

    Candidates are all usable() rows but the query's own; ties go to the smaller id; fewer rows give fewer results.
    Shorter vectors count as followed by zeros. Rows that repeat an id are candidates each, and queries each (with the
    same query_id); other columns are left out; an empty table gives no rows. Components may be as large as doubles are:
    where squares overflow nothing is ruled out, and only a score beyond a long is an error. with_read adds n_read, the candidates that
    were scored for the query.

    The pivot table is computed once and stored with the rows, which are packed in blocks of a bounded size by their
    nearest pivot. Each block of queries first searches one block near its own pivot: the k-th scores found there are
    what a query's k-th score is at least. A block's least and largest distances to the pivots bound all its scores at
    once, so blocks of queries meet only those blocks of rows whose bound reaches the least of these scores.
    """
    rows = scratch_table(usable(vectors, id_col, vector_col, scale).withColumn("key", F.monotonically_increasing_id()))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score long" + (", n_read long" if with_read else "")
    if not stats["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    width, tasks = max(1, stats["width"]), rows.sparkSession.sparkContext.defaultParallelism
    chosen = rows.orderBy(F.xxhash64("vec_id"), "key").limit(pivots).collect()
    near, count = _matrix([r["v"] for r in chosen], width), len(chosen)
    table = scratch_table(pivot_table(rows, near, width))
    right, left = blocks(table, CANDIDATES), blocks(table.where(is_query), QUERIES)
    queries = left.select(F.col("block").alias("qb"), "cell", F.col("keys").alias("q_keys"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("far").alias("q_far"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("most").alias("q_most"))

    def searched(b, r, floor):
        get = lambda c, kind=np.float64: np.frombuffer(b.column(c)[r].as_py(), kind)
        q = get("q_data").reshape(-1, width), get("q_keys", np.int64), get("q_far").reshape(-1, count)
        x = get("data").reshape(-1, width), get("keys", np.int64), get("ids", np.int64), get("far").reshape(-1, count)
        return search_block(*q, *x, k, floor if floor is not None else get("floor"))

    def first(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                found, _ = searched(b, r, np.full(len(b.column("q_keys")[r].as_py()) // 8, -np.inf))
                out.append(np.array([f[-1][0] if len(f) == k else -np.inf for f in found], float))
            yield pa.RecordBatch.from_arrays([b.column("qb"), pa.array([f.tobytes() for f in out], pa.binary()), pa.array([f.min(initial=np.inf) for f in out])], ["qb", "floor", "least"])

    def rest(batches):
        names = ["q_key", "query_id", "vec_id", "score", "n_read"]
        out_schema = pa.schema([(n, pa.int64()) for n in names])
        for b in batches:
            for r in range(b.num_rows):
                keys, ids = (np.frombuffer(b.column(c)[r].as_py(), np.int64).tolist() for c in ("q_keys", "q_ids"))
                found, read = searched(b, r, None)
                flat = [(key, i, v, s, n * (j == 0)) for key, i, own, n in zip(keys, ids, found, read, strict=True) for j, (s, v) in enumerate(own or ([(None, None)] if n else []))]
                yield to_batch({n: [f[j] for f in flat] for j, n in enumerate(names)}, out_schema)

    home = right.groupBy("cell").agg(F.min("block").alias("block"))
    home = scratch_table(queries.join(home, "cell").join(right.select("block", "keys", "ids", "data", "far"), "block").repartition(tasks).mapInArrow(first, "qb long, floor binary, least double"))
    gap = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    apart = F.greatest(F.lit(0.0), gap("low", "q_high"), gap("q_low", "high"))
    size = F.col("most") + F.col("q_most")
    reach = (size - apart * apart) / 2 + 1e-9 * size + 1
    short = queries.select("qb", "q_low", "q_high", "q_most").join(home.select("qb", "least"), "qb")
    pairs = scratch_table(short.join(right.select("block", "low", "high", "most"), reach >= F.col("least")).select("qb", "block"))
    met = pairs.repartition(tasks, "qb", "block").join(queries.select("qb", "q_keys", "q_ids", "q_data", "q_far"), "qb").join(home.select("qb", "floor"), "qb").join(right.select("block", "keys", "ids", "data", "far"), "block")
    best = met.mapInArrow(rest, "q_key long, query_id long, vec_id long, score long, n_read long")
    nth = Window.partitionBy("q_key").orderBy(F.desc_nulls_last("score"), "vec_id")
    if with_read:
        best = best.withColumn("n_read", F.sum("n_read").over(Window.partitionBy("q_key")))
    best = best.withColumn("rank", F.row_number().over(nth)).where(f"rank <= {k} and score is not null")
    return best.select("query_id", "rank", "vec_id", "score", *(["n_read"] if with_read else []))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
