"""Near-duplicate documents by ProbMinHash signatures of weighted word shingles, banding, and exact verification.

Similarity is the probability Jaccard of two documents' shingle weights x and y: the sum over common shingles i of
1 / sum_j max(x_j / x_i, y_j / y_i). It doesn't change if all weights of a document are scaled, and is the plain Jaccard
where all are equal. A shingle found t times weighs 1 + ln t.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import U, join, mixed, word_symbols
from .common import components, quoted, scratch_table, slices, text_column, texts, through_sieve, to_batch

#: Words of a shingle, least similarity, slots of a signature (a power of 2), bands and slots of a band.
WORDS, SIMILARITY, SLOTS, BANDS, ROWS = 5, 0.8, 256, 25, 5
#: Pairs are compared exactly if their signatures agree in this share less than the similarity, or more: 5.2 standard deviations.
SLACK = 0.13
#: Members of a bucket that are held side by side, and members that they are compared with, on average.
BLOCK = 256


def shingles(text: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted identifiers of a text's shingles and their weights; a text of fewer words is one shingle, one of none has none."""
    x = word_symbols(text)
    if not len(x):
        return x, np.empty(0)
    ids = x[: max(1, len(x) - words + 1)]
    for k in range(1, min(words, len(x))):
        ids = join(ids, x[k : k + len(ids)])
    ids, times = np.unique(ids, return_counts=True)
    return ids, 1 + np.log(times)


def signatures(ids: list[np.ndarray], weights: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: a row of slots for each document, each slot the shingle that arrived there first.

    Each shingle is a Poisson process whose rate is its weight, and each of its arrivals goes to a slot at random; both
    follow from the shingle alone. A shingle is done once its next arrival is later than the first arrivals of all slots,
    so most shingles have few. Two slots are equal with the probability Jaccard as their probability.
    """
    n = len(ids)
    flat, w = np.concatenate(ids), np.concatenate(weights)
    of = np.repeat(np.arange(n), [len(x) for x in ids])
    first, who = np.full(n * slots, np.inf), np.zeros(n * slots, U)
    time, last = np.zeros(len(flat)), np.full(n, np.inf)
    active, arrival = np.arange(len(flat)), 0
    while len(active):
        x = mixed(flat[active] + U(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time[active] -= np.log(((x >> U(11)).astype(float) + 0.5) * 2.0**-53) / w[active]
        keep = time[active] < last[of[active]]
        active, x = active[keep], x[keep]
        at = of[active] * slots + (x & U(slots - 1)).astype(np.int64)
        t = time[active]
        better = t < first[at]
        at, t, own = at[better], t[better], flat[active][better]
        order = np.argsort(-t, kind="stable")  # the last one written is the earliest
        first[at[order]], who[at[order]] = t[order], own[order]
        last = first.reshape(n, slots).max(axis=1)
        arrival += 1
    return who.reshape(n, slots)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard of sorted identifiers a with weights x, and b with y."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    u, v = x[both], y[at[both]]
    if not len(u):
        return 0.0
    pairs, times = np.unique(np.stack([u, v]), axis=1, return_counts=True)
    u, v = pairs
    rest = (x.sum() - x[both].sum()) / u + (y.sum() - y[at[both]].sum()) / v
    total = rest + (times * np.maximum(u[None, :] / u[:, None], v[None, :] / v[:, None])).sum(axis=1)
    return float((times / total).sum())


def _signed(docs: DataFrame, words: int, slots: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, bands, signature): same identifies the sequence of words; a signature has 16 bits of each slot."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                raw = text_column(b)
                found = [shingles(t, words) for t in raw]
                has = [k for k, (i, _) in enumerate(found) if len(i)]
                keys, signed = [[] for _ in raw], [b""] * len(raw)
                if has:
                    s = signatures([found[k][0] for k in has], [found[k][1] for k in has], slots)
                    lanes = mixed(s).astype(np.uint16)
                    cut = s[:, : bands * rows].reshape(len(has), bands, rows)
                    ids = np.tile(mixed(np.arange(1, bands + 1, dtype=U)), (len(has), 1))
                    for r in range(rows):
                        ids = join(ids, cut[:, :, r])
                    for k, own, lane in zip(has, ids.view(np.int64), lanes, strict=True):
                        keys[k], signed[k] = own, lane.tobytes()
                same = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in raw]
                yield to_batch({"doc_id": b.column("doc_id"), "same": same, "bands": keys, "signature": signed}, schema)

    return docs.mapInArrow(run, "doc_id long, same binary, bands array<long>, signature binary")


def _alike(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share of least slots or more."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for p in batches:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(k).to_pylist()), np.uint16).reshape(p.num_rows, -1) for k in ("x", "y"))
                yield p.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least)).cast(schema)

    x, y = (signed.select(F.col("node").alias(k), F.col("signature").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cuts(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, ids, weights) as bytes for the distinct nodes, from their whole texts; no weights stand for all being 1."""

    def cut(batches):
        schema = pa.schema([("node", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary())])
        for b in slices(batches):
            found = [shingles(t, words) for t in text_column(b)]
            yield to_batch({"node": b.column("doc_id"), "ids": [i.tobytes() for i, _ in found], "weights": [w.tobytes() if (w != 1).any() else b"" for _, w in found]}, schema)

    return scratch_table(docs.join(nodes.hint("shuffle_hash"), docs["doc_id"] == nodes["node"], "left_semi").mapInArrow(cut, "node long, ids binary, weights binary"))


def _weighed(ids: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(ids, U)
    return x, np.frombuffer(weights) if weights else np.ones(len(x))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b) of the pairs whose similarity is least or more, from their whole texts."""

    def compare(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for p in batches:
            columns = [p.column(c).to_pylist() for c in ("ai", "aw", "bi", "bw")]
            ok = [similarity(*_weighed(i, w), *_weighed(j, v)) >= least for i, w, j, v in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], schema=schema).filter(pa.array(ok, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    cuts = _cuts(nodes, docs, words)
    a, b = (cuts.select(F.col("node").alias(k), F.col("ids").alias(f"{k}i"), F.col("weights").alias(f"{k}w")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ai", "aw", "bi", "bw").mapInArrow(compare, "a long, b long")


def spanning(left: list[int], right: list[list[int]], roots: dict[int, int], alike) -> list[tuple[int, int]]:
    """Links (a, b) that join classes, of the candidates right[k] of each left[k], as far as alike(a, b) says so.

    Candidates that a chain of links has already put into one class aren't asked about, so links are fewer than nodes.
    """
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    out = []
    for a, others in zip(left, right, strict=True):
        for b in others:
            x, y = find(roots[a]), find(roots[b])
            if x != y and alike(a, b):
                up[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _apart(open_: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similar: float, agree: float) -> DataFrame:
    """(a, b): links between members of a bucket in different classes, one of them outside the bucket's main class.

    open_ has (bucket, node, root, main, size). The members outside the main class are a set of queries against the
    bucket, in blocks of about BLOCK, so that no task holds a large bucket. Two blocks meet twice: first with their
    signatures, which tell each query's candidates (in the first of the buckets that both share only); then those that
    have or are any bring their shingles, and are compared exactly until all that hang together are linked. A pair of
    blocks makes no more rows than it has members, however many of them are alike.
    """
    full = open_.join(nodes, "node")
    apart = open_.where("root <> main").groupBy("bucket").agg(F.count("*").alias("q"))
    full = full.join(scratch_table(apart), "bucket").withColumn("qs", F.ceil(F.col("q") / BLOCK)).withColumn("rs", F.ceil(F.col("size") / BLOCK))
    part = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = ("node", "root", "bands", "signature")
    left = full.where("root <> main").select("bucket", part("qs").alias("qb"), every("rs").alias("rb"), *own).toDF("bucket", "qb", "rb", *own)
    right = full.select("bucket", every("qs").alias("qb"), part("rs").alias("rb"), *own).toDF("bucket", "qb", "rb", *own)

    def candidates(key, x, y):
        import pandas as pd

        columns = ["bucket", "qb", "rb", "node", "root", "others"]
        none = pd.DataFrame({c: np.empty(0, np.int64) for c in columns[:-1]} | {"others": np.empty(0, object)})
        if not len(x) or not len(y):
            return none
        (i, s, k, r), (j, t, m, q) = ((d["node"].to_numpy(), np.stack([np.frombuffer(v, np.uint16) for v in d["signature"]]), np.stack(d["bands"]), d["root"].to_numpy()) for d in (x, y))
        out, met = [], np.zeros(len(j), bool)
        for n in range(len(i)):
            common = m == k[n]
            ok = (q != r[n]) & (m[np.arange(len(j)), common.argmax(axis=1)] == key[0])
            share = np.zeros(len(j))
            share[ok] = (t[ok] == s[n]).mean(axis=1)
            near = np.flatnonzero(ok & (share >= agree))
            if len(near):
                met[near] = True
                out.append((*key, i[n], r[n], j[near[np.argsort(-share[near], kind="stable")]]))
        if not out:
            return none
        asked = {o[3] for o in out}
        out += [(*key, j[n], q[n], None) for n in np.flatnonzero(met) if j[n] not in asked]
        return pd.DataFrame(out, columns=columns)

    def linked(pdf):
        import pandas as pd

        held = {n: _weighed(i, w) for n, i, w in zip(pdf["node"].tolist(), pdf["ids"], pdf["weights"], strict=True)}
        ask = pdf[pdf["others"].notna()].sort_values("node")
        alike = lambda a, b: similarity(*held[a], *held[b]) >= similar
        out = spanning(ask["node"].tolist(), [v.tolist() for v in ask["others"]], dict(zip(pdf["node"].tolist(), pdf["root"].tolist(), strict=True)), alike)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ("bucket", "qb", "rb")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(candidates, "bucket long, qb long, rb long, node long, root long, others array<long>")
    met = scratch_table(met)
    held = met.join(_cuts(scratch_table(met.select("node").distinct()), docs, words), "node")
    return held.groupBy(*keys).applyInPandas(linked, "a long, b long")


def near_links(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(members, classes): members (doc_id, node) gives each row's first copy, classes (id, root) the linked first copies' class.

    Rows with the same words in the same order are copies; only the first copy, by id, is compared. In each band's
    buckets all members are compared with one of them, the centre: the member that meets most others in all its buckets,
    which in a group of copies is the one the others were made from. Members that don't come into the class of their
    bucket's centre are then compared with all members of other classes: two members that are not compared are in one
    class already, or a chain of links has put them into one, so no link between classes is lost, and a group of copies
    stays linear.
    """
    docs = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    signed = scratch_table(_signed(docs, words, slots, bands, rows))
    members = signed.groupBy("same").agg(F.min("doc_id").alias("node"))
    members = scratch_table(signed.select("doc_id", "same").distinct().join(scratch_table(members), "same").select("doc_id", "node"))
    nodes = signed.join(members.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi")
    nodes = scratch_table(nodes.select(F.col("doc_id").alias("node"), "bands", "signature"))
    placed = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    sizes = scratch_table(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    placed = scratch_table(placed.join(sizes, "bucket"))
    met = scratch_table(placed.groupBy("node").agg(F.sum("size").alias("met")))
    centres = placed.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    centres = scratch_table(centres)

    def tested(pairs):
        return scratch_table(_verified(pairs, docs, words, least))

    first = placed.join(centres, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = tested(scratch_table(_alike(scratch_table(first), nodes, least - SLACK)))
    classes = scratch_table(components(links))
    roots = classes.select(F.col("id").alias("node"), "root")
    mains = centres.join(roots.withColumnRenamed("node", "centre"), "centre", "left").select("bucket", F.coalesce("root", "centre").alias("main"))
    open_ = placed.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(scratch_table(mains), "bucket")
    more = scratch_table(_apart(scratch_table(open_), nodes, docs, words, least, least - SLACK))
    if not more.isEmpty():
        classes = scratch_table(components(links.unionByName(more)))
    return members, classes


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: doc_id, class_id (the least id of its class), class_size, first_copy (the least id with the same words).

    A class is a connected component of documents whose similarity is least or more; a document without any is its own
    class. Null and empty texts have the same (no) words, so they are one class. A row without an id has no class and
    gets no row; rows that share an id count as one document. Other columns are left out; an empty table gives no rows.
    Texts are read whole, however long.
    """
    members, classes = near_links(docs, words, least, slots, bands, rows, id_col, text_col)
    ids = members.groupBy("doc_id").agg(F.min("node").alias("first_copy"))
    at = ids.join(classes, ids["first_copy"] == classes["id"], "left").select("doc_id", "first_copy", F.coalesce("root", "first_copy").alias("class_id"))
    at = scratch_table(at)
    sizes = scratch_table(at.groupBy("class_id").agg(F.count("*").alias("class_size")))
    return at.join(sizes, "class_id").select("doc_id", "class_id", "class_size", "first_copy")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all its columns, with one document of each class: that of the least id. Rows without an id stay.

    Rows that share an id stay together; take copies out first (exact_dedup). Only the rows to go are looked up: a bitmap
    of bounded size picks them where they lie, so what stays isn't shuffled.
    """
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    gone = scratch_table(gone)
    maybe, kept = through_sieve(docs, F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(-1)), gone)
    row = maybe.select(F.struct("*").alias("_row"), F.col(quoted(id_col)).cast("long").alias("_own"))
    left = row.join(gone, F.col("_own") == F.col("_gone"), "left_anti")
    return kept.unionByName(left.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in docs.columns]))


def recall(least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that a pair of just that similarity shares a bucket."""
    return 1 - (1 - least**rows) ** bands


def agreement(share: float = SIMILARITY, slots: int = SLOTS) -> float:
    """The standard deviation of the share of slots in which two such signatures agree."""
    return math.sqrt(share * (1 - share) / slots)
