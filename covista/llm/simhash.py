"""SimHash near-dedup by pigeonhole blocks: close fingerprints share blocks, are joined on them, and verified by Hamming distance.

Fingerprints that differ in `most` bits or fewer, cut into `blocks` blocks, agree in blocks - most of them at least. So
each fingerprint has a key for every choice of that many blocks, and each close pair shares a key. Only distinct
fingerprints are compared, so copies cost nothing; a hot key is split into parts that meet two at a time, and a task
says of the fingerprints it holds which hang together, not which pairs do, so a dense group stays linear in rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, scratch_table, slices, text_column, texts, to_batch

#: Words of a shingle, the seed of its hash, bits that linked fingerprints may differ in, blocks of a fingerprint.
WORDS, SEED, BITS, BLOCKS = 4, 42, 4, 6
#: Fingerprints of a key that are one part, on average; two parts are compared at a time.
PART = 1024
#: Hashes of a text that are counted at a time.
TILE = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text, unsigned; that of a text without words is 0.

    Its shingles are counted as often as they occur; a text of fewer words is one shingle. A bit is set if it is set in
    more than half of their hashes.
    """
    found = text.lower().split()  # of bytes: A-Z only, and the six white spaces of ASCII
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    last = ends[min(words, len(found)) - 1 :]
    first = np.concatenate(([0], ends + 1))[: len(last)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), TILE):
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[at : at + TILE].tolist(), last[at : at + TILE].tolist(), strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes())


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row; fp has the fingerprint's bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, words) for t in text_column(b)], np.uint64)
            yield to_batch({"doc_id": b.column("doc_id"), "fp": found.view(np.int64)}, schema)

    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of blocks - bits blocks the mask of their bits, as a signed long."""
    if not bits < blocks <= 64:
        raise ValueError("a fingerprint needs more blocks than bits may differ, and 64 at most")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in itertools.combinations(one, blocks - bits)]


def hanging_together(x: np.ndarray, group: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each fingerprint the place of the first one of its group that a chain of close ones leads to; groups are consecutive.

    Pairs are compared at one distance after the other, but for those that a chain has already brought together: a dense
    group is done after a few, and never holds its pairs.
    """
    label, alive, d = np.arange(len(x)), np.arange(len(x)), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(x)]
        alive = alive[group[alive + d] == group[alive]]
        a = alive[label[alive] != label[alive + d]]
        a = a[np.bitwise_count(x[a] ^ x[a + d]) <= bits]
        while len(a := a[label[a] != label[a + d]]):
            p, q = label[a], label[a + d]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while (label[label] != label).any():
                label = label[label]
    return label


def _links(parts: DataFrame, bits: int) -> DataFrame:
    """(a, b): a fingerprint and the first it hangs together with, in each group (mask, key, i, j) of parts; fewer than it has rows."""
    cols = ("mask", "key", "i", "j")

    def run(batches):
        schema, held = pa.schema([("a", pa.int64()), ("b", pa.int64())]), None

        def links(x, g):
            fp = x[:, 4]
            label = hanging_together(fp.view(np.uint64), g, bits)
            own = label != np.arange(len(fp))
            return to_batch({"a": fp[own], "b": fp[label[own]]}, schema)

        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*cols, "fp")], axis=1)
            x = x if held is None else np.concatenate([held, x])
            if not len(x):
                continue
            new = np.concatenate(([True], (x[1:, :4] != x[:-1, :4]).any(axis=1)))
            g = np.cumsum(new)
            cut = int(np.flatnonzero(new)[-1])  # the last group may go on
            held = x[cut:]
            if cut:
                yield links(x[:cut], g[:cut])
        if held is not None and len(held):
            yield links(held, np.zeros(len(held), np.int64))

    dealt = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols).sortWithinPartitions(*cols)
    return dealt.select(*cols, "fp").mapInArrow(run, "a long, b long")


def near_classes(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(id, root) for each of the distinct fingerprints fps (fp long) that is close to another: root is its component's least."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(bits, blocks))]))
    placed = fps.select("fp", keys.alias("k")).select("k.mask", "k.key", "fp")
    sizes = scratch_table(placed.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1"))
    met = placed.join(sizes, ["mask", "key"]).withColumn("n", F.ceil(F.col("size") / part))
    own = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    every = F.when(F.col("n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: o != F.col("own")))
    pairs = own.withColumn("other", F.explode(every)).select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return components(scratch_table(_links(pairs, bits).distinct()))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable).

    Rows are linked if their fingerprints differ in `bits` bits or fewer. Null and empty texts, and those of white space
    only, have the fingerprint zero and are linked like any other. Rows that share an id are nodes of their own, and
    equal rows link; a null id is no component's id, unless all of it are null. Other columns are left out; an empty table
    gives no rows. Texts are read whole and counted in tiles, however long.
    """
    rows = scratch_table(fingerprints(docs, words, id_col, text_col))
    fps = scratch_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = scratch_table(near_classes(fps.select("fp"), bits, blocks, part))
    of = classes.join(fps, F.col("id") == F.col("fp")).groupBy("root").agg(F.min("least").alias("of_class"))
    of = scratch_table(of)
    named = scratch_table(classes.join(of, "root").select("id", "of_class"))
    final = scratch_table(fps.join(named, F.col("fp") == F.col("id"), "left").select(F.col("fp").alias("own"), F.when(F.col("id").isNull(), F.col("least")).otherwise(F.col("of_class")).alias("component_id")))
    return rows.join(final, F.col("fp") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, bits: int = BITS) -> list[tuple[int, str, int]]:
    """The same, word by word and pair by pair. For tests."""
    out = []
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + words]), SEED) for k in range(max(1, len(w) - words + 1))] if w else []
        out.append((i, sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))))
    root = list(range(len(out)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(out)), 2):
        if (out[a][1] ^ out[b][1]).bit_count() <= bits:
            root[find(a)] = find(b)
    least: dict[int, list] = {}
    for k, (i, _) in enumerate(out):
        least.setdefault(find(k), []).append(i)
    return [(i, f"{fp:016x}", min((v for v in least[find(k)] if v is not None), default=None)) for k, (i, fp) in enumerate(out)]
