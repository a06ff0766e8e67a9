"""Suffix-array dedup over bytes by bucket-pointer refinement.

Suffixes go into buckets by their first q-gram. A bucket's pointer is its first suffix. Buckets are then sorted by the
bucket identifiers at later offsets, +q, +2q and so on, each round starting from the pointers that the round before has
updated, until they are as deep as a window, as a suffix array would be sorted to that depth; a suffix that is alone in
its bucket leaves at once.

One row for each suffix would be some 16 times the input. So of each window only the suffix at its anchor is put into a
bucket first (anchors.py): equal windows have equal anchors, so a bucket of one suffix ends all windows around it. What
is left is refined in pieces of neighbouring suffixes, and suffix by suffix only at the end. The q-grams' identifiers
name their bytes, so that those of later offsets are read where the text is, without a join by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, repeats
from .common import keyed_texts, scratch_table, slices, text_column, to_batch

#: Bytes of a window, bytes of the first buckets' q-grams, windows that the third round looks at together.
SIZE, GRAM, PIECE = 400, 128, 16


def refined(rows: DataFrame, depth: int) -> DataFrame:
    """rows (rid, start, key, piece, grams array<long>, ...) whose bucket has two members and more when it is depth q-grams deep, with the bucket's pointer (p_rid, p_start).

    The first buckets are those of (key, piece). Each round sorts by (pointer, identifier at the next offset) and gives
    every bucket that comes of it the pointer to its first member.
    """
    bucket = ["key", "piece"]
    for k in range(depth):
        keyed = rows.withColumn("later", F.col("grams")[k])
        groups = keyed.groupBy(*bucket, "later").agg(F.count("*").alias("c"), F.min(F.struct("rid", "start")).alias("p")).where("c > 1")
        groups = scratch_table(groups.select(*bucket, "later", F.col("p.rid").alias("q_rid"), F.col("p.start").alias("q_start")))
        met = keyed.join(groups, [*bucket, "later"])
        rows = scratch_table(met.drop("later", "p_rid", "p_start").withColumnsRenamed({"q_rid": "p_rid", "q_start": "p_start"}))
        bucket = ["p_rid", "p_start"]
    return rows.drop("grams", "piece")


def repeated_windows(keyed: DataFrame, size: int = SIZE, gram: int = GRAM, piece: int = PIECE) -> list[DataFrame]:
    """(rid, start, n): runs of n windows of size bytes, each of which also begins elsewhere.

    Buckets by the q-gram at the anchor; buckets of one suffix are done. Runs of windows around one anchor that are the
    same bytes as a whole are repeated; a bucket in which one run is alone goes on with one run of each kind. These are
    cut into pieces of neighbouring windows at equal offsets from the anchor, and refined() by the q-grams that all
    windows of a piece hold. Pieces that are the same as a whole are repeated, of the others single windows are compared.
    """
    shape = anchors.Shape(size, min(gram, size))
    piece = min(piece, size - shape.half + 1)  # what a piece's windows share is half a window at least
    shared = size - piece + 1
    offsets = sorted({*range(0, shared - shape.gram + 1, shape.gram), shared - shape.gram}) if shared >= shape.gram else []
    runs = scratch_table(repeats.window_runs(keyed, anchors.byte_symbols, shape))
    whole, rest = repeats.split(repeats.with_repeated_keys(runs), "key")

    def pieces(symbols, halves, start, n, place, key):
        grams = anchors.Ids(symbols, shape.gram).of[shape.gram] if offsets else None
        for at in range(0, len(start), 512):
            s, m, a, k = (x[at : at + 512] for x in (start, n, place, key))
            each, offset = repeats.flat(s, m), np.repeat(s + a, m)
            group = (offset - each) // piece  # windows at equal offsets from the anchor are compared
            run = np.repeat(np.arange(len(s)), m)
            first = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]) | (run[1:] != run[:-1])) + 1))
            count = np.diff(np.concatenate((first, [len(each)])))
            context = anchors.context_ids(halves, shape, each[first], count, offset[first] - each[first]).view(np.int64)
            core = (s + a)[run[first]] - group[first] * piece  # from here on, shared bytes
            ids = grams[core[:, None] + np.array(offsets)].view(np.int64) if offsets else np.empty((len(core), 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(core) + 1, dtype=np.int32) * len(offsets)), pa.array(ids.ravel()))
            yield {"start": each[first], "n": count.astype(np.int32), "place": (offset[first] - each[first]).astype(np.int32), "key": k[run[first]], "piece": group[first].astype(np.int32), "context": context, "grams": lists}

    kinds = {"start": pa.int64(), "n": pa.int32(), "place": pa.int32(), "key": pa.int64(), "piece": pa.int32(), "context": pa.int64(), "grams": pa.list_(pa.int64())}
    parts = scratch_table(repeats.expand(keyed, rest, anchors.byte_symbols, shape, kinds, pieces))
    parts = refined(parts, len(offsets)) if offsets else parts.withColumns({"p_rid": F.col("key"), "p_start": F.col("piece").cast("long")}).drop("grams", "piece")
    some, rest = repeats.split(parts, "p_rid", "p_start")
    return [whole, some, repeats.single_windows(keyed, rest, anchors.byte_symbols, shape)]


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row: every byte in a size-byte string that begins elsewhere too is removed.

    Texts are read as UTF-8. Strings never cross documents and are judged on the input, the same document included; a
    row that repeats is another place. n_spans counts maximal removed runs. A null or empty text, or one shorter than
    size, loses nothing. Other columns are left out; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in slices(batches):
            out = {f.name: [] for f in schema}
            for i, text, starts, lengths in zip(b.column("doc_id").to_pylist(), text_column(b), b.column("starts"), b.column("lengths"), strict=True):
                gone = repeats.covered(len(text), starts.as_py(), lengths.as_py(), size)
                n = int(gone.sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
                spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if n else 0
                for k, v in zip(out, (i, len(text), n, spans, kept), strict=True):
                    out[k].append(v)
            yield to_batch(out, schema)

    keyed = keyed_texts(docs, id_col, text_col)
    return repeats.attach(keyed, *repeated_windows(keyed, size, gram)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[tuple[int, str | None]], size: int = SIZE) -> dict[int, tuple[int, int, int, str]]:
    """The same, by counting all strings: doc_id -> n_bytes, n_removed, n_spans, digest. For tests."""
    from collections import Counter

    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + size] for b in raw.values() for k in range(len(b) - size + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out
