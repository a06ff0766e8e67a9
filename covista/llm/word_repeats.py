"""Substring dedup over words by level-wise doubling: only windows that repeat at one length are extended to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, repeats
from .common import keyed_texts, scratch_table, slices, text_column, to_batch

#: Words of a window, and of the windows of the first level.
SIZE, FIRST = 35, 9


def lengths(size: int = SIZE, first: int = FIRST) -> list[int]:
    """The lengths of the levels: first, twice that, and so on, each no more than twice the one before; size is the last."""
    out = [min(first, size)]
    while out[-1] < size:
        out.append(min(2 * out[-1], size))
    return out


def repeated_windows(keyed: DataFrame, size: int = SIZE, first: int = FIRST) -> list[DataFrame]:
    """(rid, start, n): runs of n windows of size words, each of which also begins elsewhere.

    Each level looks at the windows of size words that are left. In each of them it reads one window of the level's
    length, at a place that the words themselves choose (anchors.py), so that equal windows read the same. Where that is
    found once in the whole table, the window of size words around it is found once, and is dropped; the others are read
    again at twice the length, until no candidates survive or the length is size. Neighbouring windows that read the same
    place are one row. At the last level, equal runs of windows are counted as a whole; only where a run is alone, but a
    part of it could repeat, its windows are counted one by one.
    """
    *short, _ = lengths(size, first)
    alive = None
    for length in short:
        runs = scratch_table(repeats.window_runs(keyed, anchors.word_symbols, anchors.Shape(size, length), alive))
        alive = repeats.with_repeated_keys(runs)
        if alive.isEmpty():
            return [alive]
    shape = anchors.Shape(size, short[-1] if short else size)
    if alive is None:
        alive = repeats.with_repeated_keys(scratch_table(repeats.window_runs(keyed, anchors.word_symbols, shape)))
    whole, rest = repeats.split(alive, "key")
    return [whole, repeats.single_windows(keyed, rest, anchors.word_symbols, shape)]


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: every word in a window of size words that begins elsewhere too is removed.

    kept are the other words, joined by one blank. Words are runs of characters outside [\\x20\\x09-\\x0D], unchanged.
    Windows are judged on the input, the same document included; a row that repeats is another place. A null or empty
    text, or one shorter than a window, loses nothing. Other columns are left out; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in slices(batches):
            out = {f.name: [] for f in schema}
            for i, text, starts, lengths in zip(b.column("doc_id").to_pylist(), text_column(b), b.column("starts"), b.column("lengths"), strict=True):
                words = text.split()
                gone = repeats.covered(len(words), starts.as_py(), lengths.as_py(), size)
                left = words if not gone.any() else [words[k] for k in np.flatnonzero(~gone)]
                for k, v in zip(out, (i, len(words), int(gone.sum()), b" ".join(left)), strict=True):
                    out[k].append(v)
            yield to_batch(out, schema)

    keyed = keyed_texts(docs, id_col, text_col)
    return repeats.attach(keyed, *repeated_windows(keyed, size)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def brute_force(texts: list[tuple[int, str | None]], size: int = SIZE) -> dict[int, tuple[int, int, str]]:
    """The same, by counting all windows: doc_id -> n_words, n_removed, digest. For tests."""
    from collections import Counter

    words = {i: (t or "").encode().split() for i, t in texts}
    seen = Counter(tuple(w[k : k + size]) for w in words.values() for k in range(len(w) - size + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
    return out
