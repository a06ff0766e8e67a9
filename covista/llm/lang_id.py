"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_table, texts, to_batch

UNKNOWN = "und"
#: N-grams in a profile; the longest n-gram; documents of each language from which profiles are learned, about.
PROFILE, ORDER, SAMPLE = 300, 3, 1_000

#: A code that no letter has; 0 would make n-grams that begin with a blank equal to shorter ones.
_BLANK = 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str, tile: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of up to ORDER characters of a text and their counts, each packed in an integer of 21 bits a character.

    Letters are lowered; whatever else stands between words counts as one blank. N-grams of blanks alone don't count.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    words = _letters()[cp]
    if not words.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = words.copy()
    keep[1:] |= words[:-1]  # the first character after a word stands for the blank
    x = np.concatenate(([_BLANK], np.where(words, cp, _BLANK)[keep], [_BLANK])).astype(np.int64)
    if x[-2] == _BLANK:
        x = x[:-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), tile):
        part = x[at : at + tile + ORDER - 1]
        own = min(tile, len(x) - at)
        packed, each = part, []
        for n in range(1, ORDER + 1):
            if n > 1:
                packed = (packed[:-1] << 21) | part[n - 1 :]
            each.append(packed[:own][packed[:own] != _BLANK])
        found.append(np.unique(np.concatenate(each), return_counts=True))
    if len(found) == 1:
        return found[0]
    codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first; ties by code."""
    if len(codes) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Language profiles in one sorted table: for each code its rank in each language; a missing code has the largest distance."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes)), -1, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """The language at the least out-of-place distance (ties: the first by name), and 1 - distance / the largest possible one."""
        codes, counts = grams(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        if not len(self.codes):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = np.where(known, self.ranks[:, at], -1)
        far = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(own))), self.size), self.size).sum(axis=1)
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (self.size * len(own))


def fit(labelled: DataFrame, per_language: int = SAMPLE, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Learn profiles from the rows of labelled whose language is not null.

    Of each language with more rows, about per_language of them are read, chosen by a hash of their id: this bounds
    what is learned from. Every language there is gets a profile; the driver receives size codes for each of them.
    """
    docs = labelled.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    sizes = scratch_table(docs.groupBy("lang").agg(F.ceil(F.count("*") / per_language).alias("share")))
    some = docs.join(sizes, "lang").where("pmod(xxhash64(doc_id), share) = 0")

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                codes, counts = grams(text.as_py())
                yield to_batch({"lang": [lang] * len(codes), "code": codes, "n": counts}, schema)

    counts = some.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # ranks are cut off where the counts lie before they are brought together, so no task gets all codes of a language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    first = scratch_table(counts).withColumn("nth", nth).where(F.col("nth") <= size)
    top = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))).alias("top"))
    return Profiles({r["lang"]: r["codes"] for r in top.select("lang", F.col("top.code").alias("codes")).collect()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, from its whole text alone.

    A null text, or one without a letter, is `und` with a score of 0. Repeated rows get a row each; other columns are
    left out; an empty table gives no rows. Without profiles all is `und`. Texts are read whole, however long; of equally
    near profiles the first language in order is taken.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for b in batches:
            out = [profiles.predict(t.as_py()) for t in b.column("text")]
            yield to_batch({"doc_id": b.column("doc_id"), "lang_pred": [x for x, _ in out], "score": [x for _, x in out]}, schema)

    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text", relabel: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language: not `und`, and with a score of least or more.

    Null texts and those without a letter go; repeated rows are judged each; an empty table stays one. relabel names a
    string column that then holds the predicted language.
    """

    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow takes no names with dots
    text, label = (docs.columns.index(c) if c else None for c in (text_col, relabel))

    def run(batches):
        for b in batches:
            found = [profiles.predict(t.as_py() or "") for t in b.column(text)]
            if label is not None:
                b = b.set_column(label, b.schema.field(label).with_nullable(True), pa.array([x for x, _ in found], b.schema.field(label).type))
            yield b.filter(pa.array([score >= least and score > 0 for _, score in found], pa.bool_()))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def fold(id_column) -> F.Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(3))
