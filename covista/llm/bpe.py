"""Byte-level BPE by overlapping chunks: chunks are rows, each pre-tokenised and encoded apart, and stitched where their boundaries meet again.

A text is cut near every chunk-th character. A chunk is read with what surrounds it, so that both chunks at a cut find
the same place for it: the first boundary in the overlap that pre-tokens from before the cut and pre-tokens from the cut
on both have. Whether that place is a boundary of the whole text follows from the chunk before: its pre-tokens begin at a
proven boundary (the first chunk's at the text's start), and must have a boundary there. A chunk checks this for its own
end; if all chunks of a text say so, all cuts are proven, one after the other. Other texts are encoded as one piece.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, scratch_table, texts, to_batch

CHUNK, OVERLAP = 16_384, 512

_CODECS: dict[tuple, "Codec"] = {}


class Codec:
    """Encoder and decoder for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.digits_of = {i: str(i) for i in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.chunk, self.overlap = chunk, overlap

    def boundaries(self, text: str, start: int, end: int) -> set[int]:
        """Where pre-tokens of text[start:end] end, if it is read by itself."""
        return {m.end() + start for m in self.pattern.finditer(text[start:end])}

    def cut(self, text: str, at: int) -> int | None:
        """The place of the cut near at, from text[at - overlap : at + 2 * overlap] alone; None where there is none.

        The character before a cut is no white space: a run of white space looks one character ahead, so it mustn't end
        a piece. A pre-token that ends within two characters of what is read may be longer in the whole text.
        """
        o = self.overlap
        end = min(len(text), at + 2 * o)
        both = self.boundaries(text, at - o, end) & self.boundaries(text, at, end)
        return min((b for b in both if at < b < at + o - 1 and b < end - 1 and not text[b - 1].isspace()), default=None)

    def chunk_ids(self, text: str, first: bool, last: bool) -> tuple[list[int], bool]:
        """The ids of one chunk, and whether its end is proven if its start is.

        text is the chunk and what surrounds it: overlap characters before it (unless it is the first one) and twice as
        many after it (as far as there are any; last tells that it is the text's last chunk).
        """
        o = self.overlap
        at = 0 if first else self.cut(text, o)
        if at is None:
            return [], False
        if last:
            return self.encoding.encode_ordinary(text[at:]), True
        end = self.cut(text, self.chunk + (0 if first else o))
        if end is None or end <= at or end not in self.boundaries(text, at, len(text)):
            return [], False
        return self.encoding.encode_ordinary(text[at:end]), True

    def chunks(self, text: str) -> list[tuple[str, bool, bool]]:
        """The chunks of a text with their surroundings, as chunk_ids() takes them; chunk_rows() does the same with columns."""
        n = self.count(len(text))
        return [(text[max(0, k * self.chunk - self.overlap) : (k + 1) * self.chunk + 2 * self.overlap if k < n - 1 else None], k == 0, k == n - 1) for k in range(n)]

    def count(self, length: int) -> int:
        return max(1, -(-(length - 2 * self.overlap) // self.chunk))

    def encode(self, text: str) -> list[list[int]]:
        """Ids, by chunk."""
        parts = [self.chunk_ids(*c) for c in self.chunks(text)]
        return [ids for ids, _ in parts] if all(ok for _, ok in parts) else [self.encoding.encode_ordinary(text)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Codec:
    """One for each process, file and size of chunks."""
    key = path, pattern, chunk, overlap
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns keep and text_col of docs, with ids (array<int>): the tokens of each whole text, null as empty.

    A text of one chunk is encoded where it is read. Of longer ones the chunks are rows of their own, dealt over all
    tasks, and their ids are put together again by text; no task encodes more than a chunk at a time. A text whose cuts
    aren't proven is encoded as a whole.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{text_col}` string", "ids array<int>"])
    rows = docs.select(*[F.col(quoted(c)) for c in keep], F.coalesce(F.col(quoted(text_col)), F.lit("")).alias(text_col))
    length, longest = F.length(F.col(quoted(text_col))), chunk + 2 * overlap

    def whole(batches):
        c = codec(path, pattern, chunk, overlap)
        for all_ in batches:
            for at in range(0, all_.num_rows, 256):
                b = all_.slice(at, 256)
                found = [np.array(c.encoding.encode_ordinary(t), np.int32) for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(found)], [*b.schema.names, "ids"])

    def by_chunk(batches):
        c, schema = codec(path, pattern, chunk, overlap), pa.schema([("rid", pa.int64()), ("nth", pa.int32()), ("ids", pa.list_(pa.int32())), ("ok", pa.bool_())])
        for b in batches:
            for i, k, n, text in zip(b.column("rid").to_pylist(), b.column("nth").to_pylist(), b.column("n").to_pylist(), b.column("part").to_pylist(), strict=True):
                ids, ok = c.chunk_ids(text, k == 0, k == n - 1)
                yield to_batch({"rid": [i], "nth": [k], "ids": [np.array(ids, np.int32)], "ok": [ok]}, schema)

    short = rows.where(length <= longest).mapInArrow(whole, ddl)
    long = scratch_table(rows.where(length > longest).withColumn("_rid", F.monotonically_increasing_id()))
    # cut in one pass over the text; get() gives null beyond the last piece
    pieces = long.select(F.col("_rid").alias("rid"), F.ceil((length - 2 * overlap) / chunk).cast("int").alias("n"), F.regexp_extract_all(F.col(quoted(text_col)), F.lit(f"(?s)(.{{1,{chunk}}})"), F.lit(1)).alias("p"))
    piece = lambda k: F.coalesce(F.get("p", k), F.lit(""))
    after = lambda k: F.concat(piece(k + 1), piece(k + 2))
    part = lambda k: F.concat(F.when(k > 0, F.right(piece(k - 1), F.lit(overlap))).otherwise(""), piece(k), F.when(k == F.col("n") - 1, after(k)).otherwise(F.left(after(k), F.lit(2 * overlap))))
    parts = pieces.select("rid", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), part)).alias("nth", "part")).repartition("rid", "nth")
    parts = scratch_table(parts.mapInArrow(by_chunk, "rid long, nth int, ids array<int>, ok boolean"))
    ids = parts.groupBy("rid").agg(F.min("ok").alias("_ok"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ids"))), lambda x: x["ids"])).alias("ids"))
    met = long.join(ids, F.col("_rid") == F.col("rid"))
    kept = [F.col(quoted(c)) for c in (*keep, text_col)]
    return short.unionByName(met.where("_ok").select(*kept, "ids")).unionByName(met.where("not _ok").select(*kept).mapInArrow(whole, ddl))


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for each row: the tokens of the whole text, without special tokens.

    A null or empty text has no tokens. Repeated rows are encoded each; a null id stays null; other columns are left out;
    an empty table gives no rows. path is a file of ranks that every executor has.
    """
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return encoded(rows, path, pattern, ("doc_id",), "text", chunk, overlap).select("doc_id", "ids")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids): the raw bytes of the ids, one after the other. Null ids count as none; an empty table gives no rows."""

    def run(batches):
        c, schema = codec(path, pattern), pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            yield to_batch({"doc_id": b.column("doc_id"), "bytes": [c.decode(x or []) for x in b.column("ids").to_pylist()]}, schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip.

    Nulls, repeats and empty tables as in encode().
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            out = {f.name: [] for f in schema}
            for i, text, found in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("ids"), strict=True):
                ids = found.values.to_numpy().tolist()  # as_py() makes an Arrow scalar of each id
                raw = c.decode(ids)
                row = i, len(ids), hashlib.sha256(" ".join(map(c.digits_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == text.as_py().encode()
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield to_batch(out, schema)

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return encoded(rows, path, pattern, ("doc_id",)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def tokenised(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep of docs with n_tokens, ids (array<int>) and intact: whether the decoded ids are the text again.

    keep may not name the text or the new columns. Nulls, repeats and empty tables as in encode().
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long", "ids array<int>", "intact boolean"])

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = b.column("ids").to_pylist()
                intact = [c.decode(x) == t.encode() for x, t in zip(ids, b.column(text_col).to_pylist(), strict=True)]
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), n, b.column("ids"), pa.array(intact, pa.bool_())], [*keep, "n_tokens", "ids", "intact"])

    return encoded(docs, path, pattern, keep, text_col).mapInArrow(run, ddl)
