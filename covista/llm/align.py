"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, which of their tokens overlap, and how often two ids meet.

A is a byte-level BPE in a tokenizers file, and reads a blank and the text; B is a piece model with byte fallback, and
reads the text, before which it puts the blank itself. So both spell the same bytes, or the text has no tokens.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table, slices, texts, to_batch

#: Characters of a text that are encoded at a time, about; of texts that are encoded together.
CHUNK = 1 << 16
#: Pairs of ids that are broadcast: those in more than one in so many of all (document, pair) rows, so no more than so many.
HEAVY = 1 << 16
#: Parts of a pair's count in the first of two sums.
SALTS = 16

_PAIRS: dict[tuple, "Pair"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are their own, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    #: A place that both cut a text at: a blank between letters or digits. Neither has a token with a blank after one.
    CUT = regex.compile(r"(?<=[^\W_]) (?=[^\W_])")
    INNER = regex.compile(r"[^\W_] ")

    def __init__(self, a_path: str, b_path: str, chunk: int = CHUNK):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *special.values()]) + 1
        self.a_bytes = [b""] * size
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.encode_a = self._ranked(spec, special) or self._file(a_path)
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.encode_b = lambda texts: model.encode(texts, num_threads=1)
        self.a_len, self.b_len = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_spelt, self.b_spelt = (np.array([*v, None], object)[:-1] for v in (self.a_bytes, self.b_bytes))
        inner = any(self.INNER.search(x.decode("utf-8", "replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.chunk = None if inner else chunk

    def _ranked(self, spec: dict, special: dict):
        """An encoder that takes a token's id for its rank, which is quicker; None where merges have another order."""
        import public_tokenizers
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        plain = {t: i for t, i in vocab.items() if t not in special}
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        if [plain.get(m) for m in made] != list(range(256, 256 + len(made))) or len(plain) != 256 + len(made) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        codec = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in plain.values()}, special_tokens={})
        return lambda texts: [codec.encode_to_numpy(t, disallowed_special=()) for t in texts]

    @staticmethod
    def _file(path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The text in pieces that are encoded apart: both tokenizers put a blank before a piece, in place of the one that is cut out."""
        out, at = [], 0
        while self.chunk and len(text) - at > self.chunk and (m := self.CUT.search(text, at + self.chunk)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both for each text; none where they don't spell a blank and the text."""
        cut = [self.pieces(t) if t else [] for t in texts]
        flat = [p for x in cut for p in x]
        both, at = [], 0
        while at < len(flat):
            end, size = at, 0
            while end < len(flat) and (end == at or size + len(flat[end]) <= CHUNK):
                size += len(flat[end])
                end += 1
            both += zip(flat[at:end], self.encode_a([" " + p for p in flat[at:end]]), self.encode_b(flat[at:end]), strict=True)
            at = end
        out, k = [], 0
        for x in cut:
            own = [(p, np.asarray(a, np.int64), np.asarray(b, np.int64)) for p, a, b in both[k : k + len(x)]]
            k += len(x)
            if any(b"".join(self.a_spelt[a].tolist()) != (w := b" " + p.encode()) or b"".join(self.b_spelt[b].tolist()) != w for p, a, b in own):
                own = []
            out.append(tuple(np.concatenate([np.empty(0, np.int64), *(o[side] for o in own)]) for side in (1, 2)))
        return out


def pair(a_path: str, b_path: str, chunk: int = CHUNK) -> Pair:
    """One for each process and files."""
    key = a_path, b_path, chunk
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def alignment(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the tokens' bytes: each A and each B token's group, and for each link its A and its B token, by number.

    Groups end where tokens of both end; a link is an A and a B token that share a byte.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    first = np.searchsorted(b_end, a_end - a_len, side="right")
    times = np.searchsorted(b_end, a_end) - first + 1
    of = np.repeat(np.arange(len(a_end)), times)
    to = np.arange(len(of)) + np.repeat(first - (np.cumsum(times) - times), times)
    return np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end), of, to


def _endings(size: int = 1 << 17) -> dict[str, np.ndarray]:
    """For each ending the decimal numbers below size with it; made once."""
    if not _ENDINGS or len(_ENDINGS[","]) < size:
        _ENDINGS.update({e: np.array([f"{i}{e}" for i in range(size)], object) for e in ",|;"})
    return _ENDINGS


_ENDINGS: dict[str, np.ndarray] = {}


def group_line(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
    """The groups as text: ids of A by commas, |, ids of B by commas; groups by semicolons."""
    if not len(a):
        return ""
    ends, out = _endings(max(1 << 17, int(max(a.max(), b.max())) + 1)), np.empty(len(a) + len(b), object)
    # each id's place among all: after the ids of its side, and after the other side's of the groups before (or up to its own)
    for ids, group, other, side, last in ((a, a_group, b_group, "left", "|"), (b, b_group, a_group, "right", ";")):
        words, final = ends[","][ids], np.concatenate((group[1:] != group[:-1], [True]))
        words[final] = ends[last][ids[final]]
        out[np.arange(len(ids)) + np.searchsorted(other, group, side=side)] = words
    return "".join(out.tolist())[:-1]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times.

    pairs are the distinct pairs of ids that are linked (A * 2^32 + B), times how many links each has. A text that is
    null, empty, or not spelt by both has no tokens: zeros, '' and no pairs.
    """
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        p = pair(a_path, b_path, chunk)
        for part in slices(batches, 64):
            out = {f.name: [] for f in schema}
            out["rid"], out["doc_id"] = part.column("rid"), part.column("doc_id")
            for a, b in p.encode(part.column("text").to_pylist()):
                ga, gb, of, to = alignment(p.a_len[a], p.b_len[b])
                pairs, times = np.unique(a[of] << 32 | b[to], return_counts=True)
                row = len(a), len(b), int(ga[-1]) + 1 if len(a) else 0, len(of), hashlib.sha256(group_line(a, b, ga, gb).encode()).hexdigest() if len(a) else "", pairs, times.astype(np.int32)
                for name, value in zip(schema.names[2:], row, strict=True):
                    out[name].append(value)
            yield to_batch(out, schema)

    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(table: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n, best): in how many rows of an aligned() table each pair is linked, and whether no pair of its A id is in more.

    Two sums, the first by pair and salt, so that a pair that all rows have is summed by several tasks.
    """
    rows = table.select(F.explode("pairs").alias("pair"), F.pmod("rid", F.lit(salts)).alias("salt"))
    counts = rows.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch_table(counts)
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    return counts.join(scratch_table(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links are the pairs of an A and a B token that share bytes; a pair of ids counts the rows that have it linked;
    count_sum sums the counts over a row's links, n_best are its links whose count is the highest of their A id. A text
    that is null, empty, or that the tokenizers spell differently has no tokens: zeros and ''. Repeated rows, and rows
    that share an id, are rows of their own; a null id stays null; other columns are left out; an empty table gives no
    rows. Long texts are encoded in pieces, cut where both tokenizers cut.

    Of all (row, pair) rows each heavy pair has more than one in `heavy`, so there are fewer than `heavy` of them: these
    are broadcast. The other pairs, of which none is hot, are joined with their rows.
    """
    table = scratch_table(aligned(docs, a_path, b_path, id_col, text_col, chunk))
    counts = scratch_table(pair_counts(table))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * heavy > total
    small = counts.where(often).select(F.col("pair").alias("p"), "n", "best")
    rows = table.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = rows.join(F.broadcast(small), F.col("pair") == F.col("p"), "left")
    summed = (F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    light = met.where("p is null").select("rid", "pair", "times").join(counts.where(~often), "pair").select("rid", "times", "n", "best")
    sums = met.where("p is not null").select("rid", "times", "n", "best").unionByName(light).groupBy("rid").agg(*summed)
    out = table.drop("pairs", "times").join(scratch_table(sums), "rid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def brute_force(rows: list[tuple[int, str | None]], a_path: str, b_path: str) -> list[tuple]:
    """The same by the tokenizers' own libraries and byte by byte. For tests."""
    from collections import Counter, defaultdict

    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    t.encode_special_tokens = True
    letters, found = byte_letters(), []
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        spelt_a = [bytes(letters[c] for c in t.id_to_token(x)) for x in a]
        spelt_b = [bytes([int(s.id_to_piece(x)[3:5], 16)]) if s.is_byte(x) else s.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or not b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        owner = [[k for k, v in enumerate(spelt) for _ in v] for spelt in (spelt_a, spelt_b)]
        links = sorted(set(zip(*owner, strict=True)))
        groups, ga, gb = [], [], []
        for at, (x, y) in enumerate(zip(*owner, strict=True)):
            ga += [x] if x not in ga[-1:] else []
            gb += [y] if y not in gb[-1:] else []
            if at + 1 == len(owner[0]) or (owner[0][at + 1] != x and owner[1][at + 1] != y):
                groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
                ga, gb = [], []
        found.append((i, a, b, groups, [(a[x], b[y]) for x, y in links]))
    counts = Counter(p for *_, links in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(i, len(a), len(b), len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in found]
