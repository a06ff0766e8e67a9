"""Secret scan: fixed patterns, and credential-context values whose guess cost is high.

The guess cost of a value is the least, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force spans, of the product of the spans' guesses.
"""

from __future__ import annotations

import base64
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, to_batch

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential, with whatever prefix; of `pass`, the common words that end in it are left out.
_HEAD = r"(?=[pstac])(?:pass(?:word|wd|phrase|code|(?<!compass)(?<!bypass)(?<!trespass)(?<!surpass)(?<!overpass)(?<!underpass))|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth[_-]?key|private[_-]?key)[\"']?(?:\x20*(?:[:=]|=>)\x20*|\x20+is\x20+)"
CONTEXT = re.compile(_HEAD, re.I | re.A)
#: A value in quotes, up to its closing quote in the same line.
QUOTED = re.compile(r"([\"'`])((?:(?!\1)(?:\\[^\r\n]|[^\r\n\\]))*)\1")
#: A bare value is a run of visible ASCII characters, up to the next announcing word or name and value; it may end at a delimiter before.
RUN = re.compile(rf"(?:(?!{_HEAD})(?![,;&<\"'`][\"']?[\w.-]+[\"']?[:=])[!-~])*", re.I | re.A)
PIECE = re.compile(r"[^,;&<\"'`]*")
#: A value is reported where the logarithm (base 10) of its guesses is this or more.
HARD = 8.0
#: Common words of passwords, the most common first; a fixed list.
WORDS = (
    "password pass admin welcome login master dragon monkey letmein shadow sunshine princess football baseball superman "
    "batman trustno hello freedom whatever secret token test guest root user default change changeme example sample "
    "summer winter spring autumn monday friday january february march april june july august september october november "
    "december love house orange apple banana cookie flower purple silver golden ginger pepper hunter ranger soccer hockey "
    "michael jordan daniel thomas robert jessica charlie andrew michelle jennifer key value none null true false string "
    "your the and for with this that here there word name mail data file server cloud access public private temp demo"
).split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4310$57!", "aaeiossti")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: The logarithm of the guesses for one character, by its class.
CLASSES = ((str.isdigit, math.log10(10)), (str.islower, math.log10(26)), (str.isupper, math.log10(26)))
OTHER = math.log10(33)
_RANK = {w: math.log10(2 + i) for i, w in reversed(list(enumerate(WORDS)))}
#: Words of a ranked vocabulary are this long at least and at most.
SHORTEST, LONGEST = 3, 20
_RANKED: dict[str, dict[str, float]] = {}
_NEXT = {(a, b) for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}


def ranked_words(path: str | None) -> dict[str, float]:
    """Words and the logarithm of the guesses for each: WORDS first, then the words of a file of byte-level BPE ranks, in its order.

    A vocabulary is ordered by frequency; of it, entries of lower-case letters that stand after a blank are words. Read
    once for each process; without a path, WORDS alone.
    """
    if not path:
        return _RANK
    if path not in _RANKED:
        with open(path, "rb") as f:
            entries = (base64.b64decode(line.split()[0]) for line in f)
            words = [e[1:].decode() for e in entries if e[:1] == b" " and SHORTEST < len(e) <= LONGEST + 1 and e[1:].isascii() and e[1:].isalpha() and e[1:].islower()]
        _RANKED[path] = {w: math.log10(2 + len(WORDS) + i) for i, w in reversed(list(enumerate(words)))} | _RANK
    return _RANKED[path]


def _spans(value: str, brute: list[float], ranks: dict[str, float] = _RANK) -> list[list[tuple[int, float]]]:
    """For each end, the (start, cost) of the spans that end there, brute force aside."""
    n, out = len(value), [[] for _ in range(len(value) + 1)]
    low = value.lower()
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j])
            if rank is None and (rank := ranks.get(plain[i:j])) is not None:
                rank += math.log10(2 + sum(a != b for a, b in zip(low[i:j], plain[i:j])))
            if rank is not None:
                upper = sum(c.isupper() for c in value[i:j])
                out[j].append((i, rank + (math.log10(2) if upper in (1, j - i) else math.log10(1 + upper) if upper else 0)))
    for m in DATE.finditer(value):
        out[m.end()].append((m.start(), math.log10(365 * 100 if m.end() - m.start() > 6 else 100 * 12)))
    i = 0
    while i < n:  # maximal walks over neighbouring keys and through the alphabet
        j = i + 1
        while j < n and (low[j - 1], low[j]) in _NEXT:
            j += 1
        if j - i >= 3:
            out[j].append((i, math.log10(40 * (j - i))))
        i = max(j - 1, i + 1) if j - i >= 3 else i + 1
    for period in range(1, 9):  # maximal repeats of a short unit
        i = 0
        while i + period < n:
            j = i + period
            while j < n and value[j] == value[j - period]:
                j += 1
            if j - i >= max(3, 2 * period):
                out[j].append((i, brute[i + period] - brute[i] + math.log10((j - i) / period)))
                i = j - period + 1
            else:
                i = max(i + 1, j - period + 1)
    return out


def guess_cost(value: str, ranks: dict[str, float] = _RANK) -> tuple[float, list[tuple[int, int]]]:
    """The base-10 logarithm of the guesses for value, and the spans of a cheapest segmentation that no brute force takes.

    Dynamic programming from left to right; a brute-force span costs its characters one by one, so the work grows with
    the length of the value alone. Each further span costs a factor of 2, for not knowing how spans follow each other.
    """
    n = len(value)
    brute = [0.0] * (n + 1)
    for k, c in enumerate(value):
        brute[k + 1] = brute[k] + next((x for is_, x in CLASSES if is_(c)), OTHER)
    ends, join = _spans(value, brute, ranks), math.log10(2)
    # least cost of value[:j] if its last span is brute force, and if it is not
    rough, known = [0.0] + [math.inf] * n, [0.0] + [math.inf] * n
    was, start = [False] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        more = brute[j] - brute[j - 1]
        fresh = known[j - 1] + (join if j > 1 else 0)
        rough[j], was[j] = (fresh + more, True) if fresh < rough[j - 1] else (rough[j - 1] + more, False)
        for i, cost in ends[j]:
            if (x := min(rough[i], known[i]) + cost + (join if i else 0)) < known[j]:
                known[j], start[j] = x, i
    spans, j, by_brute = [], n, rough[n] <= known[n]
    while j:
        if by_brute:
            by_brute, j = not was[j], j - 1
        else:
            spans.append((start[j], j))
            j = start[j]
            by_brute = rough[j] <= known[j]
    return min(rough[n], known[n]), spans[::-1]


def _values(text: str, at: int) -> list[tuple[int, int]]:
    """What the value that begins at a place may be, as (start, end); the likelier one first."""
    if m := QUOTED.match(text, at):
        return [m.span(2)]
    at += text[at : at + 1] in ("'", '"')
    run = RUN.match(text, at).group()
    ends = [len(x.rstrip("\"'`,;.)]}>")) for x in (PIECE.match(run).group(), run)]
    return [(at, at + n) for n in dict.fromkeys(ends)]


def scan(text: str, hard: float = HARD, ranks: dict[str, float] = _RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed in KINDS.

    `guess` are values after a word that announces a credential, whose guess cost is hard or more; they may overlap
    other spans. A bare value that is short or easy up to its first delimiter is tried with what follows, too.
    """
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        for s, e in _values(text, m.end()):
            if e - s >= 6 and guess_cost(text[s:e], ranks)[0] >= hard:
                found.append(("guess", s, e))
                break
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, hard: float = HARD, words: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row, over its whole text.

    words is the path, on every executor, of a ranked vocabulary (ranked_words). A null or empty text has no spans.
    Repeated rows get a row each; other columns are left out; an empty table gives no rows. Texts are read whole, however
    long. Spans stand by their start, at one place in the order of KINDS.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        ranks = ranked_words(words)
        for b in batches:
            out = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t.as_py(), hard, ranks)] for t in b.column("text")]
            yield to_batch({"doc_id": b.column("doc_id"), "spans": out}, schema)

    return texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets(): n_assign, n_access, n_hex, base_sha256, spans, n_guess."""
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(line(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"), line("spans").alias("spans"), count("guess"))
