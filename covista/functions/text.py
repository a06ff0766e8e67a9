"""Small text formats: angles and lengths with units, option lists, ids, paths, frame patterns, selections and slices."""

from __future__ import annotations

import math
import posixpath
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of each unit of length.
METRES = {"nm": 1e-9, "um": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}
#: Pair ids are this many times the smaller id plus the larger one; a fixed value of the public database format.
MOST_IMAGES = 2147483647
_ANGLE, _LENGTH = r"([+-]?[0-9.]+)(deg|degrees|rad|radians)", r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([a-z]*)"
_POINT_ID = r"pt3d_([0-9a-f]{8})_([0-9]+)"


def angle(text: str) -> float:
    """Radians of a text such as 90deg or 1.57rad."""
    if not (m := re.fullmatch(_ANGLE, text.strip())):
        raise ValueError(f"not an angle: {text!r}")
    return math.radians(float(m[1])) if m[2].startswith("deg") else float(m[1])


def angle_column(c: Column) -> Column:
    """angle() of each row; null where it is none."""
    c = F.trim(c)
    value = F.regexp_extract(c, f"^{_ANGLE}$", 1)
    parsed = F.when(value != "", value.try_cast("double"))
    return F.when(F.regexp_extract(c, f"^{_ANGLE}$", 2).startswith("deg"), F.radians(parsed)).otherwise(parsed)


def length(value: str | float, unit: str) -> float:
    """A length above 0 in unit; a bare number is in unit already."""
    if isinstance(value, (int, float)):
        number, suffix = float(value), ""
    else:
        if not (m := re.fullmatch(_LENGTH, value.strip())):
            raise ValueError(f"not a length: {value!r}")
        number, suffix = float(m[1]), m[2]
    if not number > 0:
        raise ValueError(f"a length must be above 0: {value!r}")
    if suffix and suffix not in METRES or unit not in METRES:
        raise ValueError(f"no unit {suffix or unit!r}")
    return number * METRES[suffix] / METRES[unit] if suffix else number


def length_column(c: Column, unit: str) -> Column:
    """length() of each row; null where it is none."""
    metres = F.create_map(*[F.lit(x) for k, v in METRES.items() for x in (k, v)])
    c = F.trim(c)
    number, suffix = F.regexp_extract(c, f"^{_LENGTH}$", 1), F.regexp_extract(c, f"^{_LENGTH}$", 2)
    parsed = F.when(number != "", number.try_cast("double"))
    return F.when(parsed > 0, F.when(suffix == "", parsed).otherwise(parsed * F.try_element_at(metres, suffix) / METRES[unit]))


def truth(text: str) -> bool:
    """true, 1, yes, on; false, 0, no, off."""
    word = text.strip().lower()
    if word not in ("true", "1", "yes", "on", "false", "0", "no", "off"):
        raise ValueError(f"not a truth value: {text!r}")
    return word in ("true", "1", "yes", "on")


def options(text: str, kinds: Mapping[str, Callable[[str], object]]) -> dict:
    """The values of key=value,... by kind; empty parts are skipped, unknown keys, bare words and values that don't parse refused."""
    out = {}
    for part in filter(None, map(str.strip, text.split(","))):
        key, sign, value = (x.strip() for x in part.partition("="))
        if not sign or not key:
            raise ValueError(f"expected key=value: {part!r}")
        if key not in kinds:
            raise ValueError(f"unknown key {key!r}; known: {', '.join(sorted(kinds))}")
        try:
            out[key] = kinds[key](value)
        except ValueError as e:
            raise ValueError(f"{key}: {value!r} is no {kinds[key].__name__}") from e
    return out


def indexes(text: str) -> list[int]:
    """The numbers of a list such as 0+1+3."""
    return [int(x) for x in text.split("+") if x.strip()]


def point_id(digest: str, index: int) -> str:
    return f"pt3d_{digest[:8]}_{index}"


def parsed_point_id(text: str) -> tuple[str, int]:
    if not (m := re.fullmatch(_POINT_ID, text)):
        raise ValueError(f"not a point id: {text!r}")
    return m[1], int(m[2])


def point_id_columns(c: Column) -> tuple[Column, Column]:
    """(digest, index) of point ids; nulls where it is none."""
    digest = F.regexp_extract(c, f"^{_POINT_ID}$", 1)
    return F.when(digest != "", digest), F.when(digest != "", F.regexp_extract(c, f"^{_POINT_ID}$", 2).try_cast("long"))


def pair_id(a: Column, b: Column) -> Column:
    """One integer for an unordered pair of ids from 1 on; null where an id is out of range."""
    ok = (F.least(a, b) > 0) & (F.greatest(a, b) < MOST_IMAGES)
    return F.when(ok, F.least(a, b).cast("long") * MOST_IMAGES + F.greatest(a, b).cast("long"))


def ids_of_pair(pair: Column) -> tuple[Column, Column]:
    big = F.pmod(pair, F.lit(MOST_IMAGES))
    return ((pair - big) / MOST_IMAGES).cast("long"), big.cast("long")


def workspace_path(text: str) -> str:
    """A relative path with forward slashes and without . and ..; one that is absolute, or leads out, is refused."""
    path = text.replace("\\", "/")
    out = posixpath.normpath(path)
    if path.startswith("/") or re.match(r"[A-Za-z]:", path) or out == ".." or out.startswith("../"):
        raise ValueError(f"not a path within the workspace: {text!r}")
    return out


def path_column(c: Column) -> Column:
    """Forward slashes, single ones, without . parts; null where workspace_path() would refuse, .. parts resolved from left to right."""
    slashed = F.regexp_replace(c, r"\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(s, part):
        up = part == ".."
        left = F.when(up, F.when(F.size(s["out"]) > 0, F.slice(s["out"], F.lit(1), F.greatest(F.lit(0), F.size(s["out"]) - 1))).otherwise(s["out"])).otherwise(F.concat(s["out"], F.array(part)))
        return F.struct(left.alias("out"), (s["ok"] & ~(up & (F.size(s["out"]) == 0))).alias("ok"))

    end = F.aggregate(parts, start, step)
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:")
    return F.when(~bad & end["ok"], F.when(F.size(end["out"]) == 0, ".").otherwise(F.array_join(end["out"], "/")))


_FIELD = re.compile(r"%%|%(?:0([0-9]+))?d")


def pattern_glob(pattern: str) -> str:
    """A loose file pattern: each frame field (%d, %04d) is a *, and %% a %."""
    return _FIELD.sub(lambda m: "%" if m[0] == "%%" else "*", pattern)


def pattern_regex(pattern: str) -> str:
    """A regular expression for whole relative paths; the frame field is its first group, as it would be printed.

    %04d takes 0007 and 12345, but not 007 or 00012; %d takes 7, but not 07. * stands for characters of one part of the
    path, ** for any number of parts.
    """
    out, at, fields = "", 0, 0
    while at < len(pattern):
        if m := _FIELD.match(pattern, at):
            if m[0] == "%%":
                out += "%"
            else:
                width = int(m[1] or 1)
                number = "0|[1-9][0-9]*" if width <= 1 else rf"[0-9]{{{width}}}|[1-9][0-9]{{{width},}}"
                out += f"({number})" if not fields else r"\1"
                fields += 1
            at = m.end()
        elif pattern.startswith("**/", at):
            out, at = out + r"(?:[^/]+/)*", at + 3
        elif pattern.startswith("**", at):
            out, at = out + r".+", at + 2
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        else:
            out, at = out + re.escape(pattern[at]), at + 1
    return f"^{out}$"


def _flags(ignore_case: bool) -> str:
    return "(?i)" if ignore_case else ""


def pattern_matches(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    return path.rlike(_flags(ignore_case) + pattern_regex(pattern))


def pattern_frame(path: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The frame number that the pattern's frame field takes from a path; null without a field or a match, or where it fits no long."""
    regex = _flags(ignore_case) + pattern_regex(pattern)
    if not any(m[0] != "%%" for m in _FIELD.finditer(pattern)):
        return F.lit(None).cast("long")
    return F.when(path.rlike(regex), F.regexp_extract(path, regex, 1).try_cast("long"))


@dataclass(frozen=True)
class Slice:
    start: int | None = None
    stop: int | None = None
    step: int | None = None


def name_and_slice(text: str) -> tuple[str, Slice | None]:
    """The name and the slice of name[start:stop:step]; a slice needs a colon, and its step mustn't be 0."""
    name, bracket, rest = text.partition("[")
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
        raise ValueError(f"not the name of a list: {text!r}")
    if not bracket:
        return name, None
    if not (m := re.fullmatch(r"\s*([+-]?\d+)?\s*:\s*([+-]?\d+)?\s*(?::\s*([+-]?\d+)?\s*)?\]", rest)):
        raise ValueError(f"not a slice: {text!r}")
    out = Slice(*(int(x) if x else None for x in m.groups()))
    if out.step == 0:
        raise ValueError(f"a slice's step mustn't be 0: {text!r}")
    return name, out


def sliced(df: DataFrame, order: str, cut: Slice) -> DataFrame:
    """The rows at the positions that a slice keeps of df in the order of a column, with nth, their place in the slice."""
    n = df.count()
    start, stop, step = slice(cut.start, cut.stop, cut.step).indices(n)
    from covista.operators.tables import numbered

    x = numbered(df, order, out="__at")
    inside = (F.col("__at") >= start) & (F.col("__at") < stop) if step > 0 else (F.col("__at") <= start) & (F.col("__at") > stop)
    return x.where(inside & (F.pmod(F.col("__at") - start, F.lit(abs(step))) == 0)).withColumn("nth", ((F.col("__at") - start) / step).cast("int")).drop("__at")


@dataclass(frozen=True)
class Selection:
    """What a list of selection texts asks for: numbers, or a named list with a slice."""

    ranges: tuple[tuple[int, int, int], ...] = ()
    named: str | None = None
    cut: Slice | None = None


def selection(values: list[str], named: str | None = None) -> Selection:
    """Ranges of file numbers (1-10,20,30-40:5), of which several are joined, or one named list; not both."""
    from covista.operators.filters import ranges

    found, lists = [], [named] if named else []
    for v in values:
        (found.extend(ranges(v)) if v[:1].isdigit() else lists.append(v))
    if len(lists) > 1 or lists and found:
        raise ValueError("either ranges or one named list")
    return Selection(tuple(found), *(name_and_slice(lists[0]) if lists else (None, None)))


def sequence_of_name(name: Column) -> tuple[Column, Column]:
    """(sequence, number): the name without its last number and extension, and that number; nulls without a number."""
    number = F.regexp_extract(name, r"(\d+)\)?(?:\.[A-Za-z0-9]+)?$", 1)
    stem = F.regexp_replace(name, r"\(?\d+\)?(?:\.[A-Za-z0-9]+)?$", "")
    return F.when(number != "", stem), F.when(number != "", number.try_cast("long"))
