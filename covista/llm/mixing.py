"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities. DataFrame functions only."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, scratch_table

DIMENSIONS = ("source", "lang", "topic")
#: Without targets, a value's target weight is its own tokens to this power: below 1, small ones gain.
FLATTEN = 0.5
#: Rounds of raking between measurements of the error, and the share of all tokens that the sample shall have.
ROUNDS, BUDGET = 6, 0.5
#: Raking goes on until no value's tokens in the sample are further from their target than this, as a part of it.
TOLERANCE = 1e-9
#: Targets count as out of reach where twice the rounds leave more than this part of the error; tried so many times ROUNDS at least.
STALLED, TRIES = 0.9, 10
#: Up to so many cells are sent to every executor; more are joined by shuffling both sides.
BROADCAST_CELLS = 50_000
#: Up to so many cells are raked by windows in one task; more by a shuffle and a written table for each step.
TASK_CELLS = 50_000
Targets = Mapping[str, Mapping[str, float]]
NONE = "(none)"

_WORD = r"[^\x20\x09-\x0D]+"
_DIGIT = "[0-9]"
_MARK = r"[!-/:-@\[-`{-~]"


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, own: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) for each row, and own where given; see topic_and_tokens()."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    kind, tokens = topic_and_tokens(text)
    return docs.select(*([own.alias("own")] if own is not None else []), F.col(quoted(id_col)).alias("doc_id"), value(F.col(quoted(source_col))).alias("source"), value(F.col(quoted(lang_col))).alias("lang"), kind if topic is None else value(topic).alias("topic"), tokens)


def topic_and_tokens(text: Column) -> tuple[Column, Column]:
    """What kind of text it is, by its characters (empty, marked up, numeric, short, prose), and its number of words."""
    n = F.length(text)
    without = lambda pattern: n - F.length(F.regexp_replace(text, pattern, ""))
    tokens = F.length(F.regexp_replace(text, _WORD, "x")) - F.length(F.regexp_replace(text, _WORD, ""))
    topic = F.when(tokens == 0, "empty").when(without(_MARK) * 100 > n * 8, "marked").when(without(_DIGIT) * 100 > n * 5, "numeric").when(tokens < 100, "short").otherwise("prose")
    return topic.alias("topic"), tokens.cast("long").alias("tokens")


def cells_of(described_: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): the tokens of each combination that has any."""
    return described_.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def goals(cells: DataFrame, d: str, budget: float = BUDGET, targets: Targets | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(d, t): how many tokens of each of the dimension's values the sample shall have; budget times all tokens in sum.

    Values share by their target weights, targets[d], or, where that is not given, by their tokens to the power flatten; a
    value that targets[d] doesn't name gets none. No value gets more than there is: what it can't take goes to the others
    in proportion, in as many passes over the values as it takes.
    """
    given = (targets or {}).get(d)
    rows = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have"))
    if given is None:
        rows = rows.withColumn("share", F.pow("have", F.lit(flatten)))
    else:
        pairs = [F.lit(x) for v, x in given.items() for x in (v, float(x))]
        rows = rows.withColumn("share", F.coalesce(F.create_map(*pairs)[F.col(d)] if pairs else F.lit(None), F.lit(0.0)))
    rows = scratch_table(rows)
    aim, level, before = budget * (rows.agg(F.sum("have")).first()[0] or 0.0), 0.0, -1
    while True:
        full = F.col("share") * F.lit(level) >= F.col("have")
        s = rows.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("have")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
        if s["n"] == before or not s["open"]:
            break
        before, level = s["n"], (aim - s["full"]) / s["open"]
    return rows.select(d, F.least("have", F.col("share") * F.lit(level)).alias("t"))


def rake(cells: DataFrame, budget: float = BUDGET, targets: Targets | None = None, rounds: int = ROUNDS, flatten: float = FLATTEN, task_cells: int = TASK_CELLS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with x, the tokens of each that the sample shall have in expectation: no more than its tokens, the goals() in sum.

    In turn for each dimension, weights w are scaled so that the sums of x = min(tokens, w) by its values come to their
    goals: cells that are full stay so, the others share what is left. After each so many rounds the largest_error() is
    measured: at tolerance the weights are done. Where the cells that there are can't meet all goals, raking ends once
    twice the rounds hardly lessen the error, and a warning tells what is left.

    Up to TASK_CELLS cells are one partition, so all steps of these rounds are one plan without a shuffle. Beyond, only
    sums by value are shuffled and joined, and each step's cells are written, so that the plan doesn't grow. Both give
    the same weights.
    """
    cells = scratch_table(cells.withColumn("w", F.col("tokens") * F.lit(float(budget))))
    few = cells.count() <= task_cells
    base = cells
    for d in DIMENSIONS:
        t = goals(base, d, budget, targets, flatten).withColumnRenamed("t", f"t_{d}")
        cells = (cells.coalesce(1) if few else cells).join(F.broadcast(t) if few else scratch_table(t), d)
    cells, errors = scratch_table(cells), []
    while True:
        cells = _rake_in_task(cells, rounds) if few else _rake_by_steps(cells, rounds)
        errors.append(largest_error(cells))
        n = len(errors)
        if errors[-1] <= tolerance:
            break
        if n >= TRIES and n % 2 == 0 and errors[-1] > STALLED * errors[n // 2 - 1]:
            logging.getLogger(__name__).warning("targets out of reach: after %d rounds a value's share is still %.2g of its target off", n * rounds, errors[-1])
            break
    return cells.select(*DIMENSIONS, "tokens", F.least("tokens", "w").alias("x"))


def _factor(t: Column, full: Column, open_: Column) -> Column:
    """By what the weights of a value are scaled: full are its full cells' tokens, open_ the weights of the others."""
    return F.when((t > full) & (open_ > 0), (t - full) / open_).when(full + open_ > 0, t / (full + open_)).otherwise(1.0)


_FULL, _OPEN = "if(w >= tokens, double(tokens), 0D)", "if(w >= tokens, 0D, w)"


def _rake_in_task(cells: DataFrame, rounds: int) -> DataFrame:
    """Rounds of rake() for no more than TASK_CELLS cells, which bounds the task."""
    now = cells.coalesce(1)
    for _ in range(rounds):
        for d in DIMENSIONS:
            of = Window.partitionBy(d)
            now = now.withColumn("w", F.col("w") * _factor(F.col(f"t_{d}"), F.sum(F.expr(_FULL)).over(of), F.sum(F.expr(_OPEN)).over(of)))
    return scratch_table(now)


def _rake_by_steps(cells: DataFrame, rounds: int) -> DataFrame:
    """Rounds of rake() for any number of cells."""
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = cells.groupBy(d).agg(F.sum(F.expr(_FULL)).alias("f"), F.sum(F.expr(_OPEN)).alias("o"))
            cells = scratch_table(cells.join(now, d).withColumn("w", F.col("w") * _factor(F.col(f"t_{d}"), F.col("f"), F.col("o"))).drop("f", "o"))
    return cells


def largest_error(cells: DataFrame) -> float:
    """How far the tokens of a value in the sample are from their goal t_<dimension>, as a part of it: the most of all values; 0 without cells."""
    x = F.sum(F.least("tokens", "w"))
    errors = [cells.groupBy(d).agg(x.alias("x"), F.first(f"t_{d}").alias("t")).agg(F.max(F.when(F.col("t") > 0, F.abs(F.col("x") / F.col("t") - 1)).otherwise(F.col("x"))).alias("e")) for d in DIMENSIONS]
    return errors[0].unionByName(errors[1]).unionByName(errors[2]).agg(F.max("e")).first()[0] or 0.0


def draw(id_column: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that follows from the id: repeated rows share their fate. A null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def probabilities(described_: DataFrame, budget: float = BUDGET, targets: Targets | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(source, lang, topic, p) from described() rows: the probability of each document of a cell, x / tokens."""
    return scratch_table(rake(cells_of(described_), budget, targets, flatten=flatten).select(*DIMENSIONS, (F.col("x") / F.col("tokens")).alias("p")))


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows, that have the dimensions, with p; 0 where they have no tokens."""
    small = cells.count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(cells) if small else cells, list(DIMENSIONS), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def mix(docs: DataFrame, budget: float = BUDGET, targets: Targets | None = None, flatten: float = FLATTEN, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, lang, topic, tokens, p and kept.

    targets gives the weights of values by dimension (source, lang, topic), see goals(). topic is a column expression of
    docs, the kind of text without one. Null sources, languages and topics are a value of their own. Documents without
    words have p = 0. Repeated rows count each and are kept or dropped together; other columns are left out; an empty
    table gives no rows.
    """
    rows = scratch_table(described(docs, id_col, text_col, topic=topic))
    out = with_probability(rows, probabilities(rows, budget, targets, flatten))
    return out.select("doc_id", *DIMENSIONS, "tokens", F.round("p", 4).alias("p"), (draw(F.col("doc_id")) < F.col("p")).alias("kept"))


def sample(docs: DataFrame, budget: float = BUDGET, targets: Targets | None = None, flatten: float = FLATTEN, topic: Column | None = None) -> DataFrame:
    """The rows of docs (with doc_id, text, source, lang) that mix() keeps, with their own columns, whatever their names."""
    cells = probabilities(described(docs, topic=topic), budget, targets, flatten)
    marked = described(docs, topic=topic, own=F.struct(*[F.col(quoted(c)) for c in docs.columns]))
    return with_probability(marked, cells).where(draw(F.col("doc_id")) < F.col("p")).select(*[F.col(f"own.{quoted(c)}").alias(c) for c in docs.columns])


def oracle(docs: str = "documents", budget: float = BUDGET, flatten: float = FLATTEN, rounds: int = 300) -> str:
    """mix() without targets in DuckDB SQL: the goals in closed form, many rounds of raking by recursion."""
    word, digit, mark = _WORD, _DIGIT, _MARK
    length = lambda pattern, by: f"length(regexp_replace(text, '{pattern}', '{by}', 'g'))"
    out = [
        f"""base AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text FROM {docs})""",
        f"""sized AS MATERIALIZED (SELECT *, length(text) AS n, {length(word, "x")} - {length(word, "")} AS tokens FROM base)""",
        f"""descr AS MATERIALIZED (SELECT doc_id, source, lang, tokens::BIGINT AS tokens,
            CASE WHEN tokens = 0 THEN 'empty' WHEN (n - {length(mark, "")}) * 100 > n * 8 THEN 'marked'
                 WHEN (n - {length(digit, "")}) * 100 > n * 5 THEN 'numeric' WHEN tokens < 100 THEN 'short' ELSE 'prose' END AS topic FROM sized)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM descr GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for d in DIMENSIONS:
        # in the order of have / share, values are full up to some place; the level is the largest of all places'
        out.append(f"h_{d} AS MATERIALIZED (SELECT {d}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {flatten}) AS share FROM c0 GROUP BY {d})")
        out.append(f"""l_{d} AS MATERIALIZED (SELECT max((({budget} * (SELECT sum(have) FROM h_{d}) - before)) / rest) AS level FROM (
            SELECT coalesce(sum(have) OVER (ORDER BY have / share, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(share) OVER (ORDER BY have / share, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM h_{d}))""")
        out.append(f"t_{d} AS MATERIALIZED (SELECT {d}, least(have, share * level) AS t_{d} FROM h_{d}, l_{d})")
    inner = "raked"
    for d in DIMENSIONS:
        full, rest = f"sum(CASE WHEN w >= tokens THEN tokens::DOUBLE ELSE 0 END) OVER (PARTITION BY {d})", f"sum(CASE WHEN w >= tokens THEN 0 ELSE w END) OVER (PARTITION BY {d})"
        inner = f"""(SELECT k, source, lang, topic, tokens, t_source, t_lang, t_topic, w * CASE WHEN t_{d} > f AND o > 0 THEN (t_{d} - f) / o WHEN f + o > 0 THEN t_{d} / (f + o) ELSE 1 END AS w
            FROM (SELECT *, {full} AS f, {rest} AS o FROM {inner}))"""
    out.append(f"""raked AS (
        SELECT 0 AS k, source, lang, topic, tokens, t_source, t_lang, t_topic, tokens * {budget}::DOUBLE AS w FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
        UNION ALL SELECT k + 1, source, lang, topic, tokens, t_source, t_lang, t_topic, w FROM {inner} WHERE k < {rounds})""")
    out.append(f"""mixed AS (SELECT d.*, coalesce(least(1.0, c.w / c.tokens), 0.0) AS p, ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)} AS u
        FROM descr d LEFT JOIN (SELECT * FROM raked WHERE k = {rounds}) c USING (source, lang, topic))""")
    return "WITH RECURSIVE " + ",\n".join(out) + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 4) AS p, u < p AS kept FROM mixed"


ORACLE = oracle()
