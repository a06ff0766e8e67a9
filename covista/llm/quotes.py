"""Chat formatting by quotation linking: quoted passages are hashed and joined to the messages they are from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_table

#: A line's quote marks; a passage shorter than this, when normalised, links within its conversation only.
MARKS, LEAST = r"^(?:[ \t]*>)+", 12


def own_text(text):
    """The text without its quoted lines, and without blank lines at its ends."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: ~x.rlike(MARKS))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, chars): the passages of each message, at level 0 its own words, at level 1 what it quotes, and so on.

    A passage is a maximal run of lines that are not blank and have one quote level; each of its lines is a passage too.
    They are compared in lower case and with single blanks. A null text has none; rows that repeat a place and text count
    once; other columns are left out; an empty table gives no rows.
    """
    # a message is told from others by its place and text, and its lines are counted within it, so nothing grows with a conversation
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("k", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", MARKS, "")), r"[\x20\x09-\x0D]+", " "))
    lines = lines.select("conv_id", "turn", "th", "k", level.alias("level"), words.alias("words"))
    at = Window.partitionBy("conv_id", "turn", "th").orderBy("k")
    new = (F.col("words") == "") | F.coalesce((F.lag("level").over(at) != F.col("level")) | (F.lag("words").over(at) == ""), F.lit(True))
    lines = lines.withColumn("run", F.sum(new.cast("int")).over(at)).where("words <> ''")
    runs = lines.groupBy("conv_id", "turn", "th", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda x: x["words"]), " ").alias("words"))
    both = runs.select("conv_id", "turn", "level", "words").unionByName(lines.select("conv_id", "turn", "level", "words"))
    return both.select("conv_id", "turn", "level", F.sha2("words", 256).alias("hash"), F.length("words").alias("chars")).distinct()


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, linked_turn, source_conv, source_turn, n_quoted, n_linked) for messages that quote something.

    A quoted passage is from the first message of the conversation that has it as its own words, if that is an earlier
    one; else, if it has LEAST characters, from the first message of any other conversation. A message answers the one that most characters of its
    quotes are from, the outermost quote level first and the latest message at ties. Each passage joins one row, the
    first of its kind, so a passage that many messages share links each of them once.
    """
    found = scratch_table(passages(messages.where("conv_id is not null and turn is not null")))
    quoted, own = found.where("level > 0"), found.where("level = 0")
    here = scratch_table(own.groupBy("conv_id", "hash").agg(F.min("turn").alias("from_turn"), F.max("chars").alias("own_chars")))
    long = here.where(F.col("own_chars") >= LEAST).select("hash", F.struct("conv_id", F.col("from_turn").alias("turn")).alias("at"))
    there = scratch_table(long.groupBy("hash").agg(F.min("at").alias("first")))
    # the asking conversation may be the first one that has it; then the second is meant
    others = long.join(there, "hash").where("at.conv_id <> first.conv_id").groupBy("hash").agg(F.min("at").alias("second"))
    there = scratch_table(there.join(scratch_table(others), "hash", "left"))
    here = here.drop("own_chars")
    x = quoted.join(here, ["conv_id", "hash"], "left").withColumn("from_turn", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")))
    x = scratch_table(x)
    # short passages, of which some are very common, have no part in the join on the hash alone
    far = x.where(F.col("chars") >= LEAST).join(there, "hash", "left").unionByName(x.where(F.col("chars") < LEAST), allowMissingColumns=True)
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    x = scratch_table(far.select("conv_id", "turn", "level", "chars", "from_turn", F.when(F.col("from_turn").isNull(), other).alias("first")))
    by = x.where("from_turn is not null").groupBy("conv_id", "turn", "level", "from_turn").agg(F.sum("chars").alias("chars"))
    best = by.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "chars", "from_turn"))["from_turn"].alias("linked_turn"))
    rest = x.groupBy("conv_id", "turn").agg(F.min("first").alias("first"), F.count("*").alias("n_quoted"), F.sum((F.col("from_turn").isNotNull() | F.col("first").isNotNull()).cast("long")).alias("n_linked"))
    return rest.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", "linked_turn", F.col("first.conv_id").alias("source_conv"), F.col("first.turn").alias("source_turn"), "n_quoted", "n_linked")


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent_turn): who began it, and how many replies lie between.

    Pointer jumping: each round doubles how far a message sees, and joins on message, never on conversation. Only messages
    that don't see their root yet are joined, so a long thread costs rounds for its own messages alone.
    """
    root = F.col("parent_turn").isNull()
    now = scratch_table(parents.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("up"), (~root).cast("long").alias("depth"), root.alias("ended")))
    while not now.where("not ended").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("done"))
        moved = now.where("not ended").join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done").alias("ended"))
        now = scratch_table(now.where("ended").unionByName(moved))
    return now.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def reply_order(conversations: DataFrame) -> DataFrame:
    """Messages without their quotes, and where they stand in their conversation.

    One row for each row of conversations (conv_id, turn, role, text): conv_id, turn, role, parent_turn, by_quote,
    source_conv, source_turn, n_quoted, n_linked, root_turn, depth, text. parent_turn is the message it quotes; one that
    quotes no earlier message of its conversation answers the turn before it, if there is one. In a conversation,
    (root_turn, depth, turn) is the order of replies: each message after the one it answers. Rows without conv_id or turn
    are threads of their own; a null text is empty; rows that repeat a place share what is found for it. Other columns are
    left out; an empty table gives no rows.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    places = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last"))
    known = scratch_table(places.join(before, ["conv_id", "turn"], "left").join(scratch_table(link(rows)), ["conv_id", "turn"], "left").withColumn("parent_turn", F.coalesce("linked_turn", "last")).drop("last"))
    known = known.join(threads(known), ["conv_id", "turn"])
    return rows.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.col("linked_turn").isNotNull().alias("by_quote"), "source_conv", "source_turn",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked")], F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), own_text(F.col("text")).alias("text"),
    )


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (
  SELECT conv_id, turn, md5(text) AS th, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS k
  FROM (SELECT DISTINCT conv_id, turn, text FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), n AS (
  SELECT conv_id, turn, th, k, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS words FROM l
), b AS (
  SELECT *, CASE WHEN words = '' OR coalesce(lag(level) OVER w <> level OR lag(words) OVER w = '', true) THEN 1 ELSE 0 END AS new
  FROM n WINDOW w AS (PARTITION BY conv_id, turn, th ORDER BY k)
), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, th ORDER BY k) AS run FROM b),
p AS (
  SELECT DISTINCT conv_id, turn, level, words FROM (
    SELECT conv_id, turn, level, words FROM r WHERE words <> ''
    UNION ALL SELECT conv_id, turn, level, string_agg(words, ' ' ORDER BY k) FROM r WHERE words <> '' GROUP BY conv_id, turn, th, run, level
  )
), here AS (SELECT conv_id, words, min(turn) AS from_turn FROM p WHERE level = 0 GROUP BY ALL),
there AS (SELECT words, min({'c': conv_id, 't': from_turn}, 2) AS two FROM here WHERE length(words) >= 12 GROUP BY ALL),
x AS (
  SELECT p.conv_id, p.turn, p.level, length(p.words) AS chars, CASE WHEN h.from_turn < p.turn THEN h.from_turn END AS from_turn,
         CASE WHEN coalesce(h.from_turn >= p.turn, true) THEN list_filter(t.two, lambda e: e.c <> p.conv_id)[1] END AS first
  FROM p LEFT JOIN here h ON h.conv_id = p.conv_id AND h.words = p.words LEFT JOIN there t ON t.words = p.words WHERE p.level > 0
), best AS (
  SELECT conv_id, turn, arg_max(from_turn, {'l': -level, 'c': chars, 'f': from_turn}) AS linked_turn
  FROM (SELECT conv_id, turn, level, from_turn, sum(chars) AS chars FROM x WHERE from_turn IS NOT NULL GROUP BY ALL) GROUP BY ALL
), rest AS (
  SELECT conv_id, turn, min(first) AS first, count(*) AS n_quoted, count(*) FILTER (from_turn IS NOT NULL OR first IS NOT NULL) AS n_linked FROM x GROUP BY ALL
), k AS (
  SELECT a.conv_id, a.turn, b.linked_turn, coalesce(b.linked_turn, z.turn) AS parent_turn, r.first.c AS source_conv, r.first.t AS source_turn, r.n_quoted, r.n_linked
  FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL) a
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM m) z ON z.conv_id = a.conv_id AND z.turn = a.turn - 1
  LEFT JOIN best b ON b.conv_id = a.conv_id AND b.turn = a.turn LEFT JOIN rest r ON r.conv_id = a.conv_id AND r.turn = a.turn
), t AS (
  SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM k WHERE parent_turn IS NULL
  UNION ALL SELECT k.conv_id, k.turn, t.root_turn, t.depth + 1 FROM k JOIN t ON t.conv_id = k.conv_id AND t.turn = k.parent_turn
)
SELECT m.conv_id, m.turn, m.role, coalesce(k.parent_turn, -1) AS parent_turn, k.linked_turn IS NOT NULL AS by_quote, coalesce(k.source_conv, -1) AS source_conv, coalesce(k.source_turn, -1) AS source_turn,
       coalesce(k.n_quoted, 0)::BIGINT AS n_quoted, coalesce(k.n_linked, 0)::BIGINT AS n_linked, coalesce(t.root_turn, m.turn) AS root_turn, coalesce(t.depth, 0) AS depth,
       regexp_replace(array_to_string(list_filter(string_split_regex(m.text, '\r\n|\r|\n'), lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') AS text
FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
