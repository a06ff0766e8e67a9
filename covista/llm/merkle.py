"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

Nodes of a tree are numbered in their order by range partitions and prefix sums, and dealt into aligned blocks of
FAN**DEPTH consecutive ones: a block is a whole subtree, so one task can reduce it to its root whatever the other
blocks are. In a task an in-memory DuckDB makes the levels, by ordered string_agg and sha256. The roots of the blocks
are the nodes of the next round, until each tree has one. A proof has an inner part, of the row's block, and an outer
part, the same for all rows of a block; only the outer parts are joined, one row a block.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, scratch_table

#: Nodes of a run, and levels of a block: blocks have FAN**DEPTH nodes.
FAN, DEPTH = 16, 3
#: The columns that a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field is - if null, else its length in UTF-8 bytes, a colon, and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def numbered(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """nodes with pos, each node's number in its tree by order, from 0, and size, the nodes of its tree.

    Sorted over all partitions by range; a node's number is its place in its partition and how many of its tree the
    partitions before hold. A tree may be null. No tree comes into one task: windows run over (tree, partition) counts.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranked = nodes.repartitionByRange(n, F.asc_nulls_first(tree), *map(F.asc_nulls_first, order)).sortWithinPartitions(F.asc_nulls_first(tree), *map(F.asc_nulls_first, order))
    ranked = scratch_table(ranked.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)))
    counts = scratch_table(ranked.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first")))
    before = Window.partitionBy("_tree").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("_tree")
    starts = scratch_table(counts.select("_tree", "_in", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(all_).alias("size")))
    met = ranked.join(starts, (F.col("_part") == F.col("_in")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return met.withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_tree", "_in", "_shift")


def _sql(db, query: str) -> pa.Table:
    return db.sql(query).to_arrow_table()


class Blocks:
    """Whole blocks of an ordered stream of batches, reduced by a DuckDB of the task's own."""

    def __init__(self, fan: int, depth: int):
        import duckdb

        self.fan, self.depth = fan, depth
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})  # nothing goes to a local disk

    def whole(self, batches, rows: int = 4096):
        """Tables of whole blocks, which are consecutive rows of equal (tid, block), of about so many rows."""
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                t = pa.Table.from_batches(held).combine_chunks()
                key, block = t.column("tid").to_numpy(), t.column("block").to_numpy()
                at = n - 1
                while at and (key[at - 1], block[at - 1]) == (key[n - 1], block[n - 1]):
                    at -= 1
                if at:
                    yield t.slice(0, at)
                held, n = t.slice(at).combine_chunks().to_batches(), n - at
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def levels(self, t: pa.Table) -> None:
        """Tables l0, l1, ... of the nodes (tid, block, pos, digest) of each level; run k has the joined digests of the runs of level k - 1.

        A tree takes as many levels as it takes to have one node, and no more than depth.
        """
        self.db.register("rows", t)
        self.db.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT tid, block, pos, size, digest FROM rows")
        for k in range(1, self.depth + 1):
            self.db.execute(f"""
                CREATE OR REPLACE TEMP TABLE l{k} AS
                SELECT tid, block, pos // {self.fan} AS pos, (any_value(size) + {self.fan - 1}) // {self.fan} AS size,
                       string_agg(digest, '' ORDER BY pos) AS run,
                       CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
                FROM l{k - 1} GROUP BY tid, block, pos // {self.fan}""")

    def roots(self, t: pa.Table) -> pa.Table:
        self.levels(t)
        return _sql(self.db, f"SELECT tid, block, size, digest FROM l{self.depth}")

    def paths(self, t: pa.Table) -> pa.Table:
        """For each node: before and after, lists of its siblings' joined digests by level, the lowest first."""
        self.levels(t)
        parts = []
        for k in range(1, self.depth + 1):
            below, run = self.fan ** (k - 1), self.fan**k
            parts.append(f"""
                SELECT l0.tid, l0.pos, {k} AS k, l{k}.run AS run, l0.pos // {below} % {self.fan} AS nth
                FROM l0 JOIN l{k} AS up ON up.tid = l0.tid AND up.pos = l0.pos // {run} JOIN l{k - 1} AS own ON own.tid = l0.tid AND own.pos = l0.pos // {below}
                WHERE own.size > 1""".replace(f"l{k}.run", "up.run"))
        return _sql(self.db, f"""
            WITH p AS ({" UNION ALL ".join(parts)}),
            g AS (SELECT tid, pos, list(left(run, 64 * nth) ORDER BY k) AS b, list(substr(run, 64 * nth + 65) ORDER BY k) AS a FROM p GROUP BY tid, pos)
            SELECT rows.*, coalesce(g.b, []) AS before, coalesce(g.a, []) AS after FROM rows LEFT JOIN g USING (tid, pos)""")

    def proofs(self, t: pa.Table) -> pa.Table:
        """For each leaf: its subroot, proof_sha256 of its inner and outer siblings, and folded_root from what it is now and these.

        t has, besides the leaves, a row of pos -1 for each block with what its leaves share.
        """
        top = pc.less(t.column("pos"), 0)
        self.db.register("tops", t.filter(top).select(["tid", "block", "subroot", "before", "after"]))
        self.db.register("leaves", self.paths(t.filter(pc.invert(top)).select(["tid", "block", "pos", "size", "digest", "doc_id", "now"])))
        self.db.execute("""
            CREATE OR REPLACE TEMP TABLE f AS
            SELECT doc_id, digest, subroot, now AS folded, list_concat(l.before, o.before) AS b, list_concat(l.after, o.after) AS a
            FROM leaves AS l JOIN tops AS o USING (tid, block)""")
        deepest = self.db.execute("SELECT coalesce(max(len(b)), 0) FROM f").fetchall()[0][0]
        for k in range(1, deepest + 1):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE f AS SELECT * REPLACE (CASE WHEN len(b) >= {k} THEN sha256(b[{k}] || folded || a[{k}]) ELSE folded END AS folded) FROM f")
        return _sql(self.db, "SELECT doc_id, digest AS leaf, subroot, sha256(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || a[i]), '')) AS proof_sha256, folded AS folded_root FROM f")


#: What the steps of Blocks return.
COLUMNS = {
    "roots": {"tid": pa.int64(), "block": pa.int64(), "size": pa.int64(), "digest": pa.string()},
    "paths": {"tid": pa.int64(), "pos": pa.int64(), "before": pa.list_(pa.string()), "after": pa.list_(pa.string())},
    "proofs": {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()},
}


def in_blocks(step: str, nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """A step of Blocks over nodes (tid, block, pos and others): blocks are dealt over the tasks, and each task reads them in order."""
    schema = pa.schema(list(COLUMNS[step].items()))

    def run(batches):
        blocks = Blocks(fan, depth)
        for t in blocks.whole(batches):
            yield from getattr(blocks, step)(t).select(schema.names).cast(schema).to_batches(1_000)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {pa.int64(): "long", pa.string(): "string"}
    ddl = ", ".join(f"{name} {kinds.get(kind, 'array<string>')}" for name, kind in COLUMNS[step].items())
    return nodes.repartition(n, "tid", "block").sortWithinPartitions("tid", "block", "pos").mapInArrow(run, ddl)


def _placed(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    return nodes.select("tid", F.floor(F.col("pos") / fan**depth).alias("block"), "pos", "size", "digest")


def reduced(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """The rounds from nodes (tid, pos, size, digest) to the roots of the trees: tables of the same columns.

    The nodes of a round are the roots of the blocks of the one before; the last has one node for each tree.
    """
    rounds = [nodes]
    while len(rounds) < 2 or not rounds[-1].where("size > 1").isEmpty():
        done = in_blocks("roots", _placed(rounds[-1], fan, depth), fan, depth)
        rounds.append(scratch_table(done.select("tid", F.col("block").alias("pos"), "size", "digest")))
    return rounds


def siblings(rounds: list[DataFrame], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(tid, pos, before, after) for the nodes of the first of these rounds: their siblings by level, up to their tree's root."""
    outer = None
    for nodes in reversed(rounds):
        own = in_blocks("paths", _placed(nodes, fan, depth), fan, depth)
        if outer is not None:
            up = outer.toDF("t", "p", "ob", "oa")
            own = own.join(up, (F.col("tid") == F.col("t")) & (F.floor(F.col("pos") / fan**depth) == F.col("p")))
            own = own.select("tid", "pos", F.concat("before", "ob").alias("before"), F.concat("after", "oa").alias("after"))
        outer = scratch_table(own)
    return outer


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs has the columns FIELDS, others are left out. Rows of a source stand by doc_id, null first; rows that share an id
    by their leaf. Sources stand by their UTF-8 bytes, null first. A source of one row has its leaf as subroot, a table
    of one source its subroot as root; without siblings the proof is the digest of nothing. Rows whose id has a crc32
    that 5 divides are tampered with: letters A-Z of their text are made lower case before the leaf is folded again (a
    null text or id stays as it is). Null and empty fields differ; texts are hashed whole, where they lie, and never
    shuffled. An empty table gives no rows.
    """
    c = {f: F.col(quoted(f)) for f in FIELDS}
    hit = (F.crc32(c["doc_id"].cast("string").cast("binary")) % 5 == 0) & c["text"].isNotNull()
    now = leaf([*(c[f] for f in FIELDS[:-1]), F.translate(c["text"], UPPER, LOWER)])
    leaves = docs.select(c["doc_id"].cast("long").alias("doc_id"), c["source"].alias("source"), leaf([c[f] for f in FIELDS]).alias("digest"), F.when(hit, now).alias("now"))
    placed = scratch_table(numbered(scratch_table(leaves), "source", "doc_id", "digest"))
    sources = scratch_table(placed.select("source").distinct().withColumn("all", F.lit(0)))
    sources = numbered(sources, "all", "source").select(F.col("source").alias("s"), F.col("pos").alias("tid"), F.col("size").alias("n_sources"))
    sources = scratch_table(sources)
    nodes = placed.join(sources, F.col("source").eqNullSafe(F.col("s")))
    nodes = scratch_table(nodes.select("tid", "pos", "size", "digest", "doc_id", F.coalesce("now", "digest").alias("now")))

    rounds = reduced(nodes.select("tid", "pos", "size", "digest"), fan, depth)
    subroots = rounds[-1].join(sources, "tid").select(F.lit(0).cast("long").alias("tid"), F.col("tid").alias("pos"), F.col("n_sources").alias("size"), "digest")
    tops = reduced(scratch_table(subroots), fan, depth)
    root = (tops[-1].first() or {"digest": None})["digest"]
    over = siblings(tops, fan, depth).select(F.col("pos").alias("t"), F.col("before").alias("ob"), F.col("after").alias("oa"))
    over = over.join(tops[0].select(F.col("pos").alias("t"), F.col("digest").alias("subroot")), "t")
    blocks = siblings(rounds[1:], fan, depth).join(scratch_table(over), F.col("tid") == F.col("t"))
    shared = blocks.select("tid", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "subroot", F.concat("before", "ob").alias("before"), F.concat("after", "oa").alias("after"))
    rows = nodes.withColumn("block", F.floor(F.col("pos") / fan**depth)).unionByName(shared, allowMissingColumns=True)
    done = in_blocks("proofs", rows, fan, depth).withColumn("root", F.lit(root))
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def brute_force(rows: list[dict]) -> list[tuple]:
    """The same for rows of FIELDS, node by node. For tests."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans(UPPER, LOWER)

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(paths):
                first = at[k] // FAN * FAN
                p.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + FAN])))
                at[k] //= FAN
            nodes = [sha("".join(nodes[k : k + FAN])) for k in range(0, len(nodes), FAN)]
        return nodes[0], paths

    made: dict = {}
    for r in rows:
        own = sha("".join(one(r[f]) for f in FIELDS))
        hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        now = sha("".join(one(r[f].translate(lower) if hit and f == "text" else r[f]) for f in FIELDS))
        made.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"], own, now))
    order = sorted(made, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(made[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order]
    root, above = tree([t for t, _ in trees]) if trees else (None, [])
    out = []
    for s, (subroot, paths), top in zip(order, trees, above, strict=True):
        for (_, i, own, now), path in zip(sorted(made[s], key=lambda x: (x[0], x[1] or 0, x[2])), paths, strict=True):
            folded = now
            for before, after in path + top:
                folded = sha(before + folded + after)
            out.append((i, own, subroot, root, sha("".join(b + a for b, a in path + top)), folded, folded == root))
    return out


def oracle(source_levels: int = 7, top_levels: int = 5) -> str:
    """The statement for trees of up to FAN**source_levels rows a source and FAN**top_levels sources."""
    field = lambda f: f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')"
    line = lambda text: " || ".join([*(field(f) for f in FIELDS[:-1]), field(text)])
    # crc32 bit by bit, the lowest of each byte first
    bits = "list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"
    out = [f"""
WITH d AS (SELECT *, sha256({line("text")}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({line(f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256({line("text")}) END AS now FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p0, count(*) OVER (PARTITION BY source) AS s0, leaf AS n0, now AS f0, '' AS proof0 FROM d)"""]

    def levels(name, by, count):
        for k in range(1, count + 1):
            node = f"SELECT DISTINCT {by}p{k - 1} AS p, s{k - 1} AS s, n{k - 1} AS n FROM {name}{k - 1}"
            out.append(f"""
{name}u{k} AS (SELECT {by}p // {FAN} AS u, min(s) AS s, string_agg(n, '' ORDER BY p) AS joined FROM ({node}) GROUP BY ALL),
{name}{k} AS (SELECT q.* EXCLUDE (proof{k - 1}), p{k - 1} // {FAN} AS p{k}, (s{k - 1} + {FAN - 1}) // {FAN} AS s{k}, CASE WHEN s{k - 1} > 1 THEN sha256(joined) ELSE n{k - 1} END AS n{k},
  CASE WHEN s{k - 1} > 1 THEN sha256(left(joined, 64 * (p{k - 1} % {FAN})) || f{k - 1} || substr(joined, 64 * (p{k - 1} % {FAN}) + 65)) ELSE f{k - 1} END AS f{k},
  proof{k - 1} || CASE WHEN s{k - 1} > 1 THEN left(joined, 64 * (p{k - 1} % {FAN})) || substr(joined, 64 * (p{k - 1} % {FAN}) + 65) ELSE '' END AS proof{k}
  FROM {name}{k - 1} AS q JOIN {name}u{k} AS r ON {"q.source IS NOT DISTINCT FROM r.source AND " if by else ""}q.p{k - 1} // {FAN} = r.u)""")

    levels("a", "source, ", source_levels)
    out.append(f"""
b0 AS (SELECT doc_id, leaf, n{source_levels} AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS p0, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS s0, n{source_levels} AS n0, f{source_levels} AS f0, proof{source_levels} AS proof0 FROM a{source_levels})""")
    levels("b", "", top_levels)
    out.append(f"""
SELECT doc_id, leaf, subroot, n{top_levels} AS root, sha256(proof{top_levels}) AS proof_sha256, f{top_levels} AS folded_root, f{top_levels} = n{top_levels} AS verified FROM b{top_levels}""")
    return ",".join(out[:-1]) + out[-1]


ORACLE = oracle()
