"""Merkle manifest of a table: 16-ary hash trees per source, a tree over their roots, and a witness for every row.

Rows are leaves, in the order of their ids within a source.  Leaves are dealt to blocks of 4,096 neighbours, and each
block is one aligned append: finished leaves join open subtrees, a subtree that has its 16th child closes, and every witness below it is
extended by the siblings at that height.  The roots of the blocks are then appended in the same way, blocks of blocks, until
every source has one root; the roots of the sources are one more such tree.  On the way back each block is appended once more, now with
witnesses, and extends them by that of its own root; so no witness is stored half-done, and no group is larger than a block,
however many rows one source has.

A witness is (siblings, positions): for each height the digests of the other nodes of the run, joined, and how many of them come before.  A run of
one node has no siblings and still becomes a parent.

Defined cases: a NULL in a row counts as ``-``; a NULL source is a source of its own and comes first; rows with a NULL id
come first in their source, rows that share an id follow the order of their leaves, and copies of a row are leaves of their own;
a very long text is hashed by Spark as one value; an empty table has no leaves and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import drop_scratch, pin, read

FAN = 16
#: Heights that one block spans, unless a caller says otherwise; it holds FAN ** HEIGHT nodes.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**changed: Column) -> Column:
    """Digest of a row: every field as byte count, colon and value, or ``-``."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Append:
    """Open subtrees of one block; ``add`` nodes from the left, then ``close``.

    A node is its digest and the witnesses of the leaves below it; a witness is a list of (siblings, position).
    """

    def __init__(self, height: int) -> None:
        self.height = height
        self.open: list[list[tuple[str, list[list]]]] = [[] for _ in range(height + 1)]

    def add(self, digest: str, witnesses: list[list]) -> None:
        self.open[0].append((digest, witnesses))
        for at in range(self.height):
            if len(self.open[at]) < FAN:
                break
            self._complete(at)

    def _complete(self, at: int) -> None:
        """Close the open run of a height: its nodes are siblings now, and their parent joins the run above."""
        run, self.open[at] = self.open[at], []
        digests = [digest for digest, _ in run]
        for place, (_, witnesses) in enumerate(run):
            if witnesses:
                step = ("".join(digests[:place] + digests[place + 1 :]), place)
                for witness in witnesses:
                    witness.append(step)
        self.open[at + 1].append((_digest("".join(digests)), [w for _, witnesses in run for w in witnesses]))

    def close(self) -> str:
        """The block's root; runs that are still open close as they are."""
        for at in range(self.height):
            if self.open[at]:
                self._complete(at)
        return self.open[self.height][0][0]


def height_of(size: int, most: int) -> int:
    """Heights that a block of a tree with ``size`` nodes spans: ``most``, or those up to its single root."""
    height = 0
    while height < most and FAN**height < size:
        height += 1
    return height


def numbered(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``nodes`` pinned in the order (key, order), with ``idx`` from 0 and the number ``size`` of each key's nodes.

    The range sort cuts a large key over many tasks; only one row per key and task is summed up.
    """
    placed = pin(nodes.orderBy(key, *order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    pieces = placed.groupBy(key, part.alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("_before", before).withColumn("size", F.sum("_n").over(whole)).drop("_n")
    joined = placed.withColumn("_part", part).join(pieces, [key, "_part"])
    out = pin(joined.withColumn("idx", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_first", "_before"))
    drop_scratch(nodes.sparkSession, placed)
    return out


def _block(height: int) -> Column:
    return F.shiftright("idx", 4 * height)  # of FAN ** height nodes


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, idx, size, digest): one node per block, numbered by block; a tree with one block has its root."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        append = Append(height_of(size, height))
        for digest in table.sort_by("idx").column("digest").to_pylist():
            append.add(digest, [])
        return pa.table({
            "tree": table.column("tree").slice(0, 1),
            "idx": table.column("block").slice(0, 1),
            "size": [-(-size // FAN**height)],
            "digest": [append.close()],
        })

    blocks = nodes.select("tree", _block(height).alias("block"), "idx", "size", "digest")
    return pin(blocks.groupBy("tree", "block").applyInArrow(run, "tree string, idx long, size long, digest string"))


def block_witnesses(nodes: DataFrame, above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Rows of ``nodes`` with (siblings, positions, subroot, root).

    ``above`` has a row per block of ``nodes``, numbered like it, with the witness that goes on from the block's root.
    """
    names = nodes.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("idx")
        digests = rows.column("digest").to_pylist()
        append, witnesses = Append(height_of(rows.column("size")[0].as_py(), height)), [[] for _ in digests]
        for digest, witness in zip(digests, witnesses):
            append.add(digest, [witness])
        append.close()
        upper = right.to_pylist()[0]
        whole = {
            "siblings": pa.array([[s for s, _ in w] + upper["siblings"] for w in witnesses], pa.list_(pa.string())),
            "positions": pa.array([[p for _, p in w] + upper["positions"] for w in witnesses], pa.list_(pa.int32())),
            "subroot": pa.array([upper["subroot"]] * len(digests)),
            "root": pa.array([upper["root"]] * len(digests)),
        }
        return pa.table({**{name: rows.column(name) for name in names}, **whole})

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    schema = f"{own}, siblings array<string>, positions array<int>, subroot string, root string"
    left = nodes.withColumn("block", _block(height)).groupBy("tree", "block")
    right = above.select("tree", F.col("idx").alias("block"), "siblings", "positions", "subroot", "root").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(run, schema)


def forest(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """``nodes`` (tree, idx, size, digest and others), the roots of its blocks, and so on to one root per tree."""
    levels = [nodes]
    while True:
        levels.append(block_roots(levels[-1], height))
        if (levels[-1].agg(F.max("size")).first()[0] or 1) <= 1:
            return levels


def _down(levels: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    for nodes in reversed(levels[:-1]):
        above = block_witnesses(nodes, above, height)
    return above


class Manifest:
    """Hash trees of a table: ``leaves``, the ``subroots`` of its sources and their ``root``."""

    def __init__(self, docs: DataFrame, others: dict[str, Column] | None = None, height: int = HEIGHT) -> None:
        """``others`` are further columns that leaves carry (they are no part of the digest)."""
        self.height = height
        source = F.col("source").cast("string")
        rows = docs.select(
            F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
            leaf().alias("digest"), *(column.alias(name) for name, column in (others or {}).items()),
        )
        self.leaves = numbered(rows, "tree", ["doc_id", "digest"])
        self.levels = forest(self.leaves, height)
        roots = self.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.subroots = numbered(roots, "tree", ["name"])
        self.top = forest(self.subroots, height)
        self.root = self.top[-1].select(F.col("digest").alias("root"))

    def witnesses(self) -> DataFrame:
        """Every leaf with its number and witness: (doc_id, digest, others, idx, size, siblings, positions, subroot, root)."""
        none = [F.array().cast("array<string>").alias("siblings"), F.array().cast("array<int>").alias("positions")]
        over = self.top[-1].select("tree", "idx", *none, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        roots = _down(self.top, over, self.height).select(
            F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "siblings", "positions", F.col("digest").alias("subroot"), "root"
        )
        return _down(self.levels, roots, self.height)


def fold(digest: Column, siblings: Column, positions: Column) -> Column:
    """The root that a leaf digest and its witness lead to."""

    def up(node: Column, step: Column) -> Column:
        before = 64 * step["positions"]
        others = step["siblings"]
        return F.sha2(F.concat(F.substring(others, F.lit(1), before), node, F.substring(others, before + 1, F.length(others))), 256)

    return F.aggregate(F.arrays_zip(siblings.alias("siblings"), positions.alias("positions")), digest, up)


def op13_merkle(spark, sf_dir: str, height: int = HEIGHT) -> DataFrame:
    """Leaf, roots, proof digest and outcome of the check of every document; every fifth is lower-cased before the check."""
    docs = read(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(text=F.translate("text", upper, upper.lower())))
    rows = Manifest(docs, {"tampered": tampered}, height).witnesses()
    folded = fold(F.coalesce("tampered", "digest"), F.col("siblings"), F.col("positions"))
    rows = rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
with recursive crc as (
  select doc_id, list_reduce([4294967295::bigint] || list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::bigint),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) as c
  from (select distinct doc_id, cast(doc_id as varchar) as id from documents where doc_id is not null)),
given as (
  select d.*, coalesce(xor(c.c, 4294967295) % 5 = 0, false) as touched,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as other
  from documents d left join crc c on d.doc_id = c.doc_id),
digests as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as digest,
    sha256(head || coalesce(strlen(case when touched then other else text end) || ':' || case when touched then other else text end, '-')) as shown
  from (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from given)),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, digest) - 1 as idx, count(*) over (partition by source) as size,
    coalesce('+' || source, '') as tree
  from digests),
up as (
  select 0 as height, tree, idx, size, digest from leaves
  union all
  select height + 1, tree, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' order by idx))
  from up where size > 1 group by height, tree, idx // 16, size),
tops as (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as size from up where size = 1),
over_tops as (
  select 0 as height, idx, size, subroot as digest from tops
  union all
  select height + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' order by idx))
  from over_tops where size > 1 group by height, idx // 16, size),
steps as (
  select 0 as part, a.tree, a.height, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as before,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as after
  from up a join up b on a.tree = b.tree and a.height = b.height and a.idx // 16 = b.idx // 16 where a.size > 1 group by all
  union all
  select 1, '', a.height, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), ''),
    coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '')
  from over_tops a join over_tops b on a.height = b.height and a.idx // 16 = b.idx // 16 where a.size > 1 group by all),
climb as (
  select l.tree as leaf_tree, l.idx as leaf_idx, l.tree, 0 as part, 0 as height, l.idx, l.size, l.shown as node, '' as proof from leaves l
  union all
  select c.leaf_tree, c.leaf_idx, case when s.height is null then '' else c.tree end, case when s.height is null then 1 else c.part end,
    case when s.height is null then 0 else c.height + 1 end, case when s.height is null then t.idx else c.idx // 16 end,
    case when s.height is null then t.size else (c.size + 15) // 16 end,
    case when s.height is null then c.node else sha256(s.before || c.node || s.after) end, c.proof || coalesce(s.before || s.after, '')
  from climb c left join steps s on s.part = c.part and s.tree = c.tree and s.height = c.height and s.idx = c.idx and c.size > 1
    left join tops t on t.tree = c.leaf_tree
  where c.size > 1 or c.part = 0)
select l.doc_id, l.digest as leaf, t.subroot, r.digest as root, sha256(c.proof) as proof_sha256, c.node as folded_root, c.node = r.digest as verified
from leaves l join tops t using (tree) join climb c on c.leaf_tree = l.tree and c.leaf_idx = l.idx and c.part = 1 and c.size = 1
  cross join (select digest from over_tops where size = 1) r
"""
